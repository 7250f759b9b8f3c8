import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from readaloud.session import get_session
    s = get_session("local[*]", shuffle_partitions=8, app_name="readaloud-tests")
    yield s


def one(spark, col_fn, values, schema="x string"):
    """Apply a Column function to literal rows; return results in input order."""
    from pyspark.sql import functions as F
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    out = df.select("i", col_fn(F.col(schema.split()[0])).alias("y")).orderBy("i").collect()
    return [r.y for r in out]
