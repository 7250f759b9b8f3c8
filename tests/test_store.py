"""Versions of a stored table: the latest row of every id, old columns as NULL, writes that can be repeated."""
import tempfile

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from readaloud.sources.store import current, read_versions, write_version

SCHEMA = StructType([StructField("id", LongType()), StructField("a", StringType()), StructField("b", StringType())])


def _rows(spark, rows, schema="id long, a string, b string"):
    return spark.createDataFrame(rows, schema)


def _table(df):
    return sorted(map(tuple, df.select("id", "a", "b", "version").collect()), key=repr)


def test_latest_row_of_every_id(spark):
    path = tempfile.mkdtemp(prefix="readaloud-test-")
    write_version(_rows(spark, [(1, "x"), (2, "y"), (None, "n"), (None, "n"), (5, "t"), (5, "u")], "id long, a string"), path, 0)
    write_version(_rows(spark, [(3, "z", "new")]), path, 1)
    write_version(_rows(spark, [(2, "y2", None), (3, "z2", "")]), path, 2)
    write_version(_rows(spark, [(2, "y3", "last")]), path, 3)
    assert _table(current(spark, path, SCHEMA)) == sorted([
        (1, "x", None, 0), (2, "y3", "last", 3), (3, "z2", "", 2), (5, "t", None, 0), (5, "u", None, 0),
        (None, "n", None, 0), (None, "n", None, 0)], key=repr)
    assert (2, "y2", None, 2) in _table(current(spark, path, SCHEMA, upto=2))
    assert (3, "z", "new", 1) in _table(current(spark, path, SCHEMA, upto=1))
    assert read_versions(spark, path, SCHEMA).count() == 10


def test_a_repeated_write_replaces_its_version_only(spark):
    path = tempfile.mkdtemp(prefix="readaloud-test-")
    write_version(_rows(spark, [(1, "x", None), (2, "y", None)]), path, 0)
    for _ in range(2):
        write_version(current(spark, path, SCHEMA, upto=0).where("id = 2").drop("version").withColumn("a", F.lit("marked")), path, 1)
    assert _table(current(spark, path, SCHEMA)) == [(1, "x", None, 0), (2, "marked", None, 1)]
    assert read_versions(spark, path, SCHEMA).count() == 3


def test_an_empty_version_and_pruned_folders(spark):
    path = tempfile.mkdtemp(prefix="readaloud-test-")
    write_version(_rows(spark, []), path, 0)
    assert current(spark, path, SCHEMA).count() == 0
    write_version(_rows(spark, [(1, "x", None)]), path, 1)
    assert _table(current(spark, path, SCHEMA)) == [(1, "x", None, 1)]
    plan = read_versions(spark, path, SCHEMA, upto=0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan
