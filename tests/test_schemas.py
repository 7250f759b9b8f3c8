"""Stored tables read with declared schemas; older files gain new columns as NULL."""
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from readaloud import schemas
from readaloud.sources import fixtures as X
from readaloud.sources.tables import read_stored


def test_content_round_trip_with_old_and_new_files(spark):
    base = tempfile.mkdtemp(prefix="readaloud-test-")
    jobs = X.content_jobs(spark, SF_SMALL)
    old = jobs.drop("feed_id")                     # written before the feed column existed
    old.write.parquet(os.path.join(base, "content", "v1"))
    jobs.write.parquet(os.path.join(base, "content", "v2"))
    back = read_stored(spark, os.path.join(base, "content", "*"), schemas.CONTENT)
    # file sources read every column as nullable; names and types are as declared
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in schemas.CONTENT]
    n = jobs.count()
    assert back.count() == 2 * n
    assert back.where(F.col("feed_id").isNotNull()).count() == jobs.where(F.col("feed_id").isNotNull()).count()
    assert back.where(F.col("processed_text").isNotNull()).count() == 0
