"""Shared folders: a local run may make its own, a cluster must name one."""
import pytest
from pyspark.sql import functions as F

from readaloud import session
from readaloud.functions import text as T


class _Cluster:
    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Cluster)


def test_expressions_on_two_tables_keep_apart(spark):
    a = spark.createDataFrame([(1, "one two")], "k int, text string")
    b = spark.createDataFrame([(1, "x")], "k int, text string")
    row = a.join(b, a.k == b.k).select(T.word_count(a["text"]).alias("a"), T.word_count(b["text"]).alias("b")).first()
    assert tuple(row) == (2, 1)
