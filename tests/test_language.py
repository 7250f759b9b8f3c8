"""Language detection: both forms of the lookup, and what they shuffle."""
import pytest

from readaloud.operators import language as L

TEXTS = [(1, "the house of the river", "en"), (2, "la maison de la reine", "fr"), (2, "la maison", "fr"), (3, None, None), (4, "", "en"), (None, "the the the", None)]


@pytest.mark.parametrize("limit", [L.MAX_BROADCAST_BYTES, 0])
def test_small_and_large_profiles_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(L, "MAX_BROADCAST_BYTES", limit)
    df = spark.createDataFrame(TEXTS, "doc_id int, text string, lang string")
    got = L.detect(df, L.train(df))
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame(
        [(1, "en", "en"), (2, "fr", "fr"), (2, "fr", "fr"), (3, None, "en"), (4, "en", "en"), (None, None, "en")],
        "doc_id int, lang string, detected string").collect()))


def test_a_small_profile_leaves_the_trigrams_where_they_are(spark):
    """The only exchange of the documents is the one of their sums."""
    df = spark.createDataFrame(TEXTS, "doc_id int, text string, lang string")
    plan = L.detect(df, L.train(df))._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "hashpartitioning(tri" in line and "_row" in line for line in plan.splitlines())
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
