"""Plan shape: no Cartesian products, bounded top-N, checked broadcasts, pruned scans."""
import re

import pytest

from conftest import SF_SMALL
from readaloud.plans import registry

QUERIES = registry.queries()
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cartesian_or_nested_loop(spark, name):
    p = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["feed_top_entries", "feed_new_entries", "request_admission"])
def test_rank_filters_are_group_limits(spark, name):
    p = _plan(QUERIES[name](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


def test_scans_are_pruned(spark):
    p = _plan(QUERIES["url_domain_counts"](spark, SF_SMALL))
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", p).group(1)
    assert schema == "struct<url:string>"
    p = _plan(QUERIES["request_cache_api"](spark, SF_SMALL))
    assert "PushedFilters: [In(event_type" in p


def test_page_text_has_no_exchange_and_no_recomputed_filter(spark):
    for name in ("page_manifest", "page_main_text", "synthesis_manifest", "doc_chunks"):
        p = _plan(QUERIES[name](spark, SF_SMALL))
        assert "Exchange" not in p
        filters = [ln for ln in p.split("\n") if re.search(r"^\W*Filter ", ln)]
        assert all("regexp_replace" not in f for f in filters)


@pytest.mark.parametrize("name,table,scans", [
    ("length_violations", "pages", 1), ("length_violations", "documents", 2),  # content rows, and the feeds' sources
    ("quota_window_counts", "events", 1), ("feed_error_streak", "events", 1), ("page_extract_cascade", "pages", 1), ("page_manifest", "pages", 1), ("language_detect", "documents", 1)])
def test_tables_are_scanned_no_more_than_needed(spark, name, table, scans):
    p = _plan(QUERIES[name](spark, SF_SMALL))
    assert len(re.findall(rf"FileScan parquet [^\n]*{table}\.parquet", p)) == scans


@pytest.mark.parametrize("name", ["request_cache_web", "request_cache_api", "request_parse", "quota_window_counts", "feed_new_entries"])
def test_first_rows_and_counts_are_hash_aggregates(spark, name):
    assert "SortAggregate" not in _plan(QUERIES[name](spark, SF_SMALL))


def test_pending_pages_are_picked_before_the_text_work(spark):
    p = QUERIES["job_outcomes"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in p and p.index("regexp_replace") < p.index("LeftSemi")  # the join stands below the projection
