"""Oracle SQL (DuckDB) for the streaming queries: the batch result they must equal."""
from __future__ import annotations

from ..constants import EXTRACT_ERROR
from . import duck as d
from .feeds_sql import feed_new_entries
from .jobs_sql import STATUS
from .pages_sql import _extract_ctes, _speech_ctes


def stream_dedupe_submissions() -> str:
    return d.with_ctes(d.SUBMISSIONS, d.CONTENT_LOG) + (
        "SELECT DISTINCT url FROM submissions WHERE url NOT IN (SELECT url FROM content_log WHERE is_processed)")


def stream_quota_windows() -> str:
    """Closed windows only: those ending at or before the final watermark."""
    return d.with_ctes(d.SUBMISSIONS,
                       "w AS (SELECT client, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n_requests "
                       "FROM submissions GROUP BY ALL)") + (
        "SELECT client, window_start, window_start + INTERVAL 1 HOUR AS window_end, n_requests, n_requests > 10 AS over_limit "
        "FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")


def stream_fetch_join() -> str:
    """Every page's outcome, and an error for each submission whose page never comes."""
    ctes = _extract_ctes() + ["j AS (SELECT page_id, url, title, original_text FROM s5)"] + _speech_ctes("j", "page_id") + [
        "ok AS (SELECT j.page_id, j.url, j.title, p5.processed_text, p5.word_count FROM j LEFT JOIN p5 ON j.page_id = p5.page_id)"]
    return d.with_ctes(*ctes) + (
        f"SELECT page_id AS submission_id, url, title, CASE WHEN processed_text IS NULL THEN {d.q(EXTRACT_ERROR)} END AS error, "
        "CAST(length(processed_text) AS BIGINT) AS n_chars, word_count FROM ok UNION ALL "
        f"SELECT -1 - page_id, url, NULL, {d.q(EXTRACT_ERROR)}, NULL, NULL FROM pages WHERE page_id % 10 = 0")


def stream_admission() -> str:
    """Ranks within each ceiling's window over the whole table."""
    rank = "row_number() OVER (PARTITION BY client, date_trunc('{0}', ts) ORDER BY ts, request_id) <= {1}"
    return d.with_ctes(d.SUBMISSIONS) + (
        f"SELECT request_id, client, ts, date_trunc('day', ts) AS window_start, {rank.format('day', 5)} AS admitted, "
        f"{rank.format('hour', 10)} AS admitted_api, {rank.format('minute', 5)} AS admitted_web FROM submissions")


def stream_attempts() -> str:
    """Sessions as gaps and islands over the whole log."""
    return d.with_ctes(
        d.CONTENT_JOBS,
        f"c AS (SELECT id, created_at, is_processed, is_processing, {STATUS.replace('is_processing', 'false')} AS final FROM content_jobs)",
        "t AS (SELECT id, created_at AS ts, 'pending' AS status FROM c UNION ALL "
        "SELECT id, created_at + INTERVAL 1 MINUTE, 'processing' FROM c WHERE is_processing OR is_processed UNION ALL "
        "SELECT id, created_at + INTERVAL 2 MINUTE - CASE WHEN id % 11 = 5 THEN INTERVAL 90 SECOND ELSE INTERVAL 0 SECOND END, final "
        "FROM c WHERE is_processed AND NOT is_processing)",
        "a AS (SELECT * FROM t UNION ALL SELECT id, ts + INTERVAL 2 HOUR, status FROM t WHERE id % 7 = 3 AND status IN ('pending', 'processing'))",
        "o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM a)",
        "s AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)",
        "l AS (SELECT id, k, min(ts) AS started, max(ts) AS ended, count(*) AS n_changes, string_agg(CASE WHEN status IN ('pending', 'processing') "
        "THEN status ELSE 'final' END, ' ' ORDER BY ts) AS path FROM s GROUP BY ALL)") + (
        "SELECT id, started, ended, n_changes, CASE path WHEN 'pending processing final' THEN 'complete' WHEN 'pending processing' THEN 'stuck' "
        "WHEN 'pending' THEN 'waiting' ELSE 'illegal' END AS outcome FROM l")


def stream_latest_status() -> str:
    return d.with_ctes(d.CONTENT_JOBS) + f"SELECT id, {STATUS} AS status FROM content_jobs"


def stream_feed_poll() -> str:
    return feed_new_entries()
