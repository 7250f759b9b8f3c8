"""Oracle SQL (DuckDB) for the constraint and schema queries."""
from __future__ import annotations

from . import duck as d
from .checks import CONTENT_LIMITS, FEED_LIMITS, USER_LIMITS

DOC_CONTENT = ("doc_content AS (SELECT doc_id AS id, md5(text) AS url, string_split(text, chr(10))[1] AS title, "
               "md5(text) AS content_hash, string_split(text, chr(10))[1] || '.mp3' AS filename, "
               "CAST(NULL AS VARCHAR) AS file_path, CAST(NULL AS VARCHAR) AS voice FROM documents)")


def fk_orphans() -> str:
    return d.with_ctes(d.CONTENT_JOBS, d.FEEDS, d.USERS) + (
        "SELECT 'content.feed_id' AS relation, id AS child_id, feed_id AS parent_id FROM content_jobs "
        "WHERE feed_id IS NOT NULL AND feed_id NOT IN (SELECT id FROM feeds) "
        "UNION ALL SELECT 'content.user_id', id, user_id FROM content_jobs "
        "WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT id FROM users) "
        "UNION ALL SELECT 'feed.user_id', id, user_id FROM feeds "
        "WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT id FROM users)")


def _lengths(table: str, src: str, limits: dict[str, int]) -> list[str]:
    return [f"SELECT '{table}' AS table_name, CAST(id AS BIGINT) AS row_id, '{c}' AS column_name, "
            f"CAST(length({c}) AS BIGINT) AS length, CAST({n} AS BIGINT) AS max_length FROM {src} WHERE length({c}) > {n}"
            for c, n in limits.items()]


def length_violations() -> str:
    held = {"url", "title", "file_path", "voice"}  # the columns that the stored content fixture has
    parts = (_lengths("content", "content_jobs", {c: n for c, n in CONTENT_LIMITS.items() if c in held})
             + _lengths("doc_content", "doc_content", CONTENT_LIMITS)
             + _lengths("user", "users", {c: n for c, n in USER_LIMITS.items() if c in ("username", "email")})
             + _lengths("feed", "feeds", FEED_LIMITS))
    return d.with_ctes(d.CONTENT_JOBS, DOC_CONTENT, d.USERS, d.FEEDS) + " UNION ALL ".join(parts)


def null_url() -> str:
    return d.with_ctes(d.CONTENT_JOBS, d.FEEDS, d.FEED_ENTRIES) + (
        "SELECT 'content' AS table_name, CAST(id AS BIGINT) AS row_id, 'url' AS column_name FROM content_jobs WHERE url IS NULL "
        "UNION ALL SELECT 'feed', id, 'url' FROM feeds WHERE url IS NULL "
        "UNION ALL SELECT 'feed_entry', entry_order, 'url' FROM feed_entries WHERE nullif(link, '') IS NULL")


def schema_evolve() -> str:
    return d.with_ctes(d.CONTENT_LOG, d.CONTENT_JOBS) + (
        "SELECT 'log' AS source, id, url, is_processed, CAST(NULL AS BIGINT) AS feed_id FROM content_log "
        "UNION ALL SELECT 'jobs', id, url, is_processed, feed_id FROM content_jobs")


def unique_violations() -> str:
    def part(name: str, column: str, src: str) -> str:
        return (f"SELECT '{name}' AS column_name, {column} AS value, count(*) AS n_rows FROM {src} "
                f"WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1")
    return d.with_ctes(DOC_CONTENT, d.USERS, d.FEEDS) + " UNION ALL ".join([
        part("user.username", "username", "users"),
        part("user.email", "email", "(SELECT regexp_replace(email, '[0-9]', '', 'g') AS email FROM users)"),
        part("feed.url", "url", "feeds"), part("content.content_hash", "content_hash", "doc_content")])
