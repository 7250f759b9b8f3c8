"""Oracle SQL (DuckDB) for the feed queries."""
from __future__ import annotations

from ..constants import BADGES, FEED_BADGES
from . import duck as d
from .jobs_sql import STATUS, truthy

DUE = (f"due AS (SELECT * FROM feeds WHERE is_active AND (last_checked IS NULL OR "
       f"last_checked <= {d.NOW} - INTERVAL 30 MINUTES))")


def _top(src: str, n: int) -> str:
    return (f"top AS (SELECT feed_id, CAST(row_number() OVER (PARTITION BY feed_id ORDER BY entry_order) - 1 AS INTEGER) AS pos, "
            f"link, title, entry_order FROM {src} QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY entry_order) <= {n})")


def _new(owners: str) -> list[str]:
    return [
        f"cand AS (SELECT * FROM top WHERE {truthy('link')} AND link NOT IN (SELECT url FROM known_urls))",
        "firsts AS (SELECT link AS url, arg_min(feed_id, (feed_id, pos)) AS feed_id, arg_min(pos, (feed_id, pos)) AS pos, "
        "arg_min(title, (feed_id, pos)) AS title FROM cand GROUP BY link)",
        f"newc AS (SELECT f.feed_id, f.url, f.pos, f.title, o.user_id FROM firsts f LEFT JOIN {owners} o ON f.feed_id = o.id)",
    ]


def feed_top_entries() -> str:
    return d.with_ctes(d.FEED_ENTRIES, _top("feed_entries", 10)) + "SELECT feed_id, pos, link, title FROM top"


def feed_due() -> str:
    return d.with_ctes(d.FEEDS, DUE) + (
        f"SELECT id, url, last_checked, CAST(floor(date_diff('second', last_checked, {d.NOW}) / 60) AS BIGINT) "
        "AS minutes_since_check FROM due")


def _new_entries_ctes() -> list[str]:
    return [d.FEEDS, DUE, d.FEED_ENTRIES, d.KNOWN_URLS,
            "fe AS (SELECT * FROM feed_entries WHERE feed_id IN (SELECT id FROM due))",
            _top("fe", 10)] + _new("feeds")


def feed_new_entries() -> str:
    return d.with_ctes(*_new_entries_ctes()) + "SELECT url, feed_id, pos, title, user_id FROM newc"


def feed_refresh_all() -> str:
    return d.with_ctes(*_new_entries_ctes(), "cnt AS (SELECT feed_id, count(*) AS n FROM newc GROUP BY feed_id)") + (
        "SELECT due.id AS feed_id, coalesce(cnt.n, 0) AS n_new FROM due LEFT JOIN cnt ON due.id = cnt.feed_id")


def feed_refresh_totals() -> str:
    return f"SELECT count(*) AS n_feeds, count(CASE WHEN n_new > 0 THEN 1 END) AS n_with_new, CAST(coalesce(sum(n_new), 0) AS BIGINT) AS n_new FROM ({feed_refresh_all()})"


def feed_refresh_one() -> str:
    return d.with_ctes(d.FEEDS, d.FEED_ENTRIES, d.KNOWN_URLS,
                       "fe AS (SELECT * FROM feed_entries WHERE feed_id IN (SELECT id FROM feeds WHERE is_active))",
                       _top("fe", 10),
                       f"cand AS (SELECT * FROM top WHERE {truthy('link')} AND link NOT IN (SELECT url FROM known_urls))",
                       "per AS (SELECT feed_id, count(DISTINCT link) AS n FROM cand GROUP BY feed_id)") + (
        "SELECT f.id AS feed_id, f.is_active, CASE WHEN f.is_active THEN coalesce(per.n, 0) ELSE 0 END AS n_new "
        "FROM feeds f LEFT JOIN per ON f.id = per.feed_id")


def feed_add() -> str:
    """Feeds not held already whose document is whole; texts come from the rule that makes the documents."""
    return d.with_ctes(d.FEEDS, d.FEED_ENTRIES, d.KNOWN_URLS,
                       "added AS (SELECT id, url, user_id FROM feeds WHERE id % 4 <> 0 AND id % 11 <> 5)",
                       "fe AS (SELECT feed_id, entry_order, link, nullif(trim(title), '') AS title FROM feed_entries "
                       "WHERE feed_id IN (SELECT id FROM added))",
                       _top("fe", 5), *_new("added")) + "SELECT url, feed_id, pos, title, user_id FROM newc"


def feed_subscribe() -> str:
    return d.with_ctes(d.FEEDS, "r AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'exists' WHEN id % 11 = 5 THEN 'rejected' ELSE 'added' END AS status FROM feeds)") + (
        "SELECT id, url, status, CASE WHEN status = 'added' AND id % 4 <> 2 THEN 'Channel ' || CAST(id AS VARCHAR) END AS title, "
        "CASE WHEN status = 'added' THEN description END AS description, user_id, "
        "CASE WHEN status = 'rejected' THEN 'Could not parse feed: ' || url END AS message FROM r")


def feed_rejects() -> str:
    return d.with_ctes(d.FEED_ENTRIES) + (
        "SELECT DISTINCT feed_id, entry_order // 10 AS block FROM feed_entries WHERE (entry_order // 10) % 13 = 5")


def feed_xml_entries() -> str:
    """Entries by the rule that makes the documents; no XML is read."""
    return d.with_ctes(d.FEED_ENTRIES, "e AS (SELECT feed_id, entry_order // 10 AS block, entry_order, link, md5(title) AS title, "
                       "row_number() OVER (PARTITION BY feed_id, entry_order // 10 ORDER BY entry_order) - 1 AS pos FROM feed_entries)") + (
        "SELECT feed_id, block, true AS ok, 'Feed ' || CAST(feed_id AS VARCHAR) AS feed_title, CAST(pos AS INTEGER) AS pos, title, "
        f"nullif(link, '') AS link, {d.EPOCH} + to_minutes(entry_order) AS dated FROM e WHERE block % 13 <> 5 "
        "UNION ALL SELECT DISTINCT feed_id, block, false, NULL, NULL, NULL, NULL, NULL FROM e WHERE block % 13 = 5")


def feed_metadata_upsert() -> str:
    return d.with_ctes(d.FEEDS, DUE,
                       "r AS (SELECT id, CASE WHEN id % 4 <> 2 AND id % 11 <> 5 THEN 'Channel ' || CAST(id AS VARCHAR) END AS new_title, "
                       f"CASE WHEN id % 3 <> 1 AND id % 11 <> 5 THEN {d.EPOCH} + to_days(CAST(id AS INTEGER)) END AS new_updated FROM due)") + (
        "SELECT f.id, f.url, CASE WHEN r.id IS NOT NULL THEN coalesce(r.new_title, f.title) ELSE f.title END AS title, "
        f"CASE WHEN r.id IS NOT NULL THEN {d.NOW} ELSE f.last_checked END AS last_checked, "
        "CASE WHEN r.id IS NOT NULL THEN coalesce(r.new_updated, f.last_updated) ELSE f.last_updated END AS last_updated, "
        "CAST(CASE WHEN r.id IS NOT NULL THEN 0 ELSE f.error_count END AS INTEGER) AS error_count, f.is_active "
        "FROM feeds f LEFT JOIN r ON f.id = r.id")


def feed_error_streak() -> str:
    return d.with_ctes(d.FEED_POLLS,
                       "lo AS (SELECT feed_id, max((ts, poll_id)) AS last_ok FROM feed_polls WHERE ok GROUP BY feed_id)",
                       "s AS (SELECT p.feed_id, count(*) AS n FROM feed_polls p LEFT JOIN lo ON p.feed_id = lo.feed_id "
                       "WHERE NOT p.ok AND (lo.last_ok IS NULL OR (p.ts, p.poll_id) > lo.last_ok) GROUP BY p.feed_id)",
                       "t AS (SELECT feed_id, count(*) AS n_polls FROM feed_polls GROUP BY feed_id)") + (
        "SELECT t.feed_id, t.n_polls, coalesce(s.n, 0) AS error_count, CASE WHEN NOT (t.feed_id % 4 <> 0) THEN 'inactive' "
        "WHEN coalesce(s.n, 0) > 3 THEN 'error' ELSE 'active' END AS status FROM t LEFT JOIN s ON t.feed_id = s.feed_id")


def feed_status_counts() -> str:
    return d.with_ctes(d.FEEDS) + (
        "SELECT CASE WHEN NOT is_active THEN 'inactive' WHEN error_count > 3 THEN 'error' ELSE 'active' END AS status, count(*) AS n "
        "FROM feeds GROUP BY 1")


def feed_toggle() -> str:
    return d.with_ctes(d.FEEDS, "x AS (SELECT id, error_count, CASE WHEN id % 3 = 0 THEN NOT is_active ELSE is_active END AS a FROM feeds)") + (
        "SELECT id, a AS is_active, CASE WHEN NOT a THEN 'inactive' WHEN error_count > 3 THEN 'error' ELSE 'active' END AS status FROM x")


def feed_delete() -> str:
    return d.with_ctes(d.FEEDS, d.CONTENT_JOBS) + (
        "SELECT id, CASE WHEN feed_id IN (SELECT id FROM feeds WHERE id % 5 = 1) THEN NULL ELSE feed_id END AS feed_id "
        "FROM content_jobs")


def feed_listing() -> str:
    st = "CASE WHEN NOT is_active THEN 'inactive' WHEN error_count > 3 THEN 'error' ELSE 'active' END"
    return d.with_ctes(d.FEEDS, f"x AS (SELECT *, {st} AS st FROM feeds)") + (
        f"SELECT id, CASE WHEN {truthy('title')} THEN title ELSE 'Unnamed Feed' END AS display_title, url, "
        f"{d.label('st', FEED_BADGES)} AS badge, "
        "coalesce(strftime(last_checked, '%Y-%m-%d %H:%M'), 'Never') AS checked FROM x")


def feed_content_listing() -> str:
    badge = d.label("st", BADGES)
    return d.with_ctes(d.CONTENT_JOBS, d.FEEDS,
                       f"c AS (SELECT *, {STATUS} AS st FROM content_jobs WHERE feed_id IS NOT NULL)") + (
        f"SELECT c.id, CASE WHEN {truthy('c.title')} THEN c.title ELSE 'Untitled Post' END AS display_title, c.feed_id, "
        f"f.title AS feed_title, strftime(c.created_at, '%Y-%m-%d') AS created, {badge} AS badge "
        "FROM c LEFT JOIN feeds f ON c.feed_id = f.id ORDER BY c.created_at DESC, c.id DESC")


def feed_updated_at() -> str:
    """The dates the strings were made from; two of twelve strings are no dates and one names the day alone."""
    return (f"SELECT doc_id, source, CASE WHEN doc_id % 12 = 10 THEN date_trunc('day', {d.EPOCH} + to_minutes(doc_id)) "
            f"WHEN doc_id % 12 NOT IN (7, 11) THEN {d.EPOCH} + to_minutes(doc_id) END AS updated FROM documents")


def feed_wild_entries() -> str:
    """Entries by the rule that makes the documents; no XML is read."""
    return d.with_ctes(d.FEED_ENTRIES, "e AS (SELECT feed_id, link, title, row_number() OVER (PARTITION BY feed_id ORDER BY entry_order) - 1 AS pos FROM feed_entries)") + (
        "SELECT feed_id, feed_id % 5 <> 4 AS ok, CAST(pos AS INTEGER) AS pos, md5(title) AS title, "
        "CASE WHEN feed_id % 5 <> 2 THEN nullif(link, '') END AS link FROM e WHERE pos < 10 AND (feed_id % 5 <> 4 OR pos < 3)")
