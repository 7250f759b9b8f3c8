"""Oracle SQL (DuckDB) for the job, request, status and report queries."""
from __future__ import annotations

from ..constants import BADGES, DEFAULT_VOICE, DOWNLOAD_DEFAULT_NAME, GUEST_CONVERSION_LIMIT, URL_INVALID, URL_MISSING, VOICES
from . import duck as d
from .jobs import ADMISSION_LIMIT, BAD_URLS, BASE_URL
from .pages_sql import _extract_ctes, _speech_ctes

STATUS = ("CASE WHEN NOT is_processed AND NOT is_processing THEN 'pending' WHEN is_processing THEN 'processing' "
          "WHEN is_processed AND NOT (error IS NOT NULL AND error <> '') THEN 'completed' ELSE 'error' END")
VOICE_LIST = ", ".join(d.q(v) for v in VOICES)
AUDIO_FILE = "'static/audio/' || md5(url) || '.mp3'"
TITLE_OR_NONE = "coalesce(title, 'None')"


def truthy(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> '')"


def secure_filename(x: str) -> str:
    s = f"strip_accents({x})"
    s = rf"regexp_replace({s}, '[^\x00-\x7f]', '', 'g')"
    s = f"replace({s}, '/', ' ')"
    s = rf"regexp_replace(regexp_replace({s}, '^\s+|\s+$', '', 'g'), '\s+', '_', 'g')"
    s = f"regexp_replace({s}, '[^A-Za-z0-9_.-]', '', 'g')"
    return f"regexp_replace({s}, '^[._]+|[._]+$', '', 'g')"


def truncate_words(x: str, n: int) -> str:
    return (f"(CASE WHEN length({x}) <= {n + 5} THEN {x} "
            f"ELSE regexp_replace(substr({x}, 1, {n - 3}), ' [^ ]*$', '') || '...' END)")


def url_quote(x: str) -> str:
    return f"replace(url_encode({x}), '%2F', '/')"


def web_path(x: str) -> str:
    return f"(CASE WHEN NOT {truthy(x)} THEN NULL WHEN starts_with({x}, '/') THEN {x} ELSE '/' || {x} END)"


def prepared(u: str) -> str:
    return rf"regexp_replace(regexp_replace({u}, '^[\x00-\x20]+', ''), '[\t\r\n]', '', 'g')"


def netloc(u: str) -> str:
    return f"regexp_extract({prepared(u)}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def is_valid(u: str) -> str:
    p = prepared(u)
    net = f"regexp_extract({p}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    unb = (f"((instr({net}, '[') > 0 AND instr({net}, ']') = 0) OR "
           f"(instr({net}, ']') > 0 AND instr({net}, '[') = 0))")
    return f"coalesce(regexp_matches({p}, '^[A-Za-z][A-Za-z0-9+.-]*:') AND {net} <> '' AND NOT {unb}, false)"


def is_http(u: str) -> str:
    t = f"trim({u})"
    scheme = f"lower(regexp_extract({t}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
    net = f"regexp_extract({t}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    return f"coalesce({scheme} IN ('http', 'https') AND {net} <> '', false)"


def content_status_counts() -> str:
    return d.with_ctes(d.CONTENT_JOBS) + f"SELECT {STATUS} AS status, count(*) AS n FROM content_jobs GROUP BY 1"


def content_next_view() -> str:
    return d.with_ctes(d.CONTENT_JOBS) + (
        f"SELECT id, CASE WHEN NOT is_processed THEN 'processing' WHEN {truthy('error')} THEN 'index' "
        "ELSE 'result' END AS next_view FROM content_jobs")


def content_downloadable() -> str:
    badge = d.label("st", BADGES)
    chosen = f"CASE WHEN {truthy('title')} THEN title ELSE {d.q(DOWNLOAD_DEFAULT_NAME)} END"
    name = f"{secure_filename(chosen)} || '.mp3'"
    return d.with_ctes(d.CONTENT_JOBS, f"c AS (SELECT *, {STATUS} AS st FROM content_jobs)") + (
        f"SELECT id, is_processed AND {truthy('file_path')} AND NOT {truthy('error')} AS downloadable, "
        f"st = 'completed' AND {truthy('file_path')} AS playable, st = 'pending' AS convertible, "
        f"{badge} AS badge, {name} AS download_name FROM c")


def _cache(api: bool) -> str:
    reuse = "f.is_processed" + (f" AND NOT {truthy('f.error')}" if api else "")
    hit_action, miss_action = ("already_processed", "processing") if api else ("result", "new_job")
    return d.with_ctes(d.CONTENT_LOG, d.SUBMISSIONS,
                       "f0 AS (SELECT url, min(id) AS id FROM content_log GROUP BY url)",
                       "f AS (SELECT c.* FROM content_log c JOIN f0 USING (id))",
                       f"j AS (SELECT s.request_id, s.url, {is_valid('s.url')} AS valid, "
                       f"coalesce({reuse}, false) AS hit, f.id FROM submissions s LEFT JOIN f ON s.url = f.url)") + (
        f"SELECT request_id, url, CASE WHEN NOT valid THEN 'invalid' WHEN hit THEN '{hit_action}' "
        f"ELSE '{miss_action}' END AS action, CASE WHEN valid AND hit THEN id END AS content_id FROM j")


def request_cache_web() -> str:
    return _cache(False)


def request_cache_api() -> str:
    return _cache(True)


def request_admission() -> str:
    limit, _ = ADMISSION_LIMIT
    return d.with_ctes(d.SUBMISSIONS) + (
        "SELECT request_id, client, ts, date_trunc('day', ts) AS window_start, "
        f"row_number() OVER (PARTITION BY client, date_trunc('day', ts) ORDER BY ts, request_id) <= {limit} AS admitted "
        "FROM submissions")


def guest_quota() -> str:
    n = GUEST_CONVERSION_LIMIT
    return d.with_ctes(d.SUBMISSIONS) + (
        f"SELECT client, count(*) AS n_requests, least(count(*), {n}) AS n_allowed, count(*) > {n} AS over_quota "
        "FROM submissions GROUP BY client")


def user_conversions() -> str:
    return d.with_ctes(d.CONTENT_JOBS, d.USERS,
                       f"pu AS (SELECT user_id, count(*) AS n FROM content_jobs WHERE is_processed AND NOT {truthy('error')} "
                       "AND user_id IS NOT NULL GROUP BY user_id)") + (
        "SELECT u.id AS user_id, u.username, coalesce(pu.n, 0) AS conversion_count FROM users u "
        "LEFT JOIN pu ON u.id = pu.user_id")


def voice_resolve() -> str:
    return d.with_ctes(d.SUBMISSIONS, f"r AS (SELECT coalesce(voice, {d.q(DEFAULT_VOICE)}) AS voice_requested FROM submissions)") + (
        f"SELECT voice_requested, CASE WHEN voice_requested IN ({VOICE_LIST}) THEN voice_requested "
        f"ELSE {d.q(DEFAULT_VOICE)} END AS voice_effective, count(*) AS n_requests, "
        f"voice_requested IN ({VOICE_LIST}) AS available FROM r GROUP BY voice_requested")


def share_links() -> str:
    res = f"'{BASE_URL}/result/' || CAST(id AS VARCHAR)"
    v = f"coalesce(voice, {d.q(DEFAULT_VOICE)})"
    return d.with_ctes(d.CONTENT_JOBS) + (
        f"SELECT id, upper(substr({v}, 1, 1)) || lower(substr({v}, 2)) AS voice_label, {res} AS share_url, "
        f"'https://twitter.com/intent/tweet?url=' || {url_quote(res)} || '&text=Check out this audio version of ''' || "
        f"{url_quote(TITLE_OR_NONE)} || '''' AS twitter, "
        f"'https://www.facebook.com/sharer/sharer.php?u=' || {url_quote(res)} AS facebook, "
        f"'mailto:?subject=Listen to this blog post&body=I thought you might enjoy listening to this blog post: ' || {res} AS email FROM content_jobs")


def _page_run(extra_src: str) -> list[str]:
    return _extract_ctes() + [
        f"j AS (SELECT page_id, title, original_text, title AS t0, original_text AS o0, url, {d.voice_by('page_id')} AS voice "
        f"FROM s5{extra_src})",
    ] + _speech_ctes("j", "page_id", "t0, o0, url, voice") + ["ok AS (SELECT * FROM p5 WHERE processed_text <> '')"]


def result_card() -> str:
    prev = f"CASE WHEN {truthy('processed_text')} THEN processed_text ELSE o0 END"
    return d.with_ctes(*_page_run("")) + (
        f"SELECT page_id AS content_id, coalesce(t0, 'Blog Post Converted') AS heading, {truncate_words('url', 50)} AS url_short, "
        f"round({d.seconds('word_count')} / 60.0, 1) AS minutes, coalesce(word_count, 0) AS words, "
        f"{truncate_words(prev, 500)} AS preview, {web_path(AUDIO_FILE)} AS web_path FROM ok")


def web_status() -> str:
    return d.with_ctes(d.CONTENT_JOBS) + (
        f"SELECT id, json_object('status', {STATUS}, 'error', error, 'is_processed', is_processed)::VARCHAR AS json FROM content_jobs")


def output_paths() -> str:
    rel = "'static/audio/' || md5(url) || '.mp3'"
    return d.with_ctes(d.CONTENT_JOBS) + (
        f"SELECT id, md5(url) || '.mp3' AS output_name, {rel} AS file_path, {web_path(rel)} AS web_path, "
        f"{web_path('file_path')} AS stored_web_path FROM content_jobs")


def job_outcomes() -> str:
    pend = " WHERE page_id IN (SELECT id FROM content_jobs WHERE NOT is_processed AND NOT is_processing)"
    run = _extract_ctes() + [
        f"j AS (SELECT page_id, title, original_text, title AS t0, original_text AS o0, url FROM s5{pend})",
    ] + _speech_ctes("j", "page_id", "t0, o0, url")
    ctes = [d.CONTENT_JOBS] + run + [
        "r AS (SELECT j.page_id AS id, j.t0 AS new_title, j.o0 AS original_text, p5.processed_text, p5.word_count AS new_words, "
        "CASE WHEN coalesce(j.o0, '') = '' THEN 'Could not extract content from the URL' "
        "WHEN coalesce(p5.processed_text, '') = '' THEN 'No text provided for conversion' END AS new_error "
        "FROM j LEFT JOIN p5 ON j.page_id = p5.page_id)",
        "x AS (SELECT c.*, r.new_title, r.original_text, r.processed_text, r.new_words, r.new_error, r.id IS NOT NULL AS ran, "
        "r.id IS NOT NULL AND coalesce(r.original_text, '') <> '' AS ext, "
        "r.id IS NOT NULL AND r.new_error IS NULL AS ok FROM content_jobs c LEFT JOIN r ON c.id = r.id)",
        "y AS (SELECT id, ran OR is_processed AS is_processed, NOT ran AND is_processing AS is_processing, "
        "CASE WHEN ran THEN new_error ELSE error END AS error, CASE WHEN ext THEN new_title ELSE title END AS title, "
        "CASE WHEN ext THEN original_text END AS original_text, CASE WHEN ext THEN processed_text END AS processed_text, "
        "CASE WHEN ext THEN new_words ELSE word_count END AS word_count, "
        "CASE WHEN ext THEN md5(url || ':' || substr(original_text, 1, 1000)) END AS content_hash, "
        "CASE WHEN ok THEN 'static/audio/' || md5(url) || '.mp3' ELSE file_path END AS file_path, "
        f"CASE WHEN ok THEN {d.seconds('new_words')} ELSE duration END AS duration, "
        f"CASE WHEN ok THEN coalesce(voice, {d.q(DEFAULT_VOICE)}) ELSE voice END AS voice FROM x)",
    ]
    return d.with_ctes(*ctes) + f"SELECT *, {STATUS} AS status FROM y"


def content_marks() -> str:
    return d.with_ctes(d.CONTENT_JOBS) + (
        "SELECT id, url, 2 AS version, is_processed, true AS is_processing, error, 'processing' AS status, "
        "CASE WHEN feed_id IS NULL THEN 0 ELSE 1 END AS replaces, 'pending' AS status_before "
        "FROM content_jobs WHERE NOT is_processed AND NOT is_processing")


def content_current() -> str:
    before = d.with_ctes(d.CONTENT_JOBS) + (
        "SELECT id, url, feed_id, user_id, CASE WHEN NOT is_processed AND NOT is_processing THEN 3 "
        "WHEN feed_id IS NULL THEN 0 ELSE 1 END AS version FROM content_jobs")
    return f"SELECT b.*, o.* EXCLUDE (id) FROM ({before}) b JOIN ({job_outcomes()}) o ON b.id = o.id"


def request_parse() -> str:
    url = "'http://h' || CAST(event_id % 1000 AS VARCHAR) || '.example.com/p'"
    v = d.voice_by("event_id")
    body = (f"CASE WHEN event_id % 10 = 0 THEN '{{bad json' WHEN event_id % 9 = 0 THEN json_object('voice', {v})::VARCHAR "
            f"WHEN event_id % 7 = 0 THEN json_object('url', 'not a url')::VARCHAR "
            f"WHEN event_id % 11 = 0 THEN '{{\"url\": null}}' "
            f"ELSE json_object('url', {url}, 'voice', {v})::VARCHAR END")
    ok_json = "json_valid(body)"
    return d.with_ctes(
        d.CONTENT_LOG,
        f"b AS (SELECT event_id AS request_id, {body} AS body FROM events)",
        f"p AS (SELECT request_id, CASE WHEN {ok_json} THEN json_extract_string(body, '$.url') END AS url, "
        f"CASE WHEN {ok_json} THEN json_extract_string(body, '$.voice') END AS voice, "
        f"CASE WHEN {ok_json} THEN list_contains(json_keys(body), 'url') ELSE false END AS given FROM b)",
        f"m AS (SELECT request_id, url, given, coalesce(voice, {d.q(DEFAULT_VOICE)}) AS voice, "
        f"CASE WHEN NOT given THEN {d.q(URL_MISSING)} WHEN url IS NULL OR NOT {is_valid('url')} THEN {d.q(URL_INVALID)} END AS message FROM p)",
        "f AS (SELECT url, min(id) AS id FROM content_log GROUP BY url)",
    ) + ("SELECT m.request_id, CASE WHEN message IS NULL THEN 'ok' ELSE 'error' END AS status, message, m.url, voice, "
         "CASE WHEN message IS NULL THEN f.id END AS content_id FROM m LEFT JOIN f ON m.url = f.url")


def request_form() -> str:
    """The fields by the rule that makes the bodies; no body is read."""
    url = "'http://h' || CAST(event_id % 1000 AS VARCHAR) || '.example.com/p'"
    v = d.voice_by("event_id")
    kind = ("CASE WHEN event_id % 10 = 0 THEN 'corrupt' WHEN event_id % 9 = 0 THEN 'bare' WHEN event_id % 7 = 0 THEN 'bad' "
            "WHEN event_id % 11 = 0 THEN 'empty' WHEN event_id % 13 = 0 THEN 'twice' ELSE 'full' END")
    return (f"WITH r AS (SELECT event_id, {kind} AS kind, {url} AS u, {v} AS v FROM events) "
            "SELECT event_id AS request_id, CASE WHEN kind = 'corrupt' THEN 'corrupt' WHEN kind IN ('twice', 'full') THEN 'accepted' ELSE 'rejected' END AS status, "
            "CASE kind WHEN 'bad' THEN 'not a url' WHEN 'empty' THEN '' WHEN 'twice' THEN u WHEN 'full' THEN u END AS url, "
            f"CASE kind WHEN 'corrupt' THEN NULL WHEN 'bad' THEN 'x' WHEN 'bare' THEN coalesce(v, '') WHEN 'full' THEN coalesce(v, '') "
            f"ELSE {d.q(DEFAULT_VOICE)} END AS voice, "
            "CASE WHEN kind IN ('twice', 'full') THEN 'na me & mé 50% ' || CAST(event_id AS VARCHAR) END AS note, "
            "CASE WHEN kind = 'corrupt' THEN 'no form at all' END AS corrupt_record FROM r")


def url_domain_counts() -> str:
    return f"SELECT {netloc('url')} AS domain, count(*) AS n_pages FROM pages GROUP BY 1"


def url_validate() -> str:
    vals = ", ".join(f"({-(i + 1)}, {d.q(u)})" for i, u in enumerate(BAD_URLS))
    return d.with_ctes(f"u AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM (VALUES {vals}) t(page_id, url))") + (
        f"SELECT page_id, url, {netloc('url')} AS netloc, {is_valid('url')} AS valid, {is_http('url')} AS valid_http, "
        r"coalesce(regexp_matches(url, '^https?://.+\..+'), false) AS valid_pattern FROM u")


def status_json() -> str:
    audio = f"'{BASE_URL}/download/' || CAST(id AS VARCHAR)"
    return d.with_ctes(d.CONTENT_JOBS, f"c AS (SELECT *, {STATUS} AS st FROM content_jobs)") + (
        f"SELECT id, CASE WHEN is_processed AND NOT {truthy('error')} THEN "
        f"json_object('status', st, 'content_id', id, 'audio_url', {audio}, 'title', title, 'duration', duration, "
        f"'word_count', word_count)::VARCHAR "
        f"WHEN is_processed AND {truthy('error')} THEN json_object('status', st, 'content_id', id, 'error', error)::VARCHAR "
        "ELSE json_object('status', st, 'content_id', id)::VARCHAR END AS json FROM c")


def content_lookup() -> str:
    return d.with_ctes(d.CONTENT_JOBS, "r AS (SELECT event_id AS request_id, event_id % 300 AS content_id FROM events)") + (
        "SELECT r.request_id, r.content_id, c.id IS NOT NULL AS found, "
        f"CASE WHEN c.id IS NOT NULL THEN {STATUS} ELSE 'not_found' END AS status "
        "FROM r LEFT JOIN content_jobs c ON r.content_id = c.id")


def user_overview() -> str:
    return d.with_ctes(d.CONTENT_JOBS, d.FEEDS, d.USERS,
                       f"pc AS (SELECT user_id, count(*) AS n_contents, count(CASE WHEN is_processed AND NOT {truthy('error')} "
                       "THEN 1 END) AS n_completed FROM content_jobs WHERE user_id IS NOT NULL GROUP BY user_id)",
                       "pf AS (SELECT user_id, count(*) AS n_feeds FROM feeds GROUP BY user_id)") + (
        "SELECT u.id AS user_id, u.username, coalesce(pc.n_contents, 0) AS n_contents, "
        "coalesce(pc.n_completed, 0) AS n_completed, coalesce(pf.n_feeds, 0) AS n_feeds "
        "FROM users u LEFT JOIN pc ON u.id = pc.user_id LEFT JOIN pf ON u.id = pf.user_id")


def quota_window_counts() -> str:
    from ..constants import RATE_API_SUBMIT, RATE_DEFAULT, RATE_WEB_SUBMIT
    parts = []
    for name, (limit, period) in (("web", RATE_WEB_SUBMIT), ("api", RATE_API_SUBMIT), ("default", RATE_DEFAULT)):
        unit = period.split()[1]  # "1 minute" -> minute
        parts.append(
            f"SELECT '{name}' AS ceiling, client, date_trunc('{unit}', ts) AS window_start, count(*) AS n_requests, "
            f"least(count(*), {limit}) AS n_admitted, greatest(count(*) - {limit}, 0) AS n_rejected "
            f"FROM submissions GROUP BY client, date_trunc('{unit}', ts)")
    return d.with_ctes(d.SUBMISSIONS) + " UNION ALL ".join(parts)


def quota_bursts() -> str:
    from ..constants import RATE_ADD_FEED
    n = RATE_ADD_FEED[0]
    return d.with_ctes(d.SUBMISSIONS) + (
        f"SELECT url AS client, date_trunc('year', ts) AS window_start, count(*) AS n_requests, least(count(*), {n}) AS n_admitted, "
        f"greatest(count(*) - {n}, 0) AS n_rejected FROM submissions GROUP BY url, date_trunc('year', ts)")
