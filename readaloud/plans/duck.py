"""DuckDB SQL restatements of the column functions, for the oracle queries.

Each builder takes a SQL expression (normally a plain column name from the
previous CTE) and returns a SQL expression. DuckDB uses RE2, which has no
look-around, so the forms differ from the Spark ones while meaning the same
on the test data (ASCII whitespace only).
"""
from __future__ import annotations


from ..constants import (ABBREVIATIONS, BOILERPLATE_TAGS, DEFAULT_VOICE, EMAIL_PLACEHOLDER,
                         EXTRACT_ERROR, FIXTURE_EPOCH, FIXTURE_NOW, MAX_CHUNK_CHARS,
                         PARAGRAPH_SPLIT_CHARS, VOICES)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def label(status: str, labels: dict[str, str]) -> str:
    *known, (_, rest) = labels.items()
    return "CASE " + " ".join(f"WHEN {status} = {q(name)} THEN {q(text)}" for name, text in known) + f" ELSE {q(rest)} END"


TAG_RUN = (r"(?s)(?:<(?:[A-Za-z][^\s/>]*(?:" + '"[^"]*"' + r"|'[^']*'|[^'" + '"' + r">])*"
           r"|/[A-Za-z][^>]*|!--.*?--|![^>]*|\?[^>]*)>)+")
ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"
ATTRS = r"(?:" + '"[^"]*"' + r"|'[^']*'|[^'" + '"' + r">])*"


def _entity_map() -> str:
    from ..functions.html import _entity_pairs
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in _entity_pairs()) + "}"


def _cp1252_map() -> str:
    from ..functions.html import _cp1252_pairs
    return "MAP {" + ", ".join(f"{k}: {q(v)}" for k, v in _cp1252_pairs()) + "}"


def decode_one(e: str) -> str:
    hexd = f"regexp_extract({e}, '^&#[xX]0*([0-9a-fA-F]*);?$', 1)"
    decd = f"regexp_extract({e}, '^&#0*([0-9]*);?$', 1)"
    cp = (f"coalesce(CASE WHEN lower(substr({e}, 1, 3)) = '&#x' THEN CASE WHEN length({hexd}) <= 6 THEN TRY_CAST('0x' || {hexd} AS BIGINT) END "
          f"WHEN length({decd}) <= 7 THEN TRY_CAST({decd} AS BIGINT) END, 0)")
    num = (f"coalesce(({_cp1252_map()})[{cp}], CASE WHEN {cp} > 0 AND {cp} <= 1114111 AND NOT ({cp} BETWEEN 55296 AND 57343) "
           f"THEN chr({cp}::INTEGER) ELSE chr(65533) END)")
    name = f"regexp_extract({e}, '^&([A-Za-z][A-Za-z0-9]*);?$', 1)"
    return f"(CASE WHEN {name} <> '' THEN coalesce(({_entity_map()})[{name}], {e}) ELSE {num} END)"


def decode_entities(x: str) -> str:
    parts = f"regexp_split_to_array({x}, {q(ENTITY)})"
    ents = f"regexp_extract_all({x}, {q(ENTITY)})"
    body = (f"array_to_string(list_transform(range(1, len({parts}) + 1), "
            f"lambda i: {parts}[i] || CASE WHEN i <= len({ents}) THEN {decode_one(ents + '[i]')} ELSE '' END), '')")
    return f"(CASE WHEN instr({x}, '&') > 0 THEN {body} ELSE {x} END)"


def drop_raw_text(x: str) -> str:
    """Comments and raw-text elements in one pass."""
    parts = ["<!--.*?(?:-->|$)"] + [rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|$)" for t in ("script", "style", "template")]
    return f"regexp_replace({x}, {q('(?is)' + '|'.join(parts))}, '<!---->', 'g')"


def drop_elements(x: str, tags=BOILERPLATE_TAGS) -> str:
    """For elements that are closed and not nested in one of their own name, as in the test pages."""
    out = drop_raw_text(x)
    for t in tags:
        if t not in ("script", "style"):
            out = f"regexp_replace({out}, {q(rf'(?is)<{t}\b[^>]*>.*?</{t}\s*>')}, '<!---->', 'g')"
    return out


def markup_to_lines(x: str) -> str:
    """html_to_text before entity decoding (decode in a later CTE step)."""
    s = drop_raw_text(x)
    s = f"regexp_replace({s}, {q(TAG_RUN)}, chr(2), 'g')"
    s = f"regexp_replace({s}, '^' || chr(2) || '|' || chr(2) || '$', '', 'g')"
    return f"replace({s}, chr(2), chr(10))"


def title_inner(h: str) -> str:
    return f"regexp_extract({h}, {q(r'(?is)<title\b[^>]*>(.*?)</title\s*>')}, 1)"


def title_from(h: str, inner: str) -> str:
    return (f"(CASE WHEN NOT regexp_matches({h}, '(?i)<title\\b') THEN NULL "
            f"WHEN {inner} = '' OR instr({inner}, '<') > 0 THEN NULL ELSE {decode_entities(inner)} END)")


def balanced_take(rest: str, tag: str) -> str:
    marked = f"regexp_replace({rest}, {q('(?i)(</?' + tag + r'\b)')}, chr(3) || '\\1', 'g')"
    pieces = f"string_split({marked}, chr(3))"
    st = (f"list_reduce(list_slice({pieces}, 2, len({pieces})), lambda s, p: "
          f"CASE WHEN s.k > 0 THEN {{'d': s.d, 'i': s.i + 1, 'k': s.k}} ELSE "
          f"{{'d': s.d + CASE WHEN starts_with(p, '</') THEN -1 ELSE 1 END, 'i': s.i + 1, "
          f"'k': CASE WHEN s.d + CASE WHEN starts_with(p, '</') THEN -1 ELSE 1 END = 0 THEN s.i + 1 ELSE 0 END}} END, "
          f"{{'d': 1, 'i': 1, 'k': 0}})")
    return (f"array_to_string(list_slice({pieces}, 1, CASE WHEN ({st}).k > 0 THEN ({st}).k - 1 "
            f"ELSE len({pieces}) END), '')")


def element_inner(h: str, tag: str) -> str:
    start = rf"(?is)<{tag}\b{ATTRS}>"
    rest = f"regexp_extract({h}, {q(start + '(.*)$')}, 1)"
    return f"(CASE WHEN regexp_matches({h}, {q(start)}) THEN {balanced_take(rest, tag)} END)"


def element_by_id_inner(h: str) -> str:
    # Only the first candidate shape is restated (the test pages never reach it).
    idp = "content|main|article"
    start = (r"(?is)<([A-Za-z][A-Za-z0-9]*)\s(?:[^>]*?\s)?id\s*=\s*(?:" + '"[^"]*(?:' + idp + ')[^"]*"'
             + r"|'[^']*(?:" + idp + r")[^']*'|[^\s" + '"' + r"'>]*(?:" + idp + r")[^\s>]*)" + ATTRS + ">")
    return (f"(CASE WHEN regexp_matches({h}, {q(start)}) THEN "
            f"regexp_extract({h}, {q(start + '(.*?)</')} , 2) END)")


def structural_main(h: str) -> str:
    return f"coalesce({element_inner(h, 'article')}, {element_inner(h, 'main')}, {element_by_id_inner(h)}, {h})"


def body_inner(h: str) -> str:
    return f"coalesce({element_inner(h, 'body')}, {h})"


# --- text ------------------------------------------------------------------

def strip_ws(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse_blank_lines(x: str) -> str:
    return rf"regexp_replace({x}, '\n\s*\n', chr(10) || chr(10), 'g')"


def redact_emails(x: str) -> str:
    return rf"regexp_replace({x}, '[\pL\pN_.-]+@[\pL\pN_.-]+\.[\pL\pN_]+', {q(EMAIL_PLACEHOLDER)}, 'g')"


def split_sentences(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def pack(sentences: str, limit: int, strict: bool, skip_empty: bool) -> str:
    op = "<" if strict else "<="
    closed = f"list_append(s.out, {strip_ws('s.cur')})"
    if skip_empty:
        closed = f"CASE WHEN s.cur = '' THEN s.out ELSE {closed} END"
    st = (f"list_reduce({sentences}, lambda s, x: CASE WHEN length(s.cur) + length(x) {op} {limit} "
          f"THEN {{'out': s.out, 'cur': s.cur || x || ' '}} ELSE {{'out': {closed}, 'cur': x || ' '}} END, "
          f"{{'out': []::VARCHAR[], 'cur': ''}})")
    return (f"(CASE WHEN ({st}).cur <> '' THEN list_append(({st}).out, {strip_ws(f'({st}).cur')}) "
            f"ELSE ({st}).out END)")


def clean_content(x: str) -> str:
    t = redact_emails(collapse_blank_lines(x))
    paras = f"string_split({t}, chr(10) || chr(10))"
    body = (f"array_to_string(flatten(list_transform({paras}, lambda p: CASE WHEN length(p) > {PARAGRAPH_SPLIT_CHARS} "
            f"THEN {pack(split_sentences('p'), PARAGRAPH_SPLIT_CHARS, True, False)} ELSE [p] END)), chr(10) || chr(10))")
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE {body} END)"


def strip_urls(x: str) -> str:
    return rf"regexp_replace({x}, 'https?://\S+', '', 'g')"


def basic_clean_text(x: str) -> str:
    """Steps after markup-to-text (decode first in an earlier CTE)."""
    t = strip_urls(x)
    t = collapse_blank_lines(t)
    t = rf"regexp_replace({t}, '\s+', ' ', 'g')"
    t = rf"regexp_replace({t}, '([.!?])\s*', '\1 ', 'g')"
    return strip_ws(t)


def expand_abbreviations(x: str) -> str:
    out = x
    for abbr, spoken in ABBREVIATIONS:
        pat = r"(^|[^\pL\pN_])" + abbr.replace(".", r"\.")
        out = f"regexp_replace({out}, {q(pat)}, '\\1' || {q(spoken)}, 'g')"
    return out


def speak_dates(x: str) -> str:
    return rf"regexp_replace({x}, '\b(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})\b', '\1 \2 \3', 'g')"


def speak_times(x: str) -> str:
    return rf"regexp_replace({x}, '\b(\d{{1,2}}):(\d{{2}})\b', '\1 \2', 'g')"


def insert_pauses(x: str) -> str:
    return f"replace({x}, chr(10) || chr(10), '.' || chr(10) || chr(10))"


def format_for_speech(x: str) -> str:
    return insert_pauses(speak_times(speak_dates(expand_abbreviations(x))))


def prefix_title(title: str, text: str) -> str:
    return f"(CASE WHEN {title} IS NOT NULL AND {title} <> '' THEN {title} || '.' || chr(10) || chr(10) || {text} ELSE {text} END)"


def word_count(x: str) -> str:
    return rf"CAST(coalesce(len(regexp_extract_all({x}, '\S+')), 0) AS BIGINT)"


def chunk_text(x: str, limit: int = MAX_CHUNK_CHARS) -> str:
    return f"(CASE WHEN length({x}) <= {limit} THEN [{x}] ELSE {pack(split_sentences(x), limit, False, True)} END)"


def seconds(words: str) -> str:
    return f"(CAST({words} AS DOUBLE) / 150.0 * 60.0)"


def effective_voice(v: str) -> str:
    lst = ", ".join(q(x) for x in VOICES)
    return f"(CASE WHEN {v} IN ({lst}) THEN {v} ELSE {q(DEFAULT_VOICE)} END)"


def voice_by(k: str) -> str:
    whens = " ".join(f"WHEN {k} % 8 = {i} THEN {q(v)}" for i, v in enumerate(VOICES))
    return f"(CASE {whens} WHEN {k} % 8 = 6 THEN 'robot' ELSE NULL END)"


def job_flags(k: str) -> str:
    return (f"({k} % 7 = 0) AS is_processing, ({k} % 3 <> 0) AS is_processed, "
            f"(CASE WHEN {k} % 11 = 0 THEN {q(EXTRACT_ERROR)} WHEN {k} % 13 = 0 THEN '' ELSE NULL END) AS error")


NOW = f"TIMESTAMP {q(FIXTURE_NOW)}"
EPOCH = f"TIMESTAMP {q(FIXTURE_EPOCH)}"

# --- fixture CTEs (same rules as sources.fixtures) ---------------------------

CONTENT_JOBS = f"""content_jobs AS (
  SELECT page_id AS id, url,
    CASE WHEN page_id % 19 = 0 THEN '' WHEN page_id % 4 = 0 THEN NULL
         ELSE 'Post ' || CAST(page_id AS VARCHAR) || ': ' || url END AS title,
    CAST(length(url) * 50 + page_id % 100 AS BIGINT) AS word_count,
    CASE WHEN page_id % 17 = 0 THEN NULL ELSE 'static/audio/' || md5(url) || '.mp3' END AS file_path,
    CAST(length(url) * 50 + page_id % 100 AS DOUBLE) / 150.0 * 60.0 AS duration,
    {voice_by('page_id')} AS voice,
    CASE WHEN page_id % 2 = 0 THEN CAST(page_id % 23 AS BIGINT) END AS feed_id,
    {EPOCH} + to_minutes(CAST(page_id AS BIGINT)) AS created_at,
    CASE WHEN page_id % 5 <> 0 THEN CAST(page_id % 200 + 1 AS BIGINT) END AS user_id,
    {job_flags('page_id')}
  FROM pages)"""

CONTENT_LOG = f"""content_log AS (
  SELECT event_id AS id, 'http://h' || CAST(event_id % 1000 AS VARCHAR) || '.example.com/p' AS url,
    {job_flags('event_id')}
  FROM events WHERE event_type IN ('view', 'purchase'))"""

SUBMISSIONS = f"""submissions AS (
  SELECT event_id AS request_id, user_id AS client,
    'http://h' || CAST(event_id % 1000 AS VARCHAR) || '.example.com/p' AS url,
    {voice_by('event_id')} AS voice, ts
  FROM events)"""

FEEDS = f"""feeds AS (
  SELECT id,
    'https://feeds.example.com/' || source || '.xml' AS url,
    CASE WHEN id % 6 = 0 THEN NULL ELSE 'Feed ' || source END AS title,
    'Articles from ' || source AS description,
    CASE WHEN id % 5 = 0 THEN NULL ELSE {NOW} - to_minutes(id * 7) END AS last_checked,
    CASE WHEN id % 3 = 0 THEN NULL ELSE {NOW} - to_hours(id) END AS last_updated,
    CAST(id % 6 AS INTEGER) AS error_count,
    (id % 4 <> 0) AS is_active,
    {EPOCH} + to_hours(id) AS created_at,
    CAST(id % 7 + 1 AS BIGINT) AS user_id
  FROM (SELECT DISTINCT source, TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS id FROM documents))"""

FEED_ENTRIES = """feed_entries AS (
  SELECT TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS feed_id, doc_id AS entry_order,
    CASE WHEN doc_id % 97 = 0 THEN '' ELSE md5(text) END AS link,
    string_split(text, chr(10))[1] AS title
  FROM documents)"""

KNOWN_URLS = """known_urls AS (SELECT md5(text) AS url FROM documents WHERE doc_id % 5 = 0)"""

FEED_POLLS = """feed_polls AS (
  SELECT user_id AS feed_id, ts, event_id AS poll_id, (event_type <> 'error') AS ok FROM events)"""

USERS = """users AS (
  SELECT c_custkey AS id, c_name AS username,
    lower(replace(c_name, '#', '.')) || '@example.com' AS email FROM customer)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
