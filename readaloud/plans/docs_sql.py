"""Oracle SQL (DuckDB) for the document queries."""
from __future__ import annotations

from . import duck as d
from .docs import INJECT_HEAD, INJECT_TAIL
from .pages_sql import _explode, _speech_ctes, manifest_select

DOCS = (f"docs AS (SELECT doc_id, text || {d.q(INJECT_HEAD)} || CAST(doc_id AS VARCHAR) || {d.q(INJECT_TAIL)} AS text, "
        "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE string_split(text, chr(10))[1] END AS title "
        "FROM documents)")


def _scalar(expr_of) -> callable:
    def sql() -> str:
        return d.with_ctes(DOCS) + f"SELECT doc_id, {expr_of('text')} AS text FROM docs"
    return sql


doc_collapse_blank_lines = _scalar(d.collapse_blank_lines)
doc_strip_urls = _scalar(d.strip_urls)
doc_expand_abbreviations = _scalar(d.expand_abbreviations)
doc_speak_dates_times = _scalar(lambda x: d.speak_times(d.speak_dates(x)))
doc_insert_pauses = _scalar(lambda x: d.insert_pauses(d.collapse_blank_lines(x)))
doc_clean_content = _scalar(d.clean_content)


def doc_basic_clean() -> str:
    return d.with_ctes(DOCS, f"b1 AS (SELECT doc_id, {d.markup_to_lines('text')} AS l FROM docs)",
                       f"b2 AS (SELECT doc_id, {d.decode_entities('l')} AS t FROM b1)") + \
        f"SELECT doc_id, {d.basic_clean_text('t')} AS text FROM b2"


def doc_redact_emails() -> str:
    return f"SELECT doc_id, {d.redact_emails('text')} AS text FROM documents"


def doc_paragraphs() -> str:
    t = d.redact_emails(d.collapse_blank_lines("text"))
    paras = f"string_split({t}, chr(10) || chr(10))"
    packed = (f"flatten(list_transform({paras}, lambda p: CASE WHEN length(p) > 1000 "
              f"THEN {d.pack(d.split_sentences('p'), 1000, True, False)} ELSE [p] END))")
    return d.with_ctes(DOCS, f"x AS (SELECT doc_id, {packed} AS ps FROM docs)",
                       "y AS (SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS BIGINT) AS para_index, "
                       "unnest(ps) AS paragraph FROM x)") + \
        "SELECT doc_id, para_index, paragraph, CAST(length(paragraph) AS BIGINT) AS n_chars FROM y"


def _processed() -> list[str]:
    return [DOCS,
            f"c1 AS (SELECT doc_id, title, {d.clean_content('text')} AS original_text, "
            f"{d.voice_by('doc_id')} AS voice FROM docs)"] + _speech_ctes("c1", "doc_id", "voice")


def doc_format_for_speech() -> str:
    return d.with_ctes(*_processed()) + "SELECT doc_id, processed_text FROM p5"


def doc_word_count() -> str:
    return d.with_ctes(*_processed()) + f"SELECT doc_id, word_count, {d.seconds('word_count')} AS est_seconds FROM p5"


def doc_sentences() -> str:
    return d.with_ctes(*_processed(), f"s AS (SELECT doc_id, {d.split_sentences('processed_text')} AS ss FROM p5)") + \
        ("SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS BIGINT) AS sentence_index, "
         "unnest(ss) AS sentence FROM s")


def _chunk_rows() -> list[str]:
    return _processed() + [
        "cr AS (SELECT doc_id, CAST(generate_subscripts(chunks, 1) - 1 AS BIGINT) AS chunk_index, "
        "unnest(chunks) AS chunk FROM p5)"]


def doc_chunks() -> str:
    return d.with_ctes(*_chunk_rows()) + \
        "SELECT doc_id, chunk_index, chunk, CAST(length(chunk) AS BIGINT) AS n_chars FROM cr"


def doc_chunk_distribution() -> str:
    return d.with_ctes(*_processed()) + (
        "SELECT CAST(len(chunks) AS BIGINT) AS n_chunks, len(chunks) > 1 AS is_multipart, "
        "count(*) AS n_docs FROM p5 GROUP BY 1, 2")


def doc_reassemble() -> str:
    return d.with_ctes(*_chunk_rows()) + (
        "SELECT doc_id, string_agg(chunk, ' ' ORDER BY chunk_index) AS text, count(*) AS n_chunks "
        "FROM cr GROUP BY doc_id")


def chunk_timeline() -> str:
    return d.with_ctes(*_processed(), *_explode("p5", "doc_id", "word_count")) + (
        f"SELECT doc_id, chunk_index, {d.seconds('w0')} AS start_offset, "
        f"{d.seconds('w0')} + {d.seconds('w')} AS end_offset, {d.seconds('word_count')} AS total_seconds FROM e3")


def doc_synthesis_manifest() -> str:
    return d.with_ctes(*_processed(), "p6 AS (SELECT * FROM p5 WHERE processed_text <> '')",
                       *_explode("p6", "doc_id", "voice")) + manifest_select("doc_id")


def _hash_cte() -> str:
    return (f"h AS (SELECT doc_id, md5(text) AS url, {d.clean_content('text')} AS c FROM documents)")


def content_hash() -> str:
    return d.with_ctes(_hash_cte()) + (
        "SELECT doc_id, url, CASE WHEN c IS NULL OR c = '' THEN NULL "
        "ELSE md5(url || ':' || substr(c, 1, 1000)) END AS content_hash FROM h")


def content_hash_violations() -> str:
    return d.with_ctes(_hash_cte(), "h2 AS (SELECT doc_id, CASE WHEN c IS NULL OR c = '' THEN NULL "
                       "ELSE md5(url || ':' || substr(c, 1, 1000)) END AS content_hash FROM h)") + (
        "SELECT content_hash, count(*) AS n_rows, min(doc_id) AS first_doc_id FROM h2 WHERE content_hash IS NOT NULL "
        "GROUP BY content_hash HAVING count(*) > 1")


def doc_redact_edge() -> str:
    """The expected ends are written out; the rule is only run on the texts themselves."""
    from .docs import EDGE_ADDRESSES
    whens = " ".join(f"WHEN {i} THEN replace({d.q(want)}, '{{k}}', CAST(doc_id AS VARCHAR))" for i, (_, want) in enumerate(EDGE_ADDRESSES))
    return (f"SELECT doc_id, {d.redact_emails('text')} || ' ' || CASE doc_id % {len(EDGE_ADDRESSES)} {whens} END AS text FROM documents")


def _sentence_ctes() -> list[str]:
    """The learned model: counts, likelihood ratios, thresholds."""
    outer = "\"'()[]{}«»“”‘’*"
    strip = f"trim(w, {d.q(outer)})"
    xlny = lambda x, y: f"CASE WHEN {x} = 0 THEN 0 ELSE {x} * ln({y}) END"
    like = lambda h, n, p: f"({xlny(h, p)} + {xlny(f'({n} - {h})', f'(1 - {p})')})"

    def ratio(a: str, b: str, ab: str, n: str) -> str:
        p, p1, p2 = f"({b} / {n})", f"({ab} / {a})", f"(({b} - {ab}) / ({n} - {a}))"
        rest = f"({b} - {ab})"
        return f"2 * ({like(ab, a, p1)} + {like(rest, f'({n} - {a})', p2)} - {like(ab, a, p)} - {like(rest, f'({n} - {a})', p)})"
    score = (f"2 * ({like('dots', 'n', '0.99::DOUBLE')} - {like('dots', 'n', '(all_dots / all_n)')}) * exp(-bare) "
             "* (length(type) - bare + 1) * pow(bare, -(n - dots))")
    return [
        DOCS,
        rf"w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: "
        rf"{{'type': lower(regexp_replace({strip}, '[.!?]$', '')), 'dot': ends_with({strip}, '.'), 'ends': regexp_matches({strip}, '[.!?]$')}}), "
        "lambda t: t.type <> '') AS ts FROM docs)",
        "u AS (SELECT unnest(ts) AS t, unnest(list_transform(list_append(list_slice(ts, 2, len(ts)), NULL), lambda x: x.type)) AS next FROM w WHERE len(ts) > 0)",
        "pairs AS (SELECT t.type AS type, t.dot AS dot, t.ends AS ends, next, count(*)::DOUBLE AS n FROM u GROUP BY ALL)",
        "types AS (SELECT type, sum(n) AS n, sum(CASE WHEN dot THEN n ELSE 0 END) AS dots, "
        "length(replace(type, '.', ''))::DOUBLE AS bare FROM pairs GROUP BY type)",
        "total AS (SELECT sum(n) AS all_n, sum(dots) AS all_dots FROM types)",
        rf"abbr AS (SELECT type, {score} AS score FROM types, total WHERE dots > 0 AND dots < all_dots AND regexp_matches(type, '^\pL[\pL.]*$') AND all_dots < all_n "
        "AND score >= 0.3)",
        "ends AS (SELECT * FROM pairs WHERE ends AND next IS NOT NULL AND type NOT IN (SELECT type FROM abbr))",
        "foll AS (SELECT next AS type, sum(n) AS ab FROM ends GROUP BY next)",
        "brk AS (SELECT sum(n) AS a FROM ends)",
        f"starters AS (SELECT foll.type, {ratio('a', 'types.n', 'ab', 'all_n')} AS score FROM foll JOIN types ON foll.type = types.type, brk, total "
        r"WHERE ab / a > types.n / all_n AND a < all_n AND regexp_matches(foll.type, '^\pL[\pL.]*$') AND score >= 30)",
        r"duo AS (SELECT type, next, sum(n) AS ab FROM pairs WHERE dot AND regexp_matches(next, '^\pL[\pL.]*$') "
        r"AND regexp_matches(type, '^(?:\p{Nd}+|\pL)$') GROUP BY ALL HAVING sum(n) > 1)",
        f"colloc AS (SELECT duo.type, next, {ratio('x.n', 'y.n', 'ab', 'all_n')} AS score FROM duo JOIN types x ON duo.type = x.type JOIN types y ON duo.next = y.type, total "
        "WHERE ab / x.n > y.n / all_n AND x.n < all_n AND score >= 7.88)",
        "model AS (SELECT 'abbreviation' AS kind, type, NULL AS follower, score FROM abbr UNION ALL SELECT 'starter', type, NULL, score FROM starters "
        "UNION ALL SELECT 'collocation', type, next, score FROM colloc)",
    ]


def sentence_types() -> str:
    return d.with_ctes(*_sentence_ctes()) + "SELECT kind, type, follower, round(score, 4) AS score FROM model"


def doc_sentences_learned() -> str:
    outer = d.q("\"'()[]{}«»“”‘’*")
    ctes = _sentence_ctes() + [
        rf"p1 AS (SELECT doc_id, {d.split_sentences('text')} AS ps, list_prepend('', regexp_extract_all(text, '[.!?](\s+)', 1)) AS gs FROM docs WHERE text IS NOT NULL)",
        "p2 AS (SELECT doc_id, unnest(ps) AS p, unnest(gs) AS g, generate_subscripts(ps, 1) AS i FROM p1)",
        "p3 AS (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p2)",
        rf"p4 AS (SELECT *, trim(regexp_split_to_array(before, '\s+')[-1], {outer}) AS l, trim(regexp_split_to_array(p, '\s+')[1], {outer}) AS r FROM p3)",
        r"p5 AS (SELECT *, CASE WHEN ends_with(l, '.') THEN lower(regexp_replace(l, '\.$', '')) ELSE '' END AS lt, lower(regexp_replace(r, '[.!?]$', '')) AS rt FROM p4)",
        r"p6 AS (SELECT doc_id, p, g, i, CASE WHEN i > 1 AND lt <> '' AND ((lt IN (SELECT type FROM abbr) AND NOT (regexp_matches(r, '^\p{Lu}') "
        "AND rt IN (SELECT type FROM starters))) OR (lt, rt) IN (SELECT (type, next) FROM colloc)) THEN 0 ELSE 1 END AS opens FROM p5)",
        "p7 AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM p6)",
        "p8 AS (SELECT doc_id, CAST(k AS BIGINT) AS sentence_index, string_agg(CASE WHEN opens = 1 THEN p ELSE g || p END, '' ORDER BY i) AS s FROM p7 GROUP BY ALL)",
    ]
    return d.with_ctes(*ctes) + "SELECT doc_id, sentence_index, CAST(length(s) AS BIGINT) AS n_chars, md5(s) AS md5 FROM p8"
