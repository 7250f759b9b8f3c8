"""Oracle SQL (DuckDB) for the page queries."""
from __future__ import annotations

from ..constants import EXTRACT_ERROR
from . import duck as d


def _extract_ctes() -> list[str]:
    return [
        f"s1 AS (SELECT page_id, url, {d.drop_elements('html')} AS stripped FROM pages)",
        f"s2 AS (SELECT page_id, url, stripped, {d.title_inner('stripped')} AS t_inner, "
        f"{d.structural_main('stripped')} AS main_html FROM s1)",
        f"s3 AS (SELECT page_id, url, {d.title_from('stripped', 't_inner')} AS title, "
        f"{d.markup_to_lines('main_html')} AS lines FROM s2)",
        f"s4 AS (SELECT page_id, url, title, {d.decode_entities('lines')} AS raw_text FROM s3)",
        f"s5 AS (SELECT page_id, url, title, raw_text, {d.clean_content('raw_text')} AS original_text FROM s4)",
    ]


def _speech_ctes(src: str, key: str, extra: str = "") -> list[str]:
    """original_text/title in ``src`` -> processed_text, word_count, chunks."""
    ex = f", {extra}" if extra else ""
    return [
        f"p1 AS (SELECT {key}, title, original_text{ex}, {d.markup_to_lines('original_text')} AS l2 "
        f"FROM {src} WHERE coalesce(original_text, '') <> '')",
        f"p2 AS (SELECT {key}, title{ex}, {d.decode_entities('l2')} AS t2 FROM p1)",
        f"p3 AS (SELECT {key}, title{ex}, {d.basic_clean_text('t2')} AS clean_text FROM p2)",
        f"p4 AS (SELECT {key}{ex}, {d.prefix_title('title', d.format_for_speech('clean_text'))} AS processed_text FROM p3)",
        f"p5 AS (SELECT {key}{ex}, processed_text, {d.word_count('processed_text')} AS word_count, "
        f"{d.chunk_text('processed_text')} AS chunks FROM p4)",
    ]


def _explode(src: str, key: str, extra: str = "") -> list[str]:
    ex = f", {extra}" if extra else ""
    return [
        f"e1 AS (SELECT {key}{ex}, processed_text, len(chunks) AS n, "
        f"CAST(generate_subscripts(chunks, 1) - 1 AS BIGINT) AS chunk_index, unnest(chunks) AS chunk FROM {src})",
        f"e2 AS (SELECT *, {d.word_count('chunk')} AS w FROM e1)",
        f"e3 AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY {key} ORDER BY chunk_index "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0, "
        f"CASE WHEN n = 1 THEN processed_text ELSE chunk END AS input FROM e2)",
    ]


def manifest_select(key: str, out_key: str = "content_id") -> str:
    return (f"SELECT {key} AS {out_key}, chunk_index, 'tts-1' AS model, voice AS voice_requested, "
            f"{d.effective_voice('voice')} AS voice_effective, input, CAST(length(input) AS BIGINT) AS n_chars, "
            f"w AS n_words, {d.seconds('w')} AS est_seconds, {d.seconds('w0')} AS start_offset FROM e3")


def page_manifest() -> str:
    ctes = _extract_ctes() + [
        f"j AS (SELECT page_id, title, original_text, {d.voice_by('page_id')} AS voice FROM s5)",
    ] + _speech_ctes("j", "page_id", "voice") + [
        "p6 AS (SELECT * FROM p5 WHERE processed_text <> '')",
    ] + _explode("p6", "page_id", "voice")
    return d.with_ctes(*ctes) + manifest_select("page_id")


def page_manifest_lang() -> str:
    """The manifest joined to the best-scoring language of the first characters of each page's clean text."""
    from .language_sql import _ctes
    ctes = _ctes() + _extract_ctes() + [f"j AS (SELECT page_id, title, original_text, {d.voice_by('page_id')} AS voice FROM s5)"] + \
        _speech_ctes("j", "page_id", "voice") + ["p6 AS (SELECT * FROM p5 WHERE processed_text <> '')"] + _explode("p6", "page_id", "voice") + [
        "l1 AS (SELECT page_id, ' ' || lower(substr(clean_text, 1, 1000)) || ' ' AS s FROM p3)",
        "l2 AS (SELECT page_id, s, unnest(range(1, greatest(length(s) - 2, 1) + 1)) AS i FROM l1 WHERE length(s) >= 3)",
        "l3 AS (SELECT page_id, substr(s, i, 3) AS tri FROM l2)",
        "l4 AS (SELECT page_id, p.lang, sum(delta) AS s FROM l3 JOIN profile p ON l3.tri = p.tri GROUP BY ALL)",
        "l5 AS (SELECT page_id, count(*) AS n_tri FROM l3 GROUP BY page_id)",
        "l6 AS (SELECT l5.page_id, b.lang, n_tri * base + coalesce(l4.s, 0) AS score FROM l5 CROSS JOIN bases b "
        "LEFT JOIN l4 ON l4.page_id = l5.page_id AND l4.lang = b.lang)",
        "l7 AS (SELECT page_id, arg_max(lang, (score, lang)) AS lang FROM l6 GROUP BY page_id)",
        f"m AS ({manifest_select('page_id')})"]
    return d.with_ctes(*ctes) + ("SELECT content_id, chunk_index, coalesce(l7.lang, 'en') AS lang, voice_effective, n_chars, est_seconds "
                                 "FROM m LEFT JOIN l7 ON l7.page_id = content_id")


def page_manifest_counts() -> str:
    """A separate aggregate over the manifest of the pages with markup; the others give no content."""
    rows = page_manifest().replace("FROM pages)", "FROM pages WHERE page_id % 9 <> 0)", 1)
    return (f"SELECT (SELECT count(*) FROM pages) AS n_jobs, (SELECT count(*) FROM pages WHERE page_id % 9 = 0) AS n_no_content, "
            f"CAST(0 AS BIGINT) AS n_no_speech, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM ({rows})")


def page_title() -> str:
    return d.with_ctes(
        f"s1 AS (SELECT page_id, {d.drop_elements('html')} AS stripped FROM pages)",
        f"s2 AS (SELECT page_id, stripped, {d.title_inner('stripped')} AS t_inner FROM s1)",
    ) + f"SELECT page_id, {d.title_from('stripped', 't_inner')} AS title FROM s2"


def page_strip_boilerplate() -> str:
    return d.with_ctes(f"s1 AS (SELECT page_id, {d.drop_elements('html')} AS s FROM pages)") + \
        "SELECT page_id, CAST(length(s) AS BIGINT) AS n_chars, md5(s) AS md5 FROM s1"


def page_main_text() -> str:
    return d.with_ctes(*_extract_ctes()[:4]) + "SELECT page_id, raw_text AS main_text FROM s4"


def page_body_text() -> str:
    return d.with_ctes(
        f"b1 AS (SELECT page_id, {d.body_inner('html')} AS b FROM pages)",
        f"b2 AS (SELECT page_id, {d.markup_to_lines('b')} AS l FROM b1)",
    ) + f"SELECT page_id, {d.decode_entities('l')} AS body_text FROM b2"


def page_extract_cascade() -> str:
    block_start = r"(?i)<(?:p|div|li|h[1-6]|td|br)\b[^>]*>"
    anchor = r"(?is)<a\b[^>]*>(.*?)</a\s*>"
    bt = d.strip_ws(rf"regexp_replace({d.decode_entities(d.markup_to_lines('b'))}, '\s+', ' ', 'g')")
    anc = f"regexp_replace(array_to_string(regexp_extract_all(b, {d.q(anchor)}, 1), ''), {d.q(d.TAG_RUN)}, '', 'g')"
    items = (f"list_transform(regexp_split_to_array(stripped, {d.q(block_start)}), lambda b: "
             f"{{'t': {bt}, 'a': length({anc})}})")
    plain = "x.t IS NOT NULL AND x.a < length(x.t) * 0.5"
    kept = f"list_transform(items, lambda x: {{'t': x.t, 'dense': {plain} AND length(x.t) >= 25, 'keep': {plain} AND length(x.t) >= 10}})"
    st = ("list_reduce(kept, lambda s, x: {'i': s.i + 1, "
          "'start': CASE WHEN x.keep THEN CASE WHEN s.len = 0 THEN s.i + 1 ELSE s.start END ELSE 0 END, "
          "'len': CASE WHEN x.keep THEN s.len + length(x.t) ELSE 0 END, "
          "'bstart': CASE WHEN (CASE WHEN x.keep THEN s.len + length(x.t) ELSE 0 END) > s.blen "
          "THEN CASE WHEN s.len = 0 THEN s.i + 1 ELSE s.start END ELSE s.bstart END, "
          "'bcount': CASE WHEN (CASE WHEN x.keep THEN s.len + length(x.t) ELSE 0 END) > s.blen "
          "THEN s.i + 1 - CASE WHEN s.len = 0 THEN s.i + 1 ELSE s.start END + 1 ELSE s.bcount END, "
          "'blen': CASE WHEN (CASE WHEN x.keep THEN s.len + length(x.t) ELSE 0 END) > s.blen "
          "THEN s.len + length(x.t) ELSE s.blen END}, "
          "{'i': 0, 'start': 0, 'len': 0::BIGINT, 'bstart': 0, 'bcount': 0, 'blen': 0::BIGINT})")
    ctes = [
        f"s1 AS (SELECT page_id, url, html, {d.drop_elements('html')} AS stripped FROM pages)",
        f"s2 AS (SELECT page_id, url, stripped, {d.title_inner('stripped')} AS t_inner, {items} AS items, "
        f"{d.structural_main('stripped')} AS main_html, {d.body_inner('html')} AS body_html FROM s1)",
        f"s3 AS (SELECT page_id, url, {d.title_from('stripped', 't_inner')} AS title, {kept} AS kept, "
        f"{d.markup_to_lines('main_html')} AS l1, {d.markup_to_lines('body_html')} AS l2 FROM s2)",
        f"s4 AS (SELECT page_id, url, title, kept, {st} AS st, {d.decode_entities('l1')} AS struct_text, "
        f"{d.decode_entities('l2')} AS body_text FROM s3)",
        "s5 AS (SELECT page_id, url, title, "
        "array_to_string(list_transform(list_filter(kept, lambda x: x.dense), lambda x: x.t), chr(10)) AS dense, "
        "CASE WHEN st.bcount > 0 THEN array_to_string(list_transform(list_slice(kept, st.bstart, st.bstart + st.bcount - 1), "
        "lambda x: x.t), chr(10)) ELSE '' END AS run, struct_text, body_text FROM s4)",
        "s6 AS (SELECT page_id, url, title, "
        "coalesce(nullif(dense, ''), nullif(run, ''), nullif(struct_text, ''), nullif(body_text, '')) AS raw_text, "
        "CASE WHEN dense <> '' THEN 'dense_blocks' WHEN run <> '' THEN 'largest_run' WHEN struct_text <> '' THEN 'structural' "
        "WHEN body_text <> '' THEN 'body' END AS method FROM s5)",
        f"s7 AS (SELECT *, {d.clean_content('raw_text')} AS original_text FROM s6)",
    ]
    return d.with_ctes(*ctes) + (
        "SELECT page_id, url, title, method, raw_text, original_text, "
        "CASE WHEN coalesce(original_text, '') = '' THEN 'Could not extract content from the URL' END AS error FROM s7")


def page_edge_cases() -> str:
    """The expected edge texts are written out; no markup is read for them."""
    from .pages import EDGE_PAGES
    whens = " ".join(f"WHEN {i} THEN replace({d.q(want)}, '{{k}}', CAST(page_id AS VARCHAR))" for i, (_, want) in enumerate(EDGE_PAGES))
    return d.with_ctes(*_extract_ctes()[:4]) + (
        f"SELECT page_id, CASE page_id % {len(EDGE_PAGES)} {whens} END AS edge_text, raw_text AS main_text FROM s4")


def page_readability() -> str:
    """For pages whose paragraphs are children of one article without links, as the test pages: that article, their scores summed."""
    text = d.strip_ws(rf"regexp_replace({d.decode_entities('l')}, '\s+', ' ', 'g')")
    ctes = [
        f"s1 AS (SELECT page_id, {d.drop_elements('html')} AS stripped FROM pages)",
        f"s2 AS (SELECT page_id, {d.element_inner('stripped', 'article')} AS main_html FROM s1)",
        f"s3 AS (SELECT page_id, main_html, {d.markup_to_lines('main_html')} AS lines FROM s2)",
        f"m AS (SELECT page_id, {d.decode_entities('lines')} AS main_text FROM s3)",
        "p1 AS (SELECT page_id, string_split(unnest(string_split(main_html, '<p>')[2:]), '</p>')[1] AS piece FROM s2)",
        f"p2 AS (SELECT page_id, {d.markup_to_lines('piece')} AS l FROM p1)",
        f"p3 AS (SELECT page_id, {text} AS t FROM p2)",
        "p4 AS (SELECT page_id, sum(1 + length(t) - length(replace(t, ',', '')) + least(length(t) // 100, 3)) AS score "
        "FROM p3 WHERE length(t) >= 25 GROUP BY page_id)",
    ]
    return d.with_ctes(*ctes) + ("SELECT m.page_id, CASE WHEN score IS NOT NULL THEN 'article' END AS element, CAST(score AS DOUBLE) AS score, "
                                 "CASE WHEN score IS NOT NULL THEN md5(main_text) END AS text_md5 FROM m LEFT JOIN p4 ON m.page_id = p4.page_id")


def page_cascade_edge() -> str:
    """The expected rows are written out; no markup is read for them."""
    from .pages import CASCADE_PAGES

    def case(column: int) -> str:
        whens = " ".join(f"WHEN {i} THEN replace({d.q(row[column])}, '{{k}}', CAST(page_id AS VARCHAR))"
                         for i, row in enumerate(CASCADE_PAGES) if row[column] is not None)
        return f"CASE page_id % {len(CASCADE_PAGES)} {whens} END"
    return (f"SELECT page_id, url, {case(2)} AS title, {case(1)} AS method, {case(3)} AS raw_text, "
            f"CASE WHEN page_id % {len(CASCADE_PAGES)} = {len(CASCADE_PAGES) - 1} THEN {d.q(EXTRACT_ERROR)} END AS error FROM pages")
