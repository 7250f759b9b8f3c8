"""Oracle SQL (DuckDB) for the language queries."""
from __future__ import annotations

from . import duck as d


def _ctes() -> list[str]:
    return [
        f"c1 AS (SELECT doc_id, lang, {d.markup_to_lines('text')} AS l FROM documents)",
        f"c2 AS (SELECT doc_id, lang, {d.decode_entities('l')} AS t FROM c1)",
        f"c3 AS (SELECT doc_id, lang, {d.basic_clean_text('t')} AS t FROM c2)",
        "s AS (SELECT doc_id, lang, ' ' || lower(substr(t, 1, 1000)) || ' ' AS s FROM c3 WHERE length(' ' || lower(substr(t, 1, 1000)) || ' ') >= 3)",
        "w AS (SELECT doc_id, lang, ' ' || lower(t) || ' ' AS s FROM c3 WHERE substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8')",
        "wi AS (SELECT lang, s, unnest(range(1, greatest(length(s) - 2, 1) + 1)) AS i FROM w WHERE lang IS NOT NULL AND length(s) >= 3)",
        "i AS (SELECT doc_id, lang, s, unnest(range(1, greatest(length(s) - 2, 1) + 1)) AS i FROM s)",
        "tri AS (SELECT doc_id, lang, substr(s, i, 3) AS tri FROM i)",
        "counts AS (SELECT substr(s, i, 3) AS tri, lang, count(*) AS c FROM wi GROUP BY ALL)",
        "totals AS (SELECT lang, sum(c) AS total FROM counts GROUP BY lang)",
        "v AS (SELECT count(DISTINCT tri) AS v FROM counts)",
        "bases AS (SELECT lang, total, v, CAST(round(ln(1.0 / CAST(total + v AS DOUBLE)) * 1000.0) AS BIGINT) AS base FROM totals, v)",
        "profile AS (SELECT tri, counts.lang, CAST(round(ln((CAST(c AS DOUBLE) + 1.0) / CAST(total + v AS DOUBLE)) * 1000.0) AS BIGINT)"
        " - base AS delta FROM counts JOIN bases ON counts.lang = bases.lang)",
        "hits AS (SELECT doc_id, p.lang, sum(delta) AS s FROM tri t JOIN profile p ON t.tri = p.tri GROUP BY doc_id, p.lang)",
        "n AS (SELECT doc_id, count(*) AS n_tri FROM tri GROUP BY doc_id)",
        "scores AS (SELECT n.doc_id, b.lang, n.n_tri * b.base + coalesce(h.s, 0) AS score FROM n CROSS JOIN bases b "
        "LEFT JOIN hits h ON h.doc_id = n.doc_id AND h.lang = b.lang)",
        "best AS (SELECT doc_id, arg_max(lang, (score, lang)) AS detected FROM scores GROUP BY doc_id)",
        "det AS (SELECT c3.doc_id, c3.lang, coalesce(best.detected, 'en') AS detected FROM c3 LEFT JOIN best ON c3.doc_id = best.doc_id)",
    ]


def language_detect() -> str:
    return d.with_ctes(*_ctes()) + "SELECT doc_id, lang, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS fitted, detected FROM det"


def language_accuracy() -> str:
    return d.with_ctes(*_ctes()) + (
        "SELECT lang, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS fitted, count(*) AS n_docs, "
        "count(CASE WHEN detected = lang THEN 1 END) AS n_correct FROM det GROUP BY ALL")
