"""Registered queries of this subpackage: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .bpe import round_trip
from .common import documents
from .decontaminate import contamination
from .divergence_audit import divergence_audit
from .language_id import language_id
from .line_dedup import dedup_lines
from .ngram_join import near_duplicates
from .pii import find_personal_data, personal_data_digest
from .quality import quality_rules
from .secret_scan import scan_secrets, secret_digest
from .token_counts import count_tokens
from .tool_calls import link_results, turns_as_calls
from .warc import write_and_read
from .whitening import whiten

TOKEN_LIMIT = 512
#: How far from its place a word of a benchmark window may stand in a proximity match.
SLOP = 2
#: The schema of the call that every user turn is taken for.
TOOLS = {"answer": {"required": ["question", "chars", "turn"], "properties": {
    "question": {"type": "string", "minLength": 1, "maxLength": 1000},
    "chars": {"type": "integer", "minimum": 1},
    "turn": {"type": "integer", "minimum": 0}}}}

Builder = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(documents(spark, sf_dir)))


def op2_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = write_and_read(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir, "doc_id", "text", "lang")).drop("key")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(find_personal_data(documents(spark, sf_dir)))


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = turns_as_calls(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    rows = link_results(calls, results, TOOLS)
    return rows.select("conv_id", "call_id", "turn", "status", "level", "n_results",
                       F.array_join("errors", "; ").alias("errors"), F.sha2("json", 256).alias("json_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "copy_id", "class_id", "n_links")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", "item_id", "text"), slop=SLOP)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
                        F.size("near_items").cast("bigint").alias("n_near_items"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(documents(spark, sf_dir, "lang", "source", "text"))


QUERIES: dict[str, Builder] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_warc_writer": op2_warc_writer,
    "op3_quality_rules": op3_quality_rules,
    "op4_personal_data": op4_personal_data,
    "op5_tool_call_linking": op5_tool_call_linking,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_language_id": op12_language_id,
    "op13_source_divergence_audit": op13_source_divergence_audit,
}

#: User turns as calls, assistant turns as results of the latest user turn before them.
_OP5_SQL = """
WITH t AS (SELECT conv_id, turn, role, text,
                  max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u,
                  count(CASE WHEN role = 'user' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lvl
           FROM conversations),
r AS (SELECT conv_id, u, count(*) AS n, arg_min(text, turn) AS content FROM t WHERE role = 'assistant' AND u IS NOT NULL GROUP BY 1, 2)
SELECT t.conv_id, 'call-' || t.conv_id || '-' || t.turn AS call_id, t.turn,
       CASE WHEN r.n IS NULL THEN 'unanswered' ELSE 'linked' END AS status, t.lvl AS level, coalesce(r.n, 0) AS n_results,
       concat_ws('; ', CASE WHEN length(t.text) < 1 THEN 'chars: beyond its minimum' END,
                 CASE WHEN length(t.text) > 1000 THEN 'question: beyond its maxLength' END,
                 CASE WHEN length(t.text) < 1 THEN 'question: beyond its minLength' END) AS errors,
       sha256('{"arguments":' || CAST(json_object('chars', length(t.text), 'question', t.text, 'turn', t.turn) AS VARCHAR)
              || ',"id":' || CAST(to_json('call-' || t.conv_id || '-' || t.turn) AS VARCHAR) || ',"name":"answer"'
              || CASE WHEN r.content IS NULL THEN '' ELSE ',"result":' || CAST(to_json(r.content) AS VARCHAR) END || '}') AS json_sha256
FROM t LEFT JOIN r ON t.conv_id = r.conv_id AND t.turn = r.u WHERE t.role = 'user'
UNION ALL
SELECT conv_id, 'call-' || conv_id || '--1', turn, 'orphan', NULL, 1, 'call_id: no such call',
       sha256('{"id":' || CAST(to_json('call-' || conv_id || '--1') AS VARCHAR)
              || CASE WHEN text IS NULL THEN '' ELSE ',"result":' || CAST(to_json(text) AS VARCHAR) END || '}')
FROM t WHERE role = 'assistant' AND u IS NULL
"""

#: SHA-1 in base32: the hex digits as bits, the bits in fives.
_OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, strlen(h) AS n, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS keeper FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr(
          '0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', substr(hex, i, 1)) - 3, 4)), '') AS bits FROM k)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + 16 * CAST(substr(bits, 5 * g + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * g + 2, 1) AS INTEGER)
             + 4 * CAST(substr(bits, 5 * g + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * g + 4, 1) AS INTEGER)
             + CAST(substr(bits, 5 * g + 5, 1) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM b
"""

_WORDS_SQL = r"""list_filter(regexp_split_to_array({0}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

#: All pairs that share a shingle, and their components.
_OP9_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, """ + _WORDS_SQL.format("lower(coalesce(text, ''))") + """ AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
          lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) AS x FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS met FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v, met = nu.n AND met = nv.n AS same FROM c JOIN n nu ON u = nu.doc_id JOIN n nv ON v = nv.doc_id
      WHERE 9 * met >= 4 * (nu.n + nv.n)),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
g AS (SELECT u AS doc_id, min(v) AS class_id FROM r GROUP BY u),
k AS (SELECT u AS doc_id, count(*) AS n_links, min(CASE WHEN same THEN v END) AS twin FROM l GROUP BY u)
SELECT g.doc_id, least(g.doc_id, coalesce(twin, g.doc_id)) AS copy_id, class_id, coalesce(n_links, 0) AS n_links
FROM g LEFT JOIN k ON g.doc_id = k.doc_id
"""

#: Every window of every text joined to the benchmark's windows.
_OP10_SQL = """
WITH b AS (SELECT item_id, """ + _WORDS_SQL.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + """ AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: list_slice(w, i, i + 12))) AS win
       FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, """ + _WORDS_SQL.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + """ AS w FROM documents),
z AS (SELECT DISTINCT len(win) AS z FROM bw),
dz AS (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM d, z WHERE len(w) >= z),
dw AS (SELECT doc_id, i, z, list_slice(w, i, i + z - 1) AS win FROM dz),
h AS (SELECT doc_id, i, z, item_id FROM dw JOIN bw ON dw.win = bw.win),
p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + z)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id),
wt AS (SELECT win, len(win) AS z, unnest(win) AS word, unnest(range(0, len(win))) AS place FROM (SELECT DISTINCT win FROM bw)),
dp AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
fr AS (SELECT word, count(*) AS n FROM dp GROUP BY word),
ra AS (SELECT win, min(z) AS z, arg_min(word, (n, place)) AS word, arg_min(place, (n, place)) AS place
       FROM wt JOIN fr USING (word) GROUP BY win HAVING count(*) = min(z)),
st AS (SELECT DISTINCT dp.doc_id, win, dp.pos - place + s.s AS start FROM ra JOIN dp ON ra.word = dp.word, (SELECT unnest(range(-2, 3)) AS s) s),
nr AS (SELECT DISTINCT st.doc_id, win FROM st JOIN d ON st.doc_id = d.doc_id
       WHERE len(list_filter(range(1, len(win) + 1), lambda i: list_contains(
           list_slice(w, greatest(start + i - 2, 1), greatest(start + i + 2, 0)), win[i]))) = len(win)),
ni AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM nr JOIN bw ON nr.win = bw.win GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated,
       coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN ni ON d.doc_id = ni.doc_id
"""

#: Every kept term of every group, and all ordered pairs of groups joined on it.
_OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_transform(
               regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
               lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
u AS (SELECT lang, unnest(list_distinct(w)) AS term FROM d),
k AS (SELECT lang, term FROM u GROUP BY ALL HAVING count(*) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
f AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.total + v.v)::HUGEINT AS p
      FROM gn JOIN k ON gn.lang = k.lang JOIN v ON v.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
ln AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
lt AS (SELECT lang, sum(n) AS total FROM ln GROUP BY lang),
q AS (SELECT ln.lang, term, 1 + (1000000000::HUGEINT * (n + 1)::HUGEINT) // (total + v)::HUGEINT AS q
      FROM ln JOIN lt ON ln.lang = lt.lang JOIN v ON v.lang = ln.lang),
ps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
       FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN ps ON ps.lang = a.lang AND ps.source = a.source AND ps.item = b.source),
t AS (SELECT f.lang, source, f.term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
      FROM f JOIN q ON f.lang = q.lang AND f.term = q.term WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM t) WHERE rank <= 200
"""

ORACLE_SQL: dict[str, str] = {
    "op2_warc_writer": _OP2_SQL,
    "op5_tool_call_linking": _OP5_SQL,
    "op9_ngram_jaccard_join": _OP9_SQL,
    "op10_benchmark_decontamination": _OP10_SQL,
    "op13_source_divergence_audit": _OP13_SQL,
}
