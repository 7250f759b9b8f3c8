"""Secret scan with multipart credential linking, in DataFrame expressions only.

Strong parts (assignments, access identifiers, long hex runs) are reported as
they are. Weak parts - a user or account name, a long mixed key, an endpoint -
mean little alone. They become candidates, and an interval join links the parts
of a credential: parts and candidates of a document meet on scope (paragraph) and on bins of
``REACH`` code points, and a candidate is reported only if its complementary
parts start within that reach in the same scope: a name needs a secret, a key
needs an access identifier or a name, an endpoint needs both. Bins hold only the least
and the greatest start of each role, so a bin full of parts is one row and no
pairs are emitted.

Only documents with a candidate take part in the join; everything before it is
row-local. Edge cases: a null text is empty and has no spans; a candidate that overlaps a
strong part is not a candidate; rows that repeat doc_id and text get
the same result each; a null doc_id is kept; an empty table gives an empty result; other
columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import clear_of, kind_spans, match_spans, row_key, span_string, stored, text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
NAME = r"""(?i:user(?:_?name)?|login|account(?:_?(?:id|name))?|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9@._-]{2,}"""
KEY = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}+={0,2}"
ENDPOINT = r"""(?<![A-Za-z0-9])[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+|(?i:host|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.:-]{2,}"""
BREAK = r"\n[\x20\x09\x0B-\x0D]*\n"
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "name", "key", "endpoint"]
REACH = 400
MIN_VALUE = 6


def strong_spans(text: Column) -> dict[str, Column]:
    assigned = F.filter(match_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= MIN_VALUE)
    return {"assign": kind_spans(assigned, "assign"),
            "access": kind_spans(match_spans(text, ACCESS, F.contains(text, F.lit("AKIA"))), "access"),
            "hex": kind_spans(match_spans(text, HEX), "hex")}


def weak_spans(text: Column) -> Column:
    """Candidates of every kind; a key must mix upper case, lower case and digits."""
    keys = F.filter(match_spans(text, KEY), lambda s: s["match"].rlike("[A-Z]") & s["match"].rlike("[a-z]") & s["match"].rlike("[0-9]"))
    return F.concat(kind_spans(match_spans(text, NAME), "name"), kind_spans(keys, "key"), kind_spans(match_spans(text, ENDPOINT), "endpoint"))


def link_parts(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(key, kind, start, end) of the candidates whose complementary parts lie in reach, from (key, base, weak, breaks)."""
    entry = F.concat("base", "weak", F.transform("breaks", lambda p: F.struct(
        F.lit("break").alias("kind"), p.alias("start"), p.alias("end"))))
    parts = found.select("key", F.inline(entry))
    order = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    role = F.when(F.col("kind").isin("access", "name"), "access").when(F.col("kind") == "endpoint", "endpoint").otherwise("secret")
    parts = parts.withColumn("scope", F.sum((F.col("kind") == "break").cast("int")).over(order)).where("kind != 'break'") \
        .withColumn("role", role).withColumn("bin", F.floor(F.col("start") / reach))
    cells = parts.groupBy("key", "scope", "bin", "role").agg(F.min("start").alias("low"), F.max("start").alias("high")) \
        .withColumnRenamed("role", "other")
    weak = parts.where(F.col("kind").isin("name", "key", "endpoint")).select(
        "key", "scope", "kind", "role", "start", "end", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    met = weak.join(cells, ["key", "scope", "bin"]).where(
        (F.col("other") != F.col("role")) & (F.col("low") <= F.col("start") + reach) & (F.col("high") >= F.col("start") - reach))
    near = met.groupBy("key", "kind", "role", "start", "end").agg(
        F.max(F.col("other") == "secret").alias("secret"), F.max(F.col("other") == "access").alias("access"))
    return near.where(F.when(F.col("role") == "access", F.col("secret")).when(F.col("role") == "secret", F.col("access"))
                      .otherwise(F.col("secret") & F.col("access"))).select("key", "kind", "start", "end")


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, assign, access, hex, linked): spans (kind, start, end) of every row; ``linked`` are the reported candidates."""
    text = F.col("text")
    rows = docs.select(row_key().alias("key"), "doc_id", text_or_empty().alias("text"))
    strong = strong_spans(text)
    found = rows.select("key", "doc_id", *[strong[k].alias(k) for k in BASE], weak_spans(text).alias("weak"), "text")
    found = found.select("key", "doc_id", *BASE, F.concat(*BASE).alias("base"), "weak", "text")
    clear = clear_of(F.col("weak"), F.col("base"), "kind", "start", "end")
    found = found.select("key", "doc_id", *BASE, "base", clear.alias("weak"), "text")
    breaks = F.when(F.size("weak") > 0, F.transform(match_spans(text, BREAK), lambda s: s["start"])).otherwise(F.array().cast("array<int>"))
    found = stored(found.select("key", "doc_id", *BASE, "base", "weak", breaks.alias("breaks")), "secret-parts")
    linked = link_parts(found.where(F.size("weak") > 0).dropDuplicates(["key"]), reach)
    # a document's candidates are bounded by its own text
    linked = linked.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return found.join(linked, "key", "left").select("doc_id", *BASE, F.coalesce("linked", none).alias("linked"))


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the result of ``scan_secrets``."""
    base = F.concat(*BASE)
    return found.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE],
                        F.sha2(span_string(base, KINDS), 256).alias("base_sha256"),
                        span_string(F.concat(base, F.col("linked")), KINDS).alias("spans"))
