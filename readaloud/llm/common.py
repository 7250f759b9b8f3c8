"""Helpers shared by the operators of this subpackage.

Intermediate tables are written to the shared folder the session names in
``spark.checkpoint.dir`` (never to a machine-local folder on a cluster), so a
lost executor costs a re-read and not a recomputation.
"""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Everything that is not a letter, a digit or beyond ASCII; upper-case letters stay word characters.
NON_WORD_RUN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits of a row key that hold the digest of the text.
KEY_BITS = 62
NO_ID = 2 ** 63


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/readaloud-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shipped(df: DataFrame) -> DataFrame:
    """``df``, after this package was handed to the executors' Python workers (once per session)."""
    context = df.sparkSession.sparkContext
    if not getattr(context, "_readaloud_shipped", False):
        package = Path(__file__).parents[1]
        archive = os.path.join(tempfile.mkdtemp(prefix="readaloud-"), "readaloud_package.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        context.addPyFile(archive)
        context._readaloud_shipped = True
    return df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", *(columns or ("doc_id", "text")))


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def space_words(text: Column) -> Column:
    """Maximal runs of non-white-space characters, in order."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts that are all ASCII take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def folded_words(text: Column) -> Column:
    """Words of letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    return F.filter(F.split(lower_ascii(text), NON_WORD_RUN), lambda w: w != "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A decimal that names a row by its content and sorts by doc_id (null last), then by a digest of the text.

    Rows that repeat both doc_id and text share a key and are one document.
    It needs no row numbers, so it is the same in every scan of the input.
    """
    wide = "decimal(38,0)"
    digest = F.xxhash64(text_or_empty(text)).bitwiseAND(F.lit(2 ** KEY_BITS - 1))
    number = F.coalesce(F.col(doc_id).cast("decimal(20,0)"), F.lit(str(NO_ID)).cast("decimal(20,0)"))
    return ((number * F.lit(str(2 ** KEY_BITS)).cast("decimal(19,0)")).cast(wide)
            + digest.cast("decimal(19,0)")).cast(wide)


def key_doc_id(key: Column) -> Column:
    """The doc_id a row key was made from."""
    size = F.lit(str(2 ** KEY_BITS)).cast("decimal(19,0)")
    number = ((key - F.pmod(key, size)).cast("decimal(38,0)") / size).cast("decimal(20,0)")
    return F.when(number != F.lit(str(NO_ID)).cast("decimal(20,0)"), number.cast("bigint"))


def constant_array(values: list, kind: str) -> Column:
    """A constant array built from one literal (folded once by the optimizer), not one node per entry."""
    import json
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, for expressions that refer to it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, zero: Column, join, block: int = 256) -> Column:
    """Prefix folds of an array by an associative ``join``. Blocks keep the copying at about n * sqrt(n) for very long arrays."""
    def prefix(a: Column) -> Column:
        return F.slice(F.aggregate(a, F.array(zero), lambda s, x: F.concat(s, F.array(join(F.element_at(s, -1), x)))),
                       F.lit(2), F.size(a))

    def blocked(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(block)), lambda i: prefix(F.slice(a, i + 1, block)))
        return bound(blocks, lambda bs: bound(prefix(F.transform(bs, lambda b: F.element_at(b, -1))), lambda ends: F.flatten(
            F.transform(bs, lambda b, k: F.transform(b, lambda x: join(F.coalesce(F.get(ends, k - 1), zero), x))))))
    return bound(values, lambda a: F.when(F.size(a) > block, blocked(a)).otherwise(prefix(a)))


def running_sum(values: Column) -> Column:
    """Prefix sums of an int array."""
    return running(values, F.lit(0), lambda a, b: a + b)


def running_max(values: Column) -> Column:
    """Prefix maxima of an array of ints that are not negative."""
    return running(values, F.lit(0), F.greatest)


def clear_of(candidates: Column, base: Column, *fields: str) -> Column:
    """The candidate spans that overlap no base span, as structs of ``fields``, by end.

    Base spans (at their start) and candidates (at their end) are put in one order;
    a candidate overlaps one if the farthest end of the base spans before it lies beyond its start.
    """
    def event(s: Column, at: str, is_base: bool) -> Column:
        return F.struct(s[at].alias("at"), F.lit(is_base).alias("is_base"), *[s[f].alias(f) for f in fields])
    events = F.sort_array(F.concat(F.transform(base, lambda s: event(s, "start", True)), F.transform(candidates, lambda s: event(s, "end", False))))
    kept = bound(events, lambda es: bound(running_max(F.transform(es, lambda e: F.when(e["is_base"], e["end"]).otherwise(0))), lambda far: F.filter(
        F.transform(es, lambda e, k: F.when(~e["is_base"] & (F.get(far, k) <= e["start"]), F.struct(*[e[f].alias(f) for f in fields]))),
        lambda e: e.isNotNull())))
    return F.when((F.size(base) > 0) & (F.size(candidates) > 0), kept).otherwise(
        F.transform(candidates, lambda s: F.struct(*[s[f].alias(f) for f in fields])))


def pieces(text: Column, places: Column, block: int = 4096) -> Column:
    """The substrings of ``text`` at (start, n), counted in code points from 0: the text is cut into blocks once, so that no piece is looked for from its beginning."""
    def piece(blocks: Column, p: Column) -> Column:
        first, last = F.floor(p["start"] / block).cast("int"), F.floor((p["start"] + p["n"] - 1) / block).cast("int")

        def part(j: Column) -> Column:
            low = F.greatest(p["start"] - j * block, F.lit(0))
            return F.substring(F.get(blocks, j), low + 1, F.least(p["start"] + p["n"] - j * block, F.lit(block)) - low)
        return F.when(p["n"] <= 0, "").when(first == last, part(first)).otherwise(
            F.array_join(F.transform(F.sequence(first, last), part), ""))
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return bound(cut, lambda blocks: F.transform(places, lambda p: piece(blocks, p)))


def match_spans(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """All matches of a pattern, leftmost and non-overlapping, as (start, end, match, before, after).

    Positions count code points, the end is exclusive; ``before`` and ``after``
    are the texts between this match and its neighbours. Matches and
    the gaps between them come from two scans, which only texts with a match pay for.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(ms: Column, gaps: Column) -> Column:
        ends = running_sum(F.zip_with(ms, F.slice(gaps, F.lit(1), F.size(ms)), lambda m, g: F.length(m) + F.length(g)))
        return bound(ends, lambda es: F.transform(ms, lambda m, k: F.struct(
            (F.get(es, k) - F.length(m)).alias("start"), F.get(es, k).alias("end"), m.alias("match"),
            F.get(gaps, k).alias("before"), F.get(gaps, k + 1).alias("after"))))
    spans = bound(found, lambda ms: bound(F.split(text, pattern), lambda gaps: placed(ms, gaps)))
    has = F.rlike(text, F.lit(pattern)) if guard is None else guard & F.rlike(text, F.lit(pattern))
    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
    return F.when(has, spans).otherwise(F.array().cast(kind))


def span_string(spans: Column, ranks: list[str]) -> Column:
    """kind:start:end of (kind, start, end) structs by start, then by the listed order of kinds, comma-joined."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(constant_array(ranks, "string"), s["kind"]).alias("rank"),
        s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def kind_spans(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
