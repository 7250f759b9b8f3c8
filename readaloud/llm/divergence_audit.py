"""How far each source's word use departs from its language's: pairs of sources, and each source's own terms.

Terms are runs of letters and characters beyond ASCII with A-Z lower-cased. A
language keeps the terms found in at least ``MIN_DOCUMENTS`` of its documents.

**Method.** The kept terms, sorted within their language, are cut into
blocks, and each block becomes a minimal acyclic transducer
(:mod:`.transducer`) whose base ordinal is the number of terms before it. The
whole texts are then streamed once more: the words of an Arrow batch,
repeats counted, go to the block in whose range they fall and through its
transducer, which gives the counts by (language, source, ordinal). From there
on terms are ordinals; they break ties, and the terms reported
at last come from walking the transducers back.

**Scale.** No vocabulary is held whole: a task holds one block's
transducer (``Sizes.block_terms`` to twice that many terms) and streams rows by it. A (language,
block) is dealt to as many salts as its rows fill, so a hot language or source spreads over tasks. Pairs of sources
are summed in cells of (``Sizes.ordinals`` ordinals, two blocks of ``Sizes.sources`` sources); a cell is one bounded array
and emits one number per pair, never a row per term and pair. Broadcast is left to Spark and its measured sizes.

**Arithmetic.** All integers: counts are longs, the products before a
division are decimals, and the sum of f over all terms stays under 2 to the 63
because the p of a group sum to a thousand millions and V.

**Rows.** Null text, language and source are read as ''. Rows that repeat
count each, equal values are ranked by the source or the ordinal, a group without terms has
count 0 for every kept term, a language without kept terms gives its pairs with value 0, empty tables give no rows. Other columns
of the input, whatever their names, are not read. A very long text is one row of a batch, its words are counted in time
linear in its length.
"""
from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, shipped, stored
from .transducer import Transducer

#: A term is kept when so many documents of the language hold it.
MIN_DOCUMENTS = 3
#: Terms of a group that are reported.
TOP_TERMS = 200
#: Parts in p.
SCALE = 1_000_000_000

@dataclass(frozen=True)
class Sizes:
    """Where the tables are cut. Results don't depend on it."""

    #: Terms of a transducer, at least (if the language has them); at most twice as many.
    block_terms: int = 250_000
    #: Distinct words of a row that goes to a block.
    row_words: int = 20_000
    #: Words (distinct ones of a batch) for each salt of a block, at least; four times its terms if that is more.
    salt_words: int = 200_000
    #: A cell of the pair sums: so many ordinals by twice so many sources.
    ordinals: int = 4096
    sources: int = 64


Batches = Iterator[pa.RecordBatch]

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
assert (UPPER.encode().translate(_TERM_BYTES)).decode() == LOWER


def words_of(text: str) -> list[bytes]:
    """The terms of a text in order: every ASCII character that is no letter separates."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _document_counts(batches: Batches) -> Batches:
    """(lang, term, n): rows of the batch that hold the term."""
    for batch in batches:
        seen: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(set(words_of(text)))
        for lang, counts in seen.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(counts), pa.string()), pa.array([w.decode() for w in counts], pa.string()),
                pa.array(list(counts.values()), pa.int64())], ["lang", "term", "n"])


def _slicer(limit: int) -> Callable[[Batches], Batches]:
    """Sorted terms with the first term of their slice: a slice ends with its language, its partition or after ``limit`` terms."""
    def slices(batches: Batches) -> Batches:
        lang = first = None
        n = 0
        for batch in batches:
            langs, terms = batch["lang"].to_pylist(), batch["term"].to_pylist()
            firsts = []
            for new_lang, term in zip(langs, terms, strict=True):
                if new_lang != lang or n == limit:
                    lang, first, n = new_lang, term, 0
                n += 1
                firsts.append(first)
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(firsts, pa.string()), batch["term"]], ["lang", "slice", "term"])
    return slices


def _build(batches: Batches) -> Batches:
    """One transducer row per run of equal (lang, block) in the sorted terms."""
    held, terms = None, []

    def row() -> pa.RecordBatch:
        lang, block, base = held
        parts = Transducer.build(terms).to_bytes()
        values = [lang, block, base, len(terms), terms[0].decode(), terms[-1].decode(), *parts]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values],
                                          ["lang", "block", "base", "n_terms", "first", "last", "keys", "targets", "outputs", "finals"])
    for batch in batches:
        for lang, block, base, term in zip(*(batch[c].to_pylist() for c in ("lang", "block", "base", "term")), strict=True):
            if held is None or held[:2] != (lang, block):
                if terms:
                    yield row()
                held, terms = (lang, block, base), []
            terms.append(term.encode())
    if terms:
        yield row()


_BLOCK_TYPE = ("lang string, block bigint, base bigint, n_terms bigint, first string, last string, "
               "keys binary, targets binary, outputs binary, finals binary")


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, term) of the terms in at least MIN_DOCUMENTS documents of their language; ``docs`` as from :func:`_read`."""
    counts = shipped(docs).select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n bigint")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCUMENTS).select("lang", "term")


def vocabulary(kept: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """The transducers of a table of (lang, term), a row each with its range of terms and its base ordinal."""
    kind = "lang string, slice string, term string"
    sliced = stored(shipped(kept).repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_slicer(sizes.block_terms), kind), "audit-slices")
    counts = sliced.groupBy("lang", "slice").agg(F.count("*").alias("n"))
    # one row per slice: a slice is a partition's share of a language or block_terms terms
    in_lang = Window.partitionBy("lang").orderBy("slice")
    placed = counts.withColumn("at", F.coalesce(F.sum("n").over(in_lang.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumn("block", (F.dense_rank().over(Window.partitionBy("lang").orderBy(F.expr(f"at div {sizes.block_terms}"))) - 1).cast("bigint"))
    placed = placed.withColumn("base", F.min("at").over(Window.partitionBy("lang", "block")))
    rows = sliced.join(placed.select("lang", "slice", "block", "base"), ["lang", "slice"]).select("lang", "block", "base", "term")
    built = rows.repartition("lang", "block").sortWithinPartitions("lang", "block", "term")
    return stored(built.mapInArrow(_build, _BLOCK_TYPE), "audit-vocabulary")


def _word_router(limit: int) -> Callable[[Batches], Batches]:
    """The words of each batch, repeats counted, by language, source and block; pieces of at most ``limit`` words."""
    names = ["lang", "block", "source", "n_words", "words", "counts"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]

    def route(batches: Batches) -> Batches:
        for batch in batches:
            seen: dict[tuple, Counter] = {}
            ranges = {}
            for lang, source, text, firsts in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text", "firsts")), strict=True):
                ranges[lang] = firsts
                seen.setdefault((lang, source), Counter()).update(words_of(text))
            rows = []
            for (lang, source), counts in seen.items():
                words = sorted(counts)
                starts = [bisect_left(words, first.encode()) for first in ranges[lang]] + [len(words)]
                for block, (lo, hi) in enumerate(pairwise(starts)):
                    for at in range(lo, hi, limit):
                        piece = words[at:min(at + limit, hi)]
                        rows.append((lang, block, source, len(piece), b" ".join(piece),
                                     np.array([counts[w] for w in piece], np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
    return route


def _recount(batches: Batches) -> Batches:
    """Rows sorted by (lang, block, salt), the transducer first, then by source: its words to (lang, source, ordinal, n)."""
    lang = source = machine = sums = None
    base = 0

    def landed() -> Batches:
        if sums is not None:
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()),
                pa.array(at + base), pa.array(sums[at])], ["lang", "source", "ordinal", "n"])
    for batch in batches:
        for row in batch.to_pylist():
            if row["keys"] is not None:
                yield from landed()
                machine = Transducer.from_bytes(row["keys"], row["targets"], row["outputs"], row["finals"])
                lang, base, n_terms, sums = row["lang"], row["base"], row["n_terms"], None
                continue
            if sums is None or row["source"] != source:
                yield from landed()
                source, sums = row["source"], np.zeros(n_terms, np.int64)
            words = row["words"].split(b" ")
            offsets = np.zeros(len(words) + 1, np.int64)
            np.cumsum([len(w) for w in words], out=offsets[1:])
            found = machine.ordinals(np.frombuffer(b"".join(words), np.uint8), offsets)
            sums[found[found >= 0]] += np.frombuffer(row["counts"], np.int64)[found >= 0]  # the words of a row are distinct
    yield from landed()


_PARTS = ("keys", "targets", "outputs", "finals")


def recount(docs: DataFrame, blocks: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """(lang, source, ordinal, n) of every kept term with an occurrence in a group."""
    starts = F.transform(F.sort_array(F.collect_list(F.struct("block", "first"))), lambda r: F.when(r["block"] == 0, "").otherwise(r["first"]))
    # one row a language, with a word per block; a table of its own, so that its measured size decides how it is joined
    ranges = stored(blocks.groupBy("lang").agg(starts.alias("firsts")), "audit-ranges")
    kind = "lang string, block bigint, source string, n_words bigint, words binary, counts binary"
    words = stored(shipped(docs.select("lang", "source", "text").join(ranges, "lang")).mapInArrow(_word_router(sizes.row_words), kind), "audit-words")
    filled = words.groupBy("lang", "block").agg(F.sum("n_words").alias("filled"))
    salts = stored(filled.join(blocks.select("lang", "block", "n_terms"), ["lang", "block"])
                   .select("lang", "block", F.expr(f"1 + filled div greatest({sizes.salt_words}, 4 * n_terms)").alias("salts")), "audit-salts")

    def none(kind: str, *names: str) -> list[Column]:
        return [F.lit(None).cast(kind).alias(n) for n in names]
    machines = blocks.join(salts, ["lang", "block"]).select(
        "lang", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"),
        *none("string", "source"), *none("binary", "words", "counts"), "base", "n_terms", *_PARTS)
    rows = words.join(salts, ["lang", "block"]).select(
        "lang", "block", F.pmod(F.xxhash64("words", "counts", "source"), "salts").alias("salt"), F.lit(1).alias("side"),
        "source", "words", "counts", *none("bigint", "base", "n_terms"), *none("binary", *_PARTS))
    dealt = machines.unionByName(rows).repartition("lang", "block", "salt").sortWithinPartitions("lang", "block", "salt", "side", "source")
    counted = dealt.drop("block", "salt", "side").mapInArrow(_recount, "lang string, source string, ordinal bigint, n bigint")
    return counted.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact."""
    part = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")).cast("decimal(29,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", part, (total + terms).cast("decimal(19,0)"))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _cell_summer(ordinals: int, sources: int) -> Callable[[pa.Table], pa.Table]:
    """A cell's sum of f for every ordered pair of different sources; ordinal -1 holds a source's p of an absent term."""
    def sums_of(cell: pa.Table) -> pa.Table:
        width, low, high = (cell[c][0].as_py() for c in ("width", "a", "b"))
        number, ordinal, p = (cell[c].to_numpy() for c in ("number", "ordinal", "p"))
        ids, row = np.unique(number, return_inverse=True)
        absent = np.zeros(len(ids), np.int64)
        absent[row[ordinal < 0]] = p[ordinal < 0]
        table = np.repeat(absent[:, None], width, axis=1)
        real = ordinal >= 0
        table[row[real], ordinal[real] % ordinals] = p[real]
        sums = np.zeros((len(ids), len(ids)), np.int64)
        for i in range(len(ids)):
            gap = table[i] - table
            sums[i] = (gap * gap // table).sum(axis=1)
        side = ids // sources
        crossed = side[:, None] != side[None, :] if low != high else ~np.eye(len(ids), dtype=bool)
        i, j = np.nonzero(crossed)
        return pa.table({"lang": pa.array([cell["lang"][0].as_py()] * len(i), pa.string()),
                         "number": ids[i], "other": ids[j], "value": sums[i, j]})
    return sums_of


def pair_divergence(counts: DataFrame, groups: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """(lang, number, other, value) of every ordered pair of sources of a language.

    ``groups``: lang, number (from 0 in the language), total, terms, absent (p of a term that does not occur), n_groups.
    """
    blocks = F.expr(f"cast((n_groups - 1) div {sizes.sources} as int)")
    own = F.expr(f"cast(number div {sizes.sources} as int)")
    strips = F.expr(f"cast(greatest(terms - 1, 0) div {sizes.ordinals} as int)")
    markers = groups.select("lang", "number", "terms", F.lit(-1).cast("bigint").alias("ordinal"), F.col("absent").alias("p"), own.alias("own"),
                            blocks.alias("last"), F.explode(F.sequence(F.lit(0), strips)).alias("strip"))
    rows = counts.join(groups, ["lang", "source"]).select("lang", "number", "terms", "ordinal", "p", own.alias("own"), blocks.alias("last"),
                                                          F.expr(f"cast(ordinal div {sizes.ordinals} as int)").alias("strip"))
    spread = markers.unionByName(rows).select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("partner"))
    cells = spread.select("lang", "strip", F.least("own", "partner").alias("a"), F.greatest("own", "partner").alias("b"), "number", "ordinal", "p",
                          F.expr(f"cast(least({sizes.ordinals}, terms - strip * {sizes.ordinals}) as int)").alias("width"))
    sums = cells.groupBy("lang", "strip", "a", "b").applyInArrow(_cell_summer(sizes.ordinals, sizes.sources), "lang string, number bigint, other bigint, value bigint")
    return sums.groupBy("lang", "number", "other").agg(F.sum("value").alias("value"))


def _terms_of(batches: Batches) -> Batches:
    """Rows sorted by (lang, block) with the transducer first: ordinals to terms."""
    machine, base = None, 0
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if row["keys"] is not None:
                machine, base = Transducer.from_bytes(row["keys"], row["targets"], row["outputs"], row["finals"]), row["base"]
            else:
                rows.append((row["lang"], row["ordinal"], machine.term(row["ordinal"] - base).decode()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))],
                                         ["lang", "ordinal", "term"])


def terms_of(ordinals: DataFrame, blocks: DataFrame) -> DataFrame:
    """(lang, ordinal, term) of distinct (lang, ordinal), by walking the transducers back."""
    bounds = blocks.select(F.col("lang").alias("l"), "block", "base", "n_terms")
    wanted = ordinals.join(bounds, (F.col("lang") == F.col("l")) & (F.col("ordinal") >= F.col("base")) & (F.col("ordinal") < F.col("base") + F.col("n_terms")))
    rows = wanted.select("lang", "block", F.lit(1).alias("side"), "ordinal", F.lit(None).cast("bigint").alias("base"), *[F.lit(None).cast("binary").alias(c) for c in _PARTS])
    both = blocks.select("lang", "block", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("ordinal"), "base", *_PARTS).unionByName(rows)
    dealt = both.repartition("lang", "block").sortWithinPartitions("lang", "block", "side", "ordinal")
    return dealt.mapInArrow(_terms_of, "lang string, ordinal bigint, term string")


def divergence_audit(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank; see the module."""
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    blocks = vocabulary(kept_terms(docs), sizes)
    counts = stored(recount(docs, blocks, sizes), "audit-counts")
    terms = blocks.groupBy("lang").agg(F.sum("n_terms").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("n_rows")).join(totals, ["lang", "source"], "left").join(terms, "lang", "left") \
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = groups.withColumn("absent", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(1)))
    in_lang = Window.partitionBy("lang")
    # as many rows a language as it has sources; the result has the square of that
    groups = stored(groups.withColumn("number", (F.row_number().over(in_lang.orderBy("source")) - 1).cast("bigint"))
                    .withColumn("n_groups", F.count("*").over(in_lang)), "audit-groups")
    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "ordinal", "n", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))

    pairs = pair_divergence(shares.select("lang", "source", "ordinal", "p"), groups, sizes)
    name = groups.select("lang", "number", "source")
    pairs = pairs.join(name, ["lang", "number"]).join(name.select("lang", F.col("number").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n"))
    size = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    whole = whole.join(size, "lang").select("lang", "ordinal", _share(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    lifted = shares.where(F.col("n") > 0).join(whole, ["lang", "ordinal"]).where(F.col("p") > F.col("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    top = lifted.withColumn("value", _distance(F.col("p"), F.col("q"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    top = stored(top.select("lang", "source", "ordinal", "value", "rank"), "audit-top")
    spelled = terms_of(top.select("lang", "ordinal").distinct(), blocks)
    top = top.join(spelled, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(top)
