"""Benchmark decontamination with a distributed positional index, in DataFrame expressions only.

The benchmark's windows (13 consecutive words; a shorter item is one window)
are the test queries, taken in blocks of bounded size. Per block:

1. Every document becomes a row of positional postings, kept as runs (the
   words, and the number that names the row in every block, are written once before): a
   position is stored if it lies in a stretch of words, at least as long as a
   window, whose word hashes are all in a bit set of the block's vocabulary. The
   bit set has no false negatives, so no occurrence is lost, and what it lets
   through is compared word by word later. The index is written to the shared
   folder and everything after reads it.
2. Posting counts per term give each window its rarest term. That term's
   postings, moved back by its offset, are the candidate starts.
3. The other terms' offset-adjusted postings are intersected with the
   candidates by an equi-join on (row, position, word), never by term alone,
   so a frequent word costs nothing beyond its own postings.

With ``slop`` there are proximity matches too: a window matches near a start if
each of its terms stands within ``slop`` of its place. They need not lie in such a
stretch, so their candidates come from the words as written, by the
term that is rarest there, and carry the positions around them. ``proximity_matches``
is the same by joins, on an index that keeps every posting and with the rarest term at its very place.

Edge cases: null and empty texts have no words (not contaminated) and items
without words have no window; equal windows of several items count for each; rows that repeat are
separate rows of the index; an empty table or benchmark gives no hits; only
the id and text columns are read, so clashing names don't matter.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import constant_array, folded_words, row_key, stored, text_or_empty

WINDOW = 13
#: Windows handled in one pass over the index; bounds the bit set and the broadcast.
BLOCK = 20_000
BITS_PER_WORD = 32


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words): every window of every item."""
    words = bench.select(F.col("item_id"), folded_words(text_or_empty()).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words")).distinct()


def _bit_set(vocabulary: list[int]) -> tuple[Column, int]:
    """Word hashes as a constant bit array with 32 bits and more for each word (bounded by the block)."""
    size = 1 << max(12, (max(1, len(vocabulary)) * BITS_PER_WORD - 1).bit_length())
    cells = [0] * (size // 32)
    for h in vocabulary:
        at = h % size
        cells[at // 32] |= 1 << (at % 32)
    return constant_array(cells, "bigint"), size


def _in_set(vocabulary: list[int]):
    """A predicate: whether a word's hash may be in the vocabulary."""
    bits, size = _bit_set(vocabulary)

    def hit(w: Column) -> Column:
        at = F.pmod(F.xxhash64(w), F.lit(size))
        return F.getbit(F.get(bits, F.shiftright(at, 5).cast("int")), at.bitwiseAND(F.lit(31)).cast("int")) == 1
    return hit


def _runs(words: Column, misses: Column, least: int) -> Column:
    """Stretches of at least ``least`` consecutive positions between misses, as (start, words)."""
    spans = F.transform(misses, lambda p, k: F.struct((p + 1).alias("start"), (F.get(misses, k + 1) - p - 1).alias("n")))
    return F.transform(F.filter(spans, lambda s: s["n"] >= least),
                       lambda s: F.struct(s["start"].alias("start"), F.slice(words, s["start"] + 1, s["n"]).alias("words")))


def numbered_words(docs: DataFrame) -> DataFrame:
    """(row, key, doc_id, n_words, words), written once: a row number that is read back doesn't depend on how a scan is split."""
    words = docs.select(row_key().alias("key"), "doc_id", folded_words(text_or_empty()).alias("words"))
    return stored(words.select(F.monotonically_increasing_id().alias("row"), "key", "doc_id", F.size("words").cast("bigint").alias("n_words"), "words"),
                  "decontamination-words")


def positional_index(words: DataFrame, vocabulary: list[int], least: int) -> DataFrame:
    """(row, key, doc_id, n_words, runs): the postings of the vocabulary, one row per document of :func:`numbered_words`, in the shared folder."""
    hit = _in_set(vocabulary)

    def missed(w: Column, i: Column) -> Column:
        return F.when(hit(w), F.lit(-1)).otherwise(i)
    misses = F.concat(F.array(F.lit(-1)), F.filter(F.transform("words", missed), lambda p: p >= 0), F.array(F.size("words")))
    marked = words.select("row", "key", "doc_id", "n_words", "words", misses.alias("misses"))
    return stored(marked.select("row", "key", "doc_id", "n_words",
                                _runs(F.col("words"), F.col("misses"), least).alias("runs")), "positional-index")


def postings(index: DataFrame) -> DataFrame:
    """(row, pos, word) of an index."""
    runs = index.select("row", F.explode("runs").alias("run"))
    return runs.select("row", "run.start", F.posexplode("run.words").alias("k", "word")).select(
        "row", (F.col("start") + F.col("k")).alias("pos"), "word")


def _rarest(windows: DataFrame, lists: DataFrame) -> DataFrame:
    """(window, words, at, word): each window's term with the fewest postings; windows with an unseen term go."""
    terms = windows.select("window", F.size("words").alias("len"), F.posexplode("words").alias("at", "word"))
    vocabulary = terms.select("word").distinct()  # at most the words of BLOCK windows, and so are its counts
    counts = lists.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = terms.join(F.broadcast(counts), "word")
    best = counted.groupBy("window", "len").agg(
        F.count(F.lit(1)).alias("seen"), F.min(F.struct("n", "at")).alias("low")).where("seen = len")
    return windows.join(best, "window").select("window", "words", F.col("low.at").alias("at"),
                                               F.element_at("words", F.col("low.at") + 1).alias("word"))


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, row, start, len): every place where a window's words stand in order."""
    lists = postings(index)
    rare = stored(_rarest(windows, lists), "rarest-terms")
    candidates = lists.join(F.broadcast(rare), "word").select(  # a block has at most BLOCK windows
        "window", "row", (F.col("pos") - F.col("at")).alias("start"), "words", F.col("at").alias("known"))
    expected = candidates.where("start >= 0").select("window", "row", "start", F.size("words").alias("len"),
                                                     F.posexplode("words").alias("at", "word")).select(
        "window", "row", "start", "len", (F.col("start") + F.col("at")).alias("pos"), "word")
    met = expected.join(lists, ["row", "pos", "word"]).groupBy("window", "row", "start", "len").count()
    return met.where("count = len").select("window", "row", "start", "len")


def proximity_matches(index: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """(window, row, start): rarest-term candidates of an index that keeps every posting (``least`` 1), with every term within ``slop`` positions of its place."""
    lists = postings(index)
    rare = stored(_rarest(windows, lists), "rarest-terms")
    candidates = lists.join(F.broadcast(rare), "word").select(  # a block has at most BLOCK windows
        "window", "row", (F.col("pos") - F.col("at")).alias("start"), "words")
    places = F.explode(F.sequence(F.col("start") + F.col("at") - slop, F.col("start") + F.col("at") + slop))
    expected = candidates.select("window", "row", "start", F.size("words").alias("len"),
                                 F.posexplode("words").alias("at", "word")).select(
        "window", "row", "start", "len", "at", "word", places.alias("pos"))
    met = expected.join(lists, ["row", "pos", "word"]).select("window", "row", "start", "len", "at").distinct()
    return met.groupBy("window", "row", "start", "len").count().where("count = len").select("window", "row", "start")


def near_matches(words: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """(window, row): the rows of :func:`numbered_words` that hold every word of a window within ``slop`` positions of its place from some start.

    A window's rarest term in the whole corpus names the candidates, which carry the positions around them, so that
    the other terms' offset-adjusted places are met where the candidate stands: nothing is shuffled for each.
    """
    terms = stored(windows.select("window", F.size("words").alias("len"), F.posexplode("words").alias("at", "word")), "window-terms")
    vocabulary = [r.h for r in terms.select("word").distinct().select(F.xxhash64("word").alias("h")).collect()]  # bounded by the block
    counts = words.select(F.explode(F.filter("words", _in_set(vocabulary))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    best = terms.join(counts, "word").groupBy("window", "len").agg(
        F.count(F.lit(1)).alias("seen"), F.min(F.struct("n", "at", "word")).alias("low")).where("seen = len")
    rare = stored(windows.join(best, "window").select("window", F.col("words").alias("terms"), "low.at", "low.word"), "rarest-terms")
    bounds = rare.agg(F.max(F.size("terms")).alias("width")).first()
    around = (bounds.width or 1) - 1 + slop  # how far a window reaches to either side of any of its terms
    anchors = [r.h for r in rare.select("word").distinct().select(F.xxhash64("word").alias("h")).collect()]  # bounded by the block
    hit = _in_set(anchors)
    low = lambda p: F.greatest(p - around, F.lit(0))
    places = F.filter(F.transform("words", lambda w, p: F.when(hit(w), p)), lambda p: p.isNotNull())
    found = words.select("row", F.inline(F.transform(places, lambda p: F.struct(
        F.get("words", p).alias("word"), (p - low(p)).alias("pos"), F.slice("words", low(p) + 1, p - low(p) + around + 1).alias("near")))))
    candidates = found.join(F.broadcast(rare), "word")  # a block has at most BLOCK windows

    def near_place(start: Column, i: Column) -> Column:
        first = F.greatest(start + i - slop, F.lit(0))
        return F.array_contains(F.slice("near", first + 1, F.greatest(start + i + slop - first + 1, F.lit(0))), F.get("terms", i))
    starts = F.sequence(F.col("pos") - F.col("at") - slop, F.col("pos") - F.col("at") + slop)
    order = F.sequence(F.lit(0), F.size("terms") - 1)
    return candidates.where(F.exists(starts, lambda start: F.forall(order, lambda i: near_place(start, i)))).select("window", "row").distinct()


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, percent: int = 5,
                  block: int = BLOCK, slop: int | None = None) -> DataFrame:
    """Row key, n_words, n_hit, the benchmark items found and the verdict for every row of ``docs``.

    With ``slop``, also ``near_items``: the items of which a window's words all stand within so many
    positions of their places. They don't change the verdict.
    """
    per_item = stored(benchmark_windows(bench.select("item_id", "text"), window), "benchmark-windows")
    distinct = stored(per_item.select("words").distinct().select(
        F.monotonically_increasing_id().alias("window"), "words"), "distinct-windows")
    items = per_item.join(distinct, "words").select("window", "item_id")
    n = distinct.count()
    n_blocks = max(1, -(-n // block))
    words = numbered_words(docs)
    found, near = [], []
    for k in range(n_blocks):
        part = distinct.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == k)
        terms = part.select(F.explode("words").alias("w")).distinct().select(F.xxhash64("w").alias("h"))
        vocabulary = [r.h for r in terms.collect()]  # at most `window` words for each window of a block
        least = part.agg(F.min(F.size("words"))).first()[0] or window
        index = positional_index(words, vocabulary, least)
        found.append(phrase_matches(index, part))
        if slop is not None:
            near.append(near_matches(words, part, slop))
    hits = stored(reduce(DataFrame.unionByName, found), "phrase-matches")
    covered = hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).distinct() \
        .groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))

    def items_of(matches: DataFrame, name: str) -> DataFrame:
        named = matches.select("window", "row").distinct().join(items, "window").select("row", F.col("item_id").cast("string").alias("item_id"))
        return named.distinct().groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias(name))
    per_row = covered.join(items_of(hits, "items"), "row")
    if slop is not None:
        # every exact match is a near one too
        per_row = items_of(stored(reduce(DataFrame.unionByName, near), "proximity-matches"), "near_items").join(per_row, "row", "left")
    per_row = stored(per_row, "contaminated-rows")
    base = words.select("row", "key", "doc_id", "n_words")
    lists = ["items"] if slop is None else ["items", "near_items"]
    out = base.join(per_row, "row", "left").select(
        "key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists])
    return out.select("key", "doc_id", "n_words", "n_hit", *lists,
                      ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"))
