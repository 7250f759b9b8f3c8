"""Line deduplication by pairwise alignment.

1. Every document becomes the sequence of digests of its lines that hold a
   word (white space at the ends of a line doesn't count).
2. At every line, the shortest runs of adjacent lines that start or end there and
   hold ``min_words`` words are grouped by digest: each names the first document
   that holds it. A run held by one document only goes no further. The links
   (later document, first document) are the overlapping pairs; there are at
   most two per line however many documents share a run, so none is too
   frequent to follow. Any block shared with any earlier document consists of such runs,
   so the first holders stand for all earlier documents.
3. Each pair's digest sequences are aligned by patience diff: common ends
   first, then the longest chain of lines that are unique in both, then the
   same between the anchors. What that leaves (repeated or moved passages, gaps without a
   unique line) is looked up among the earlier text's runs, wherever they stand.
4. Shared runs of lines with at least ``min_words`` words are common blocks,
   and the later document loses them. The first holder always keeps them.

"Later" is by doc_id (null last), then by a digest of the text. Rows that
repeat doc_id and text are one document and share its result. Null and empty
texts have no lines and come back empty; a document that is wholly a copy
comes back with no text; an empty table gives an empty result; other columns are
ignored by the operator.
"""
from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, row_key, shipped, space_words, stored, text_or_empty

MIN_WORDS = 20
TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched index pairs of two sequences, ascending in both."""
    out: list[tuple[int, int]] = []
    spans = [(0, len(a), 0, len(b))]
    while spans:
        i, j, k, m = spans.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {x: p for p, x in enumerate(a[i:j], i) if in_a[x] == 1 and in_b[x] == 1}
        unique = [(place[x], q) for q, x in enumerate(b[k:m], k) if x in place]
        chain = _longest_chain(unique)
        for p, q in chain:
            spans.append((i, p, k, q))
            out.append((p, q))
            i, k = p + 1, q + 1
        if chain:
            spans.append((i, j, k, m))
    return sorted(out)


def _longest_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given in the order of their second part, that also ascends in the first."""
    tops, ends, back = [], [], []
    for n, (p, _) in enumerate(pairs):
        pile = bisect_left(tops, p)
        tops[pile:pile + 1] = [p]
        ends[pile:pile + 1] = [n]
        back.append(ends[pile - 1] if pile else -1)
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def shortest_runs(words: list[int], min_words: int) -> set[tuple[int, int]]:
    """(start, end) of the shortest runs with ``min_words`` words that start or end at each line.

    Every line of a longer run lies in one of them that is wholly inside it.
    """
    out: set[tuple[int, int]] = set()
    end = total = 0
    for start, n in enumerate(words):
        while end < len(words) and total < min_words:
            total += words[end]
            end += 1
        if total >= min_words:
            out.add((start, end))
        total -= n
    start = total = 0
    for end, n in enumerate(words, 1):
        total += n
        while total - words[start] >= min_words:
            total -= words[start]
            start += 1
        if total >= min_words:
            out.add((start, end))
    return out


def _runs_anywhere(first: list, later: list, words: list[int], min_words: int) -> set[int]:
    """Indexes in ``later`` of the lines in shortest runs that stand anywhere in ``first``."""
    held: dict[int, set[tuple]] = {}
    out: set[int] = set()
    for start, end in shortest_runs(words, min_words):
        size = end - start  # at most min_words, every line holds a word
        if size not in held:
            held[size] = {tuple(first[i:i + size]) for i in range(len(first) - size + 1)}
        if tuple(later[start:end]) in held[size]:
            out.update(range(start, end))
    return out


def common_blocks(first: list, later: list, words: list[int], min_words: int) -> list[int]:
    """Indexes in ``later`` of the lines in runs with at least ``min_words`` words that ``first`` holds too."""
    out: set[int] = set()
    run: list[int] = []
    before = None
    for p, q in [*patience(first, later), (-1, -1)]:
        if before is None or (p, q) != (before[0] + 1, before[1] + 1):
            if sum(words[x] for x in run) >= min_words:
                out.update(run)
            run = []
        run.append(q)
        before = (p, q)
    if len(out) < len(later):
        out |= _runs_anywhere(first, later, words, min_words)
    return sorted(out)


def line_table(docs: DataFrame) -> DataFrame:
    """(key, lines, words, at): digest, word count and line number of the lines that hold a word, per distinct document."""
    split = F.split(text_or_empty(), "\n")
    worded = F.filter(F.transform(split, lambda s, i: F.struct(F.regexp_replace(s, TRIM, "").alias("line"), i.alias("at"))),
                      lambda x: x["line"] != "")
    rows = docs.select(row_key().alias("key"), worded.alias("worded")).where(F.size("worded") > 0)
    return rows.select("key", F.transform("worded", lambda x: F.unhex(F.md5(x["line"]))).alias("lines"),
                       F.transform("worded", lambda x: F.size(space_words(x["line"]))).alias("words"),
                       F.col("worded.at").alias("at"))


def _run_marks(min_words: int) -> Column:
    """The digests of a document's shortest runs, as ``shortest_runs`` gives them."""
    lines, words = F.col("lines"), F.col("words")
    places = F.sequence(F.lit(1), F.size("lines"))

    def length(ws: Column) -> Column:
        seen = F.aggregate(ws, F.struct(F.lit(0).alias("n"), F.lit(0).alias("total")), lambda s, x: F.when(
            s["total"] >= min_words, s).otherwise(F.struct((s["n"] + 1).alias("n"), (s["total"] + x).alias("total"))))
        return bound(seen, lambda s: F.when(s["total"] >= min_words, s["n"]))

    def digest(run: Column) -> Column:
        return bound(run, lambda r: F.when(F.size(r) == 1, F.get(r, 0)).when(F.size(r) > 1, F.unhex(F.md5(
            F.aggregate(r, F.expr("X''"), lambda s, x: F.concat(s, x))))))

    def onward(i: Column) -> Column:
        return bound(length(F.slice(words, i, F.lit(min_words))), lambda k: digest(F.slice(lines, i, k)))

    def back(i: Column) -> Column:
        ahead = F.reverse(F.slice(words, F.greatest(F.lit(1), i - min_words + 1), F.least(i, F.lit(min_words))))
        return bound(length(ahead), lambda k: digest(F.slice(lines, i - k + 1, k)))
    alone = lambda i: F.get(words, i - 1) >= min_words
    return F.array_distinct(F.array_compact(F.concat(
        F.transform(places, lambda i: F.when(alone(i), F.get(lines, i - 1)).otherwise(onward(i))),
        F.transform(places, lambda i: F.when(~alone(i), back(i))))))


def overlapping_pairs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, first): every document with the first holders of its shortest runs."""
    marks = lines.select("key", F.explode(_run_marks(min_words)).alias("mark"))
    shared = stored(marks.groupBy("mark").agg(F.min("key").alias("first"), F.max("key").alias("last"))
                    .where("first != last").select("mark", "first"), "shared-lines")
    return marks.join(shared, "mark").where("key != first").select("key", "first").distinct()


def deleted_lines(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, gone): the sorted numbers of the lines that each later document loses."""
    pairs = stored(overlapping_pairs(lines, min_words), "overlapping-pairs")
    both = pairs.join(lines, "key").join(
        lines.select(F.col("key").alias("first"), F.col("lines").alias("first_lines")), "first").select(
        "key", "first_lines", "lines", "words", "at")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            gone = []
            for a, b, w, at in zip(*batch.columns[1:], strict=True):
                numbers = at.as_py()
                gone.append([numbers[i] for i in common_blocks(a.as_py(), b.as_py(), w.as_py(), min_words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])
    aligned = shipped(both).mapInArrow(run, "key decimal(38,0), gone array<int>").where(F.size("gone") > 0)
    # a document has at most two partners a line, so its lists are bounded by its own length
    return aligned.groupBy("key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def _without(lines: Column, gone: Column) -> Column:
    """The lines whose numbers are not in the sorted array ``gone``: the slices between its entries."""
    marks = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    return bound(marks, lambda m: F.flatten(F.transform(m, lambda p, k: F.slice(
        lines, p + 2, F.greatest(F.lit(0), F.coalesce(F.get(m, k + 1) - p - 1, F.lit(0)))))))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with ``text`` shortened, ``n_lines`` (lines that hold a word) and ``n_removed``.

    Lines go with their break; all other lines, blank ones too, stay as they
    are. Input columns called n_lines or n_removed are replaced.
    """
    lines = stored(line_table(docs.select("doc_id", "text")).dropDuplicates(["key"]), "lines")
    gone = stored(deleted_lines(lines, min_words), "deleted-lines")
    per_doc = stored(lines.select("key", F.size("lines").alias("n_lines")).join(gone, "key", "left"), "line-counts")
    rows = docs.select(row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(per_doc, "key", "left")
    text = F.col("row.text")
    shorter = F.when(F.col("gone").isNull(), text).otherwise(
        F.array_join(bound(F.split(text, "\n"), lambda x: _without(x, F.col("gone"))), "\n"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*[shorter.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in own],
                       F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"))
