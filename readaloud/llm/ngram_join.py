"""N-gram Jaccard self-join by MinHash banding, with a class for every document.

1. Every text becomes the set of its five-word shingles (a shorter text is one
   shingle), a digest of the set, and its MinHash bands. Band and row counts
   follow from the threshold, the target recall and a budget of hashes.
2. Documents with equal sets are one class of copies from here on: its first
   document stands for it, with the number of copies as weight.
3. Representatives shuffle on band hashes. Each shared band links its members
   to the least of them; the components of those links are the candidate
   groups. Every candidate pair lies inside one.
4. Groups are dealt into blocks of bounded size, and each pair of blocks is one
   unit of work: pairs that share a band are verified on their full shingle
   sets. Only link counts and one edge per linked member leave the unit,
   never the pairs, so a large group of near copies costs rows in proportion to
   its members and blocks.
5. The components of those edges are the classes; every document gets the class of
   its set.

Words are runs of letters, digits and characters beyond ASCII, lower-cased.
Edge cases: null and empty texts have no shingle, link with nothing and are
classes of their own; rows that repeat doc_id and text count as one document;
a null doc_id sorts last and gives a null class_id when it leads its class;
ties go to the least doc_id; an empty table gives an empty result; other
columns are ignored.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_doc_id, row_key, shipped, stored
from .components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
#: A block of a candidate group: at most about so many sets and shingles.
BLOCK_SETS = 128
BLOCK_SHINGLES = 400_000
CACHED_WORDS = 300_000
BATCH_ROWS = 2000
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band whose bands reach the recall at the threshold within the budget."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-threshold ** rows))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no band and row counts reach this recall within the budget of hashes")
    return best


class _Hashes(dict):
    """64-bit word hashes; emptied when full."""

    def __missing__(self, word: str) -> int:
        import xxhash
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h
        return h


def shingles(text: str | None, hashes: _Hashes, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = _WORDS((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ h[k:k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(20_11)
    a = rng.randint(0, 2 ** 63 - 1, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.randint(0, 2 ** 63 - 1, n, dtype=np.int64).astype(np.uint64)


def band_hashes(values: np.ndarray, bands: int, rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band of a shingle set's MinHash signature."""
    low = np.full(bands * rows, 2 ** 64 - 1, np.uint64)
    for i in range(0, len(values), 512):  # a bounded block of the products at a time
        part = values[i:i + 512, None] * a
        part += b
        np.minimum(low, part.min(axis=0), out=low)
    out = np.zeros(bands, np.uint64)
    for column in (low >> np.uint64(20)).reshape(bands, rows).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, doc_id, digest, n, bands) per document; documents without words have no digest."""
    schema = "key decimal(38,0), digest binary, n int, bands array<bigint>"
    names = ["key", "digest", "n", "bands"]

    def run(batches: Iterator[pa.RecordBatch]):
        import hashlib
        hashes, (a, b) = _Hashes(), _coefficients(bands * rows)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                digests, sizes, flat = [], [], []
                for text in batch.column(1):
                    s = shingles(text.as_py(), hashes)
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    flat.append(band_hashes(s, bands, rows, a, b) if len(s) else np.empty(0, np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in flat])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), lists], names)
    return shipped(docs.select(row_key().alias("key"), "text")).mapInArrow(run, schema)


class _Forest:
    """Union-find over the members of one unit of work."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def verify_unit(sets: list[np.ndarray], bands: np.ndarray, weights: np.ndarray, blocks: np.ndarray,
                threshold: Fraction) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weighted link counts of one unit's members, and each linked member with the first of its part of the unit.

    With two blocks only pairs across them are looked at, with one all pairs inside it.
    """
    n, forest = len(sets), _Forest(len(sets))
    counts, sizes = np.zeros(n, np.int64), np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    flag = np.zeros(ids.max() + 1 if len(ids) else 1, bool)
    split = len(set(blocks.tolist())) > 1
    top, bottom = threshold.numerator, threshold.denominator
    for i in range(n - 1):
        near = (bands[i + 1:] == bands[i]).any(axis=1)
        if split:
            near &= blocks[i + 1:] != blocks[i]
        small, large = np.minimum(sizes[i + 1:], sizes[i]), np.maximum(sizes[i + 1:], sizes[i])
        others = i + 1 + np.flatnonzero(near & (small * bottom >= top * large))
        if not len(others):
            continue
        own = ids[ends[i] - sizes[i]:ends[i]]
        flag[own] = True
        # shared shingles of i and each other, summed over the other's slice
        common = np.array([np.count_nonzero(flag[ids[ends[j] - sizes[j]:ends[j]]]) for j in others])
        flag[own] = False
        linked = others[common * bottom >= top * (sizes[i] + sizes[others] - common)]
        counts[i] += weights[linked].sum()
        counts[linked] += weights[i]
        for j in linked.tolist():
            forest.union(i, j)
    return counts, [(i, root) for i in range(n) if (root := forest.find(i)) != i]


def _verified(units: DataFrame, threshold: float) -> DataFrame:
    """(key, links, other): link counts (other null) and edges (links 0) of every unit.

    ``units`` is partitioned and sorted by unit; groups are read off the stream
    one at a time, so a task holds one unit, whose size is bounded.
    """
    limit = Fraction(str(threshold))
    names = ["key", "links", "other"]
    kind = pa.decimal128(38, 0)

    def finish(rows: list, hashes: _Hashes):
        keys = [r[0] for r in rows]
        if len(rows) < 2:
            return None
        sets = [shingles(r[1], hashes) for r in rows]
        counts, edges = verify_unit(sets, np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64),
                                    np.array([r[4] for r in rows]), limit)
        hit = np.flatnonzero(counts).tolist()
        return ([keys[i] for i in hit] + [keys[i] for i, _ in edges], counts[hit].tolist() + [0] * len(edges),
                [None] * len(hit) + [keys[j] for _, j in edges])

    def run(batches: Iterator[pa.RecordBatch]):
        hashes, unit, rows = _Hashes(), None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for comp, left, right, key, text, bands, weight, block in zip(*columns, strict=True):
                if (comp, left, right) != unit:
                    if rows and (out := finish(rows, hashes)) and out[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], names)
                    unit, rows = (comp, left, right), []
                rows.append((key, text, bands, weight, block))
        if rows and (out := finish(rows, hashes)) and out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], names)
    return shipped(units).mapInArrow(run, "key decimal(38,0), links bigint, other decimal(38,0)")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(key, doc_id, copy_id, class_id, n_links, leads) for every distinct document.

    copy_id is the first document with the same shingle set, class_id the first
    document reachable over links of at least ``threshold``, n_links the number of
    other documents at or above it. ``leads`` marks the one document of each class
    that comes first. ``key`` is ``row_key()``.
    """
    docs = docs.select("doc_id", "text")
    bands, rows = choose_bands(threshold, recall)
    signed = stored(signatures(docs, bands, rows).distinct(), "signatures")
    worded = signed.where("digest is not null")
    classes = stored(worded.groupBy("digest").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("weight")), "copy-classes")
    reps = stored(classes.join(signed.select(F.col("key").alias("rep"), "n", "bands"), "rep"), "representatives")

    banded = reps.select("rep", F.posexplode("bands").alias("band", "hash"))
    shared = stored(banded.groupBy("band", "hash").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
                    .where("low != high").select("band", "hash", "low"), "shared-bands")
    links = banded.join(shared, ["band", "hash"]).select(F.col("rep").alias("u"), F.col("low").alias("v")).where("u != v").distinct()
    groups = stored(connected_components(links), "candidate-groups")

    members = groups.join(reps, groups.id == reps.rep).select("component", "rep", "weight", "n", "bands")
    sizes = members.groupBy("component").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("n_blocks"))
    members = members.join(stored(sizes, "group-sizes"), "component").withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    members = stored(members, "candidates")
    texts = docs.select(row_key().alias("rep"), "text").join(members, "rep").dropDuplicates(["rep"])
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda k: F.struct(
        F.least(k, F.col("block")).alias("left"), F.greatest(k, F.col("block")).alias("right")))).alias("unit")
    units = texts.select("component", pairs, "rep", "text", "bands", "weight", "block").select(
        "component", "unit.left", "unit.right", "rep", "text", "bands", "weight", "block")
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.repartition(n_parts, "component", "left", "right").sortWithinPartitions("component", "left", "right", "rep")
    verified = stored(_verified(units, threshold), "verified")

    counts = verified.where("other is null").groupBy("key").agg(F.sum("links").alias("links")).withColumnRenamed("key", "rep")
    trees = connected_components(verified.where("other is not null").select(F.col("key").alias("u"), F.col("other").alias("v")))
    per_class = classes.join(counts, "rep", "left").join(trees.withColumnRenamed("id", "rep"), "rep", "left").select(
        "digest", "rep", F.coalesce("component", "rep").alias("first"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    per_class = stored(per_class, "classes")
    return signed.select("key", "digest").join(per_class, "digest", "left").select(
        "key", key_doc_id(F.col("key")).alias("doc_id"), key_doc_id(F.coalesce("rep", "key")).alias("copy_id"),
        key_doc_id(F.coalesce("first", "key")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        (F.coalesce("first", "key") == F.col("key")).alias("leads"))
