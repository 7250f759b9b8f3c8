"""Language of a text by a string kernel: blended-spectrum presence, Nyström landmarks, kernel ridge regression.

Two texts are as alike as the n-grams they share: k(x, y) = |G(x) ∩ G(y)| / sqrt(|G(x)| |G(y)|),
where G holds the character n-grams of 1 to ``MAX_N`` of a whole text that belong to the model's
``GRAMS`` grams. Text is lower-cased; everything of ASCII that is no letter is one space per run, and the text stands between spaces.

**Fit.** A bounded, deterministic sample of the rows given for learning (:func:`sample`): the ``LANGUAGES`` commonest labels, ``SAMPLE_ROWS`` distinct
texts with a letter over all labels (at least 4 a label), those of the smallest digests, and of a text at most ``SAMPLE_CHARS``
characters. On the driver, whose work is bounded by these numbers: the grams of most sample texts make the universe, ``LANDMARKS``
sample texts (dealt evenly over the labels) the landmarks, K the kernel of sample and landmarks, W that of the landmarks. Features K W^(-1/2) and
one ridge regression per label on targets 1 and -1 give a weight per landmark and label.

**Scoring.** A batch's scores are (X P) B with X the batch's presence matrix (texts by grams), P the landmarks' (grams by landmarks, scaled)
and B the weights. P B is multiplied once, so a batch costs one sparse matrix product with a matrix of grams by labels, rounded to multiples of 2^-32 so that the
sums are exact and don't depend on the batch. It is row-local: no shuffle; the model is at most ``GRAMS`` x ``LANGUAGES`` doubles.

**Rows.** ``und`` and score 0 where the text is null or without a letter, and everywhere if nothing could be learned. Equal scores take the smaller label. A null
doc_id counts as the empty text in the held-out rule. Repeated rows are a row each; long texts are read whole, a million characters at a time. Other
columns of the input, whatever their names, play no part; language, source and doc_id are never inputs of a prediction.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shipped

MAX_N = 4
GRAMS = 32_768
LANDMARKS = 256
RIDGE = 1e-4
SAMPLE_ROWS = 1024
SAMPLE_CHARS = 20_000
LANGUAGES = 256
#: Parts of a label that are ranked on their own.
PARTS = 64
UNKNOWN = "und"
LETTER = r"\p{L}"

_SLOT_BITS = 22
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1_000_000

Batches = Iterator[pa.RecordBatch]


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id's text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def gram_hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a text, with repeats, in pieces of bounded size."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes < 97) | ((codes > 122) & (codes < 128)), np.uint32(32), codes)
    space = codes == 32
    codes = codes[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint64)
    for at in range(0, len(codes), _PIECE):
        piece = codes[at:at + _PIECE + MAX_N - 1]
        level = np.zeros(len(piece), np.uint64)
        for n in range(1, MAX_N + 1):
            level = level[:len(piece) - n + 1] * _STEP + piece[n - 1:] + np.uint64(1)
            if not len(level):
                break
            yield level


@dataclass(frozen=True)
class Universe:
    """The grams of a model; ``slots`` finds a hash by its upper bits in one step (a gram whose slot is taken is left out)."""

    hashes: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> Universe:
        slot = (hashes * _STEP) >> np.uint64(64 - _SLOT_BITS)
        _, first = np.unique(slot, return_index=True)
        hashes = hashes[np.sort(first)]
        slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        slots[(hashes * _STEP) >> np.uint64(64 - _SLOT_BITS)] = np.arange(len(hashes))
        return cls(hashes, slots)

    def present(self, text: str) -> np.ndarray:
        """The ids of the grams in a text, ascending."""
        seen = np.zeros(len(self.hashes), np.bool_)
        for hashes in gram_hashes(text) if len(seen) else ():
            ids = self.slots[(hashes * _STEP) >> np.uint64(64 - _SLOT_BITS)]
            seen[ids[(ids >= 0) & (self.hashes[ids] == hashes)]] = True
        return np.flatnonzero(seen)


@dataclass(frozen=True)
class Model:
    labels: list[str]
    hashes: np.ndarray
    #: grams by labels
    weights: np.ndarray


def _presence(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float32)
    for i, ids in enumerate(rows):
        out[i, ids] = 1
    return out


def _unit(counts: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(counts, 1))


def fit(rows: list[tuple[str, str]]) -> Model:
    """The model of (label, text) rows, which the caller has bounded."""
    rows = sorted(rows)
    labels = sorted({label for label, _ in rows}, key=str.encode)
    found: dict[int, int] = {}
    for _, text in rows:
        for h in np.unique(np.concatenate([*gram_hashes(text)])).tolist():
            found[h] = found.get(h, 0) + 1
    common = sorted(found, key=lambda h: (-found[h], h))[:GRAMS]
    universe = Universe.of(np.array(common, np.uint64))
    width = len(universe.hashes)
    grams = [universe.present(text) for _, text in rows]
    size = np.array([len(g) for g in grams])
    # landmarks: the first of each label, then the second, and so on
    turn: dict[str, int] = {}
    order = []
    for i, (label, _) in enumerate(rows):
        turn[label] = turn.get(label, -1) + 1
        order.append((turn[label], label, i))
    chosen = [i for _, _, i in sorted(order)[:LANDMARKS]]
    marks = _presence([grams[i] for i in chosen], width) * _unit(size[chosen])[:, None].astype(np.float32)
    kernel = np.concatenate([_presence(grams[at:at + 128], width) @ marks.T for at in range(0, len(rows), 128)]).astype(np.float64)
    kernel *= _unit(size)[:, None]
    inner, axes = np.linalg.eigh((kernel[chosen] + kernel[chosen].T) / 2)
    used = inner > 1e-6 * inner[-1]
    root = axes[:, used] / np.sqrt(inner[used])
    features = kernel @ root
    targets = np.where(np.array([label for label, _ in rows])[:, None] == np.array(labels)[None, :], 1.0, -1.0)
    ridge = features.T @ features + RIDGE * len(rows) * np.eye(features.shape[1])
    weights = root @ np.linalg.solve(ridge, features.T @ targets)
    folded = marks.T.astype(np.float64) @ weights
    return Model(labels, universe.hashes, np.round(folded * 2.0 ** 32) / 2.0 ** 32)


def scores(model: Model, universe: Universe, texts: list[str]) -> np.ndarray:
    """Texts by labels: the batch's sparse presence matrix times the folded weights."""
    grams = [universe.present(t) for t in texts]
    size = np.array([len(g) for g in grams])
    out = np.zeros((len(texts), len(model.labels)))
    some = size > 0
    if some.any():
        starts = np.concatenate(([0], np.cumsum(size[some])[:-1]))
        out[some] = np.add.reduceat(model.weights[np.concatenate(grams)], starts, axis=0)
    return out * _unit(size)[:, None]


def _predictor(model: Model) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        universe = Universe.of(model.hashes)
        for batch in batches:
            columns = {n: batch[n] for n in batch.schema.names if n != "text"}
            texts, best, score = batch["text"].to_pylist(), [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            wanted = [i for i, t in enumerate(texts) if t is not None] if model.labels else []
            for at in range(0, len(wanted), 256):
                part = wanted[at:at + 256]
                found = scores(model, universe, [texts[i] for i in part])
                for i, row in zip(part, found, strict=True):
                    best[i] = model.labels[int(row.argmax())]
                    score[i] = min(max((row.max() + 1) / 2, 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(best, pa.string()), pa.array(score)], [*columns, "lang_pred", "score"])
    return run


def sample(rows: DataFrame) -> list[tuple[str, str]]:
    """The sample of (lang, text) rows that the fit sees; see the module for its bounds."""
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    common = [r["lang"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]
    if not common:
        return []
    share = max(4, SAMPLE_ROWS // len(common))
    named = usable.where(F.col("lang").isin(common)).select("lang", "text", F.xxhash64("text").alias("digest"))
    # digests first: copies of a text are one candidate, and texts are fetched for the sample alone
    # ranked within parts of a label first, so that a label of most rows is dealt over tasks and the last ranking sees few of them
    part = F.row_number().over(Window.partitionBy("lang", "part").orderBy("digest"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("digest"))
    parts = named.select("lang", "digest").distinct().withColumn("part", F.pmod("digest", F.lit(PARTS))).withColumn("place", part).where(F.col("place") <= share)
    chosen = parts.withColumn("place", place).where(F.col("place") <= share).select("lang", "digest")
    # at most SAMPLE_ROWS (or 4 a label) rows of two columns
    texts = named.join(F.broadcast(chosen), ["lang", "digest"]).groupBy("lang", "digest").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text"))
    return [(r["lang"], r["text"]) for r in texts.collect()]


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with ``lang_pred`` and ``score``."""
    rows = docs.select(*keep, F.when(F.col("text").rlike(LETTER), F.col("text")).alias("text"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return shipped(rows).mapInArrow(_predictor(model), f"{schema}, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score, learned from the rows that aren't held out."""
    docs = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    learned = sample(docs.where(~F.col("held_out")).select("lang", "text"))
    model = fit(learned) if learned else Model([], np.zeros(0, np.uint64), np.zeros((0, 0)))
    return identify(docs, model, ("doc_id", "held_out"))
