"""Language identification by character-trigram naive Bayes, trained and scored in Spark.

Training counts trigrams of every labelled text, whole and lower-cased
(an explode and a partial aggregate); the profile holds, per trigram and
language, the integer log-weight above that language's unseen-trigram weight.
Scoring explodes each text's trigrams, joins them with the profile and sums:
``score(lang) = n_trigrams * base(lang) + sum(delta)``. Weights are integers
(thousandths of a natural log), so sums are exact and order-independent.

The profile is an aggregate whose size is bounded by the trigram alphabet, not
by the corpus, and known after training. Up to ``MAX_BROADCAST_BYTES`` it is sent
to every task: a document's trigrams are then looked up and summed where the
document was read, and one row per document is shuffled. A larger profile is joined
by trigram, with the trigrams of a document counted first.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_LANGUAGE, LANGUAGE_SAMPLE_CHARS
from ..session import ensure_checkpoint_dir

SCALE = 1000.0


def whole(text: Column) -> Column:
    """Space-padded lower-case text; training reads all of it."""
    return F.concat(F.lit(" "), F.lower(text), F.lit(" "))


def sample(text: Column) -> Column:
    """Space-padded lower-case prefix that detection reads (a rule of the method)."""
    return F.concat(F.lit(" "), F.lower(F.substring(text, 1, LANGUAGE_SAMPLE_CHARS)), F.lit(" "))


def trigrams(s: Column) -> Column:
    """All overlapping 3-character windows, in one regex pass (a look-ahead capture)."""
    return F.regexp_extract_all(s, F.lit("(?s)(?=(.{3}))"), 1)


def _explode_trigrams(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key..., tri) rows. The outer explode plus a filter on its output keeps the
    optimizer from pushing an inferred non-empty filter (and with it the whole
    cleaning expression) below the projection, where it would run twice."""
    s = df.select(*key, F.explode_outer(trigrams(whole(F.col(text)))).alias("tri"))
    return s.where(F.col("tri").isNotNull())


class LanguageModel:
    """Pivoted trigram profile plus the per-language constants.

    ``profile`` has one row per trigram and one delta column per language
    (0 where the trigram was never seen with that language), so the scoring
    join emits one row per document trigram regardless of the number of
    languages. ``bases`` and ``n_trigrams`` are collected once after training;
    their size is bounded by the label set.
    """

    def __init__(self, profile: DataFrame, langs: list[str], bases: dict[str, int], n_trigrams: int):
        self.profile = profile
        self.langs = langs
        self.bases = bases
        self.n_trigrams = n_trigrams

    def is_small(self) -> bool:
        return self.n_trigrams * (64 + 8 * len(self.langs)) <= MAX_BROADCAST_BYTES


#: A larger profile (a trigram and a number per label in each row) is not sent to every task.
MAX_BROADCAST_BYTES = 32 * 1024 * 1024

#: More labels than this would make the profile's columns a plan of their own.
MAX_LABELS = 400


def _col(place: int) -> str:
    """The delta column of the label in that place of the sorted label set (labels may look alike as column names)."""
    return f"d_{place}"


def train(labelled: DataFrame, text: str = "text", label: str = "lang") -> LanguageModel:
    """Count trigrams per language in one pass; the counts are small and checkpointed."""
    ensure_checkpoint_dir(labelled.sparkSession)
    tri = _explode_trigrams(labelled.where(F.col(label).isNotNull()), [label], text).withColumnRenamed(label, "lang")
    counts = tri.groupBy("tri", "lang").agg(F.count(F.lit(1)).alias("c")).checkpoint()
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("c").alias("total")).collect()}
    v = counts.select("tri").distinct().count()
    langs = sorted(totals)
    if len(langs) > MAX_LABELS:
        raise ValueError(f"{len(langs)} labels, more than {MAX_LABELS}")
    bases = {lang: int(_round_half_away(math.log(1.0 / (totals[lang] + v)) * SCALE)) for lang in langs}
    total_of = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(totals[k]))])
    base_of = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(bases[k]))])
    w = F.round(F.log((F.col("c") + 1.0) / (F.element_at(total_of, F.col("lang")) + F.lit(v))) * SCALE).cast("bigint")
    deltas = counts.select("tri", "lang", (w - F.element_at(base_of, F.col("lang"))).alias("delta"))
    columns = [F.sum(F.when(F.col("lang") == k, F.col("delta")).otherwise(F.lit(0).cast("bigint"))).alias(_col(i)) for i, k in enumerate(langs)]
    profile = deltas.groupBy("tri").agg(*(columns or [F.lit(0).alias(_col(0))]))
    return LanguageModel(profile, langs, bases, v)


def _round_half_away(x: float) -> float:
    return math.floor(x + 0.5) if x >= 0 else -math.floor(-x + 0.5)


def detect(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, detected) for every row; rows without a trigram get the default language.

    score(lang) = n_trigrams * base(lang) + sum of the matched deltas; the
    best score wins, ties to the greater language code. Before a shuffle join trigrams
    are counted per document; a document without any keeps one NULL row,
    and columns besides ``key`` and ``text`` come through. Rows that repeat a key
    are told apart by a number given in the one scan that reads them.
    """
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    tri = numbered.select(*[c for c in numbered.columns if c != text], F.explode_outer(trigrams(sample(F.col(text)))).alias("tri"))
    kept = [c for c in docs.columns if c not in (key, text)]
    if model.is_small():
        hits = tri.withColumn("n", F.lit(1)).join(F.broadcast(model.profile), "tri", "left")
    else:
        hits = tri.groupBy("_row", key, *kept, "tri").agg(F.count(F.lit(1)).alias("n")).join(model.profile, "tri", "left")
    sums = hits.groupBy("_row", key, *kept).agg(
        F.sum(F.when(F.col("tri").isNotNull(), F.col("n")).otherwise(0)).alias("n_tri"),
        *[F.sum(F.col("n") * F.col(_col(i))).alias(_col(i)) for i in range(len(model.langs))])
    scores = F.array(*[F.struct((F.col("n_tri") * F.lit(model.bases[k]) +
                                 F.coalesce(F.col(_col(i)), F.lit(0).cast("bigint"))).alias("score"),
                                F.lit(k).alias("lang")) for i, k in enumerate(model.langs)])
    best = F.array_max(scores)["lang"] if model.langs else F.lit(DEFAULT_LANGUAGE)
    return sums.select(key, *kept, F.when(F.col("n_tri") == 0, F.lit(DEFAULT_LANGUAGE)).otherwise(best).alias("detected"))
