"""Quality rules with a distribution-divergence verdict, in DataFrame expressions only.

Two passes over the text. The first counts the words of every language over
the whole corpus, whatever their length, and keeps each language's most common ones; the second turns each document into a few
numbers: the base rules, a histogram of character classes and a histogram of
its language's common words. The references are the same histograms summed over all
documents of a language. A document is kept if it passes the base rules and
the Jensen-Shannon distances between its histograms and its language's
references stay under the limits; texts too short for a histogram, and texts of a
language with under 1,000 words in all, are not judged by it (minimum-length guards).

Everything per document is row-local: the only shuffles are partial
aggregates (words per language, sums per language), so a source or language
holding a third of all rows is combined before it moves.

Edge cases: a null text has no words and fails; rows without a language
are compared with each other; however small its share, a language is compared
with its own reference only; rows that repeat are judged one by one; an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, constant_array, row_key, space_words, stored, text_or_empty

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
#: One printable character stands for each common word.
CODES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-"
#: Words below which a language's histograms say too little to judge a document by.
MIN_REFERENCE_WORDS = 1000
WINDOW = 5


def _windows(hashes: Column) -> Column:
    """One hash per window of five consecutive words."""
    def all_windows(hs: Column) -> Column:
        return F.slice(F.transform(hs, lambda h, i: F.xxhash64(h, *[F.get(hs, i + k) for k in range(1, WINDOW)])),
                       F.lit(1), F.greatest(F.size(hs) - (WINDOW - 1), F.lit(0)))
    return bound(hashes, all_windows)


def _repeat_words(windows: Column) -> Column:
    """Words inside windows that occur at least twice: sort windows, mark equal neighbours, add up their cover."""
    def starts(s: Column) -> Column:
        return F.sort_array(F.filter(F.transform(s, lambda x, k: F.when(
            (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda p: p.isNotNull()))

    def cover(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
                           F.lit(0), lambda a, b: a + b)

    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), bound(bound(ranked, starts), cover)).otherwise(0)
    return bound(windows, covered)


def _count_in(marks: Column, chars: str) -> Column:
    return F.length(marks) - F.length(F.translate(marks, chars, ""))


def common_words(docs: DataFrame, k: int = len(CODES)) -> DataFrame:
    """(lang, common_words): hashes of the k words found in the most documents of each language, commonest first."""
    hashes = F.transform(space_words(text_or_empty()), lambda w: F.xxhash64(w))
    words = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(F.array_distinct(hashes)).alias("word"))
    # each task keeps its k commonest per language before they move
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    top = words.groupBy("lang", "word").count().withColumn("rank", rank).where(F.col("rank") <= k)
    return top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("top")).select(  # k a language
        "lang", F.col("top.word").alias("common_words"))


def features(docs: DataFrame, words: DataFrame) -> DataFrame:
    """One narrow row per document: base measures, class histogram and histogram of its language's common words."""
    codes = constant_array(list(CODES), "string")
    text = F.col("_text")
    marks = F.array_join(F.regexp_extract_all(text, F.lit(r"([0-9A-Z.,;:!?'\"()\-#*$%&|<>])"), 1), "")
    base = docs.select(row_key().alias("key"), "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text_or_empty().alias("_text"))
    base = base.join(words, "lang", "left").withColumn("common_words", F.coalesce("common_words", F.array().cast("array<bigint>")))
    one = base.select("key", "doc_id", "lang", "common_words", F.length(text).alias("n_chars"),
                      (F.octet_length(text) - F.length(text)).alias("wide"), marks.alias("marks"),
                      F.split(text, "\n").alias("lines"), space_words(text).alias("words"))
    worded = F.filter("lines", lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    n_dup = F.when(F.size(F.array_distinct("lines")) < F.size("lines"),
                   bound(worded, lambda s: F.size(s) - F.size(F.array_distinct(s)))).otherwise(0)
    two = one.select("key", "doc_id", "lang", "common_words", "n_chars", "wide", "marks", n_dup.cast("bigint").alias("n_dup_lines"),
                     F.size("words").cast("bigint").alias("n_words"),
                     F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
                     F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    coded = F.array_join(F.transform("hashes", lambda h: F.get(codes, F.array_position("common_words", h).cast("int") - 1)), "")
    three = two.select("key", "doc_id", "lang", "n_chars", "wide", "marks", "n_dup_lines", "n_words", "word_chars",
                       coded.alias("coded"), _windows(F.col("hashes")).alias("windows"))
    three = three.select("*", _repeat_words(F.col("windows")).cast("bigint").alias("n_repeat_words"))
    n_coded = F.length("coded")
    counts = [n_coded - F.length(F.replace(F.col("coded"), F.lit(c), F.lit(""))) for c in CODES]
    digits, upper = _count_in(F.col("marks"), "0123456789"), _count_in(F.col("marks"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    symbols, points = _count_in(F.col("marks"), SYMBOLS), _count_in(F.col("marks"), PUNCTUATION)
    blank = F.col("n_chars") - F.col("word_chars")
    return three.select(
        "key", "doc_id", "lang", "n_words", "word_chars", symbols.cast("bigint").alias("n_symbols"), "n_dup_lines",
        "n_repeat_words", F.col("n_chars").cast("bigint").alias("n_chars"),
        F.array(*[c.cast("bigint") for c in (
            blank, digits, upper, symbols, points, F.col("wide"),
            F.col("word_chars") - F.length("marks"))]).alias("classes"),
        F.array(*[c.cast("bigint") for c in counts], F.col("n_words") - n_coded).alias("common"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two count arrays; null where either is empty."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def terms(p: Column, q: Column, sp: Column, sq: Column) -> Column:
        def part(x: Column, y: Column) -> Column:
            return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
        return F.zip_with(p, q, lambda a, b: F.when((a > 0) | (b > 0), part(a / sp, b / sq) + part(b / sq, a / sp))
                          .otherwise(0.0))
    # the totals are bound, or the terms' lambda would add them up anew for every bin
    return bound(total(p), lambda sp: bound(total(q), lambda sq: F.when(
        (sp > 0) & (sq > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms(p, q, sp, sq)) / 2)))))


def quality_rules(docs: DataFrame, max_class_distance: float = 0.3, max_word_distance: float = 0.5,
                  min_chars: int = 200, min_words: int = 100, min_kept_words: int = 10,
                  max_repeat_percent: int = 20, min_reference_words: int = MIN_REFERENCE_WORDS) -> DataFrame:
    """Row key, base measures, distances and the verdict for every row of ``docs`` (doc_id, text, lang)."""
    docs = docs.select("doc_id", "text", "lang")
    words = stored(common_words(docs), "quality-words")
    rows = stored(features(docs, words), "quality-features")
    width = len(CODES) + 1
    per_lang = rows.groupBy("lang").agg(
        F.sum("n_words").alias("ref_words"),
        F.array(*[F.sum(F.get("classes", F.lit(i))) for i in range(7)]).alias("ref_classes"),
        F.array(*[F.sum(F.get("common", F.lit(i))) for i in range(width)]).alias("ref_common"))
    references = stored(per_lang.where(F.col("ref_words") >= min_reference_words).drop("ref_words"), "quality-references")
    judged = rows.join(references, "lang", "left")  # no reference: null distances, no verdict
    judged = judged.select(
        "key", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < min_kept_words)
         | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))).alias("base_failed"),
        F.when(F.col("n_chars") >= min_chars, js_distance(F.col("classes"), F.col("ref_classes"))).alias("class_distance"),
        F.when(F.col("n_words") >= min_words, js_distance(F.col("common"), F.col("ref_common"))).alias("word_distance"))
    return judged.select(
        "key", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance)
         & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)).alias("kept"),
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))
