"""An unsupervised sentence splitter: abbreviations, collocations and sentence starters learned from the texts.

The plain rule ends a sentence after ``. ! ?`` and white space. What a period after a word means is learned from counts over
a whole corpus, by likelihood ratios per type (Kiss and Strunk, 2006):

* a type that nearly always ends with a period, is short and rarely stands without one is an *abbreviation*;
* a type that follows sentence ends more often than chance is a *starter*;
* a number or initial and the word after its period that keep together are a *collocation*.

A break of the plain rule is taken back after an abbreviation, unless a capitalised starter follows, and inside a
collocation. Counting is hash aggregation with partial sums; splitting is row-local, with the model as literals up to
``MAX_LITERALS`` entries and by joins on the types around each break beyond that.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import WS, let
from ..functions.text import SENTENCE_BREAK

MIN_ABBREVIATION = 0.3
MIN_STARTER = 30.0
MIN_COLLOCATION = 7.88
#: A model of more entries is joined instead of written into the plan.
MAX_LITERALS = 1000
#: Up to so many entries (about 10 MB) the join sends the model to every task; beyond that both sides are shuffled by type.
MAX_BROADCAST = 100_000

_OUTER = "\"'()[]{}«»“”‘’*"
_WORD = r"^\p{L}[\p{L}.]*$"
_NUMBER = r"^\p{Nd}+$"


def _ends(word: Column) -> Column:
    return F.endswith(word, F.lit(".")) | F.endswith(word, F.lit("!")) | F.endswith(word, F.lit("?"))


def _type(word: Column) -> Column:
    """Lower case, without the last mark that may end a sentence."""
    return F.lower(F.when(_ends(word), F.left(word, F.length(word) - 1)).otherwise(word))


def _words(text: Column) -> Column:
    """The words that have a type; trimming and the test are all that is done per array element, the rest per row."""
    return F.filter(F.transform(F.split(text, rf"{WS}+", -1), lambda w: F.btrim(w, F.lit(_OUTER))), lambda w: ~w.isin("", ".", "!", "?"))


def _xlny(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.ln(y))


def _likelihood(hits: Column, n: Column, p: Column) -> Column:
    return _xlny(hits, p) + _xlny(n - hits, 1 - p)


def _ratio(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """How much better b is explained by following a (ab times of a) than by its rate among all n."""
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
    return 2 * (_likelihood(ab, a, p1) + _likelihood(b - ab, n - a, p2) - _likelihood(ab, a, p) - _likelihood(b - ab, n - a, p))


def sentence_model(texts: DataFrame, text: str = "text") -> DataFrame:
    """(kind, type, follower, score) learned from a column of texts; kind is abbreviation, starter or collocation."""
    # an outer explode: a plain one has the words computed a second time to see whether there are any
    words = texts.select(F.explode_outer(let(_words(F.col(text)), lambda ws: F.transform(ws, lambda w, i: F.struct(
        w.alias("word"), F.get(ws, i + 1).alias("next"))))).alias("t")).where(F.col("t").isNotNull()).select("t.*")
    # one pass over the texts, with partial sums; only what stands after a possible end is ever asked for, so only there the pair is kept
    ends = _ends(F.col("word"))
    pairs = words.groupBy(_type(F.col("word")).alias("type"), F.endswith("word", F.lit(".")).alias("dot"), ends.alias("ends"),
                          F.when(ends, _type(F.col("next"))).alias("next")).agg(F.count("*").alias("n")).transform(_reused)
    types = pairs.groupBy("type").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("dots"))
    total = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("dots"), F.lit(0)).alias("dots")).first()  # one row
    all_n, all_dots = F.lit(float(total["n"])), F.lit(float(total["dots"]))
    bare = F.length(F.replace("type", F.lit(".")))
    ratio = 2 * (_likelihood(F.col("dots"), F.col("n"), F.lit(0.99)) - _likelihood(F.col("dots"), F.col("n"), all_dots / all_n))
    score = ratio * F.exp(-bare.cast("double")) * (F.length("type") - bare + 1) * F.pow(bare.cast("double"), -(F.col("n") - F.col("dots")).cast("double"))
    abbreviations = types.where((F.col("dots") > 0) & (F.col("dots") < all_dots) & F.col("type").rlike(_WORD) & (all_dots < all_n)) \
        .select("type", score.alias("score")).where(F.col("score") >= MIN_ABBREVIATION)

    known = abbreviations.select(F.col("type").alias("abbreviation"))
    ends = pairs.where(F.col("ends") & F.col("next").isNotNull()).join(known, F.col("type") == F.col("abbreviation"), "left_anti")
    after = ends.groupBy(F.col("next").alias("type")).agg(F.sum("n").alias("ab"))
    breaks = F.lit(float(ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("a")).first()["a"]))  # one number
    starters = after.join(types, "type").where((F.col("ab") / breaks > F.col("n") / all_n) & (breaks < all_n) & F.col("type").rlike(_WORD))
    starters = starters.select("type", _ratio(breaks, F.col("n"), F.col("ab"), all_n).alias("score")).where(F.col("score") >= MIN_STARTER)

    # a number or initial with a period, and what follows it
    split = pairs.where(F.col("dot") & F.col("next").rlike(_WORD) & (F.col("type").rlike(_NUMBER) | F.col("type").rlike(r"^\p{L}$"))) \
        .groupBy("type", "next").agg(F.sum("n").alias("ab")).where(F.col("ab") > 1)
    first = types.select("type", F.col("n").alias("a"))
    second = types.select(F.col("type").alias("next"), F.col("n").alias("b"))
    bound = split.join(first, "type").join(second, "next").where((F.col("ab") / F.col("a") > F.col("b") / all_n) & (F.col("a") < all_n))
    bound = bound.select("type", "next", _ratio(F.col("a"), F.col("b"), F.col("ab"), all_n).alias("score")).where(F.col("score") >= MIN_COLLOCATION)
    none = F.lit(None).cast("string").alias("follower")
    return abbreviations.select(F.lit("abbreviation").alias("kind"), "type", none, "score") \
        .unionByName(starters.select(F.lit("starter").alias("kind"), "type", none, "score")) \
        .unionByName(bound.select(F.lit("collocation").alias("kind"), "type", F.col("next").alias("follower"), "score"))


def _reused(df: DataFrame) -> DataFrame:
    """The counts feed several parts of the model: written once to the shared checkpoint folder instead of counted again."""
    return df.checkpoint()


def _last_word(piece: Column) -> Column:
    return F.btrim(F.element_at(F.split(piece, rf"{WS}+", -1), -1), F.lit(_OUTER))


def _first_word(piece: Column) -> Column:
    return F.btrim(F.element_at(F.split(piece, rf"{WS}+", 2), 1), F.lit(_OUTER))


def _breaks(pieces: Column) -> Column:
    """(place, left, right, capital) of the breaks after a period: its piece's place, the types on either side, and the right word's first letter."""
    def at(i):
        return let(F.struct(_last_word(F.get(pieces, i - 1)).alias("l"), _first_word(F.get(pieces, i)).alias("r")), lambda x: F.struct(
            i.alias("place"), F.lower(F.regexp_replace(x["l"], r"\.$", "")).alias("left"), _type(x["r"]).alias("right"),
            x["r"].rlike(r"^\p{Lu}").alias("capital")))
    after = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: (i > 0) & F.endswith(F.get(pieces, i - 1), F.lit(".")))
    return F.filter(F.transform(after, at), lambda x: x["left"] != "")


def _glues(left, right, capital, is_abbreviation, is_starter, is_pair) -> Column:
    return (is_abbreviation(left) & ~(capital & is_starter(right))) | is_pair(left, right)


def _joined(text: Column, glued) -> Column:
    """Sentences of a text; ``glued`` gives the places among the pieces of the plain rule whose break is taken back."""
    def joined(pieces, gaps):
        starts = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), glued(pieces))
        spaced = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.get(gaps, i - 1), p)))
        return let(F.struct(starts.alias("s"), spaced.alias("p")), lambda x: F.transform(x["s"], lambda at, k: F.concat(
            F.get(pieces, at), F.array_join(F.slice(x["p"], at + 2, F.coalesce(F.get(x["s"], k + 1), F.size(pieces)) - at - 1), ""))))
    return let(text, lambda t: let(F.split(t, SENTENCE_BREAK, -1), lambda ps: let(
        F.regexp_extract_all(t, F.lit(SENTENCE_BREAK), F.lit(0)), lambda gs: joined(ps, gs))))


def split_sentences(rows: DataFrame, model: DataFrame, key: str, text: str = "text", max_literals: int = MAX_LITERALS) -> DataFrame:
    """``rows`` with ``sentences``, an array of strings; null texts give null.

    ``key`` names the rows (rows that share one, or have none, are still split each by its own text). A small model is written
    into the plan; a large one is joined by the types before and after each break.
    """
    model = model.checkpoint()
    entries = model.limit(max_literals + 1).collect()
    if len(entries) <= max_literals:
        by = {k: [e for e in entries if e["kind"] == k] for k in ("abbreviation", "starter", "collocation")}

        def among(values: list) -> Column:
            return lambda x: x.isin(*values) if values else F.lit(False)
        pairs = among([f"{e['type']} {e['follower']}" for e in by["collocation"]])
        tests = among([e["type"] for e in by["abbreviation"]]), among([e["type"] for e in by["starter"]]), lambda a, b: pairs(F.concat_ws(" ", a, b))
        return rows.withColumn("sentences", _joined(F.col(text), lambda ps: F.transform(F.filter(
            _breaks(ps), lambda x: _glues(x["left"], x["right"], x["capital"], *tests)), lambda x: x["place"])))
    # each break asks for its own types; the answers come back to a row as the places of its breaks that are taken back
    small = F.broadcast if model.count() <= MAX_BROADCAST else lambda df: df
    lefts = small(model.where("kind <> 'starter'").groupBy(F.col("type").alias("left")).agg(F.max(F.col("kind") == "abbreviation").alias("_abbreviation")))
    starters = small(model.where("kind = 'starter'").select(F.col("type").alias("right"), F.lit(True).alias("_starter")))
    collocations = small(model.where("kind = 'collocation'").select(F.col("type").alias("left"), F.col("follower").alias("right"), F.lit(True).alias("_pair")))
    digest = F.sha2(F.col(text), 256)  # rows of one key and one text have the same breaks
    asked = rows.select(F.col(key).alias("_key"), digest.alias("_digest"), F.inline_outer(let(F.split(F.col(text), SENTENCE_BREAK, -1), _breaks)))
    asked = asked.where(F.col("place").isNotNull()).join(lefts, "left").join(starters, "right", "left").join(collocations, ["left", "right"], "left")
    glued = asked.where(_glues(F.col("left"), F.col("right"), F.col("capital"), lambda x: F.col("_abbreviation"), lambda x: F.col("_starter").isNotNull(),
                               lambda a, b: F.col("_pair").isNotNull())).groupBy("_key", "_digest").agg(F.collect_set("place").alias("_glued"))
    joined = rows.join(glued, F.col(key).eqNullSafe(F.col("_key")) & (digest == F.col("_digest")), "left")
    split = _joined(F.col(text), lambda ps: F.coalesce(F.col("_glued"), F.array().cast("array<int>")))
    return joined.withColumn("sentences", split).drop("_key", "_digest", "_glued")
