"""Personal data: pattern spans, and bootstrapped contextual extraction, in DataFrame expressions only.

1. Base spans (email, ip, card, phone) are found and validated row by row, together with
   the tokens on either side of each and of every other identifier-like string
   (six digits and more, or an obfuscated address): the candidates.
   A token is a word with the punctuation that parts it from the instance, glued to it or not
   (``tel:`` in ``tel:5550121000``, ``(`` and ``)`` in ``(a@b.com)``).
2. Seeds are the base instances. A pattern is a token to the left or to the right; the bipartite
   graph of patterns and instances is a small edge table next to the corpus.
3. Rounds of scoring: a pattern's confidence is the trust in its instances
   divided by how often its token occurs anywhere in the corpus on that side of
   something (instances are cut out and the rest is split alike for both counts), and a candidate's
   confidence is one minus the product of its patterns' doubts. Candidates
   above ``accept`` are trusted in the next round, so new patterns can
   follow from them. Confidences rise from round to round, and the rounds end when none rises by more than ``settled``.
4. Candidates with accepted instances are reported as ``ctx`` spans.

A token that also stands before ordinary words has a low confidence, which
keeps clean documents clean; a pattern needs ``min_seeds`` distinct
trusted instances. Counts cover the whole corpus; aggregates combine before
they shuffle, so a token or an instance that fills a third of the rows is one row per task.

Edge cases: a null text is empty; contexts at the ends of a text are absent; a
candidate that overlaps a base span is not a candidate; rows that repeat doc_id
and text get the same result each and count once in the graph; an
empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, clear_of, kind_spans, match_spans, pieces, row_key, running_max, span_string, stored, text_or_empty

#: The base patterns, written so that long runs are scanned once; matches are those of the plain forms.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"[0-9](?:[\x20().-]?[0-9]){5,}+|[A-Za-z0-9._%+-]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9.-]++"
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "ctx"]
#: What may precede an instance, or any other word: a word with the punctuation behind it, or punctuation alone.
LEFT = r"(?:[^\x00-\x2C./:-@\[-^`{-\x7F]++[!-,./:-@\[-^`{-~]*+|[!-,./:-@\[-^`{-~]++)"
#: What may follow: punctuation and the word behind it, or punctuation alone.
RIGHT = r"(?:[!-,./:-@\[-^`{-~]*+[^\x00-\x2C./:-@\[-^`{-\x7F]++|[!-,./:-@\[-^`{-~]++)"
MIN_SEEDS = 3
ACCEPT = 0.6
#: Rounds end when no candidate's confidence rises by more than this. Confidences only ever rise, so they do end.
SETTLED = 0.0001


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    backwards = F.split(F.reverse(digits), "")
    total = F.aggregate(F.transform(F.filter(backwards, lambda d: d != ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10).cast("int"))),
        F.lit(0), lambda s, x: s + x)
    return total % 10 == 0


def base_matches(text: Column) -> dict[str, Column]:
    """The valid matches of each kind, as ``match_spans`` gives them."""
    def parts_fit(s: Column) -> Column:
        return F.forall(F.split(s["match"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digit = text.rlike("[0-9]")
    return {
        "email": match_spans(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(match_spans(text, IP, digit), parts_fit),
        "card": F.filter(match_spans(text, CARD, digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), lambda s: F.when(
            F.length(_digits(s["match"])).between(12, 19), luhn(_digits(s["match"]))).otherwise(False)),
        "phone": F.filter(match_spans(text, PHONE, F.contains(text, F.lit("+"))),
                          lambda s: F.length(_digits(s["match"])).between(9, 15)),
    }


def _instances(spans: Column, kind: str) -> Column:
    """(kind, start, end, instance) of matches."""
    return F.transform(spans, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.lower(F.regexp_replace(s["match"], r"[\x20().-]", "")).alias("instance")))


def _gaps(text: Column, spans: Column) -> Column:
    """What is left of a text between its spans, sorted by start: one more than there are spans."""
    def places(ss: Column, far: Column) -> Column:
        def gap(s: Column, k: Column) -> Column:
            begin = F.coalesce(F.get(far, k - 1), F.lit(0))  # spans may overlap
            return F.struct(begin.alias("start"), (s["start"] - begin).alias("n"))
        end = F.element_at(far, -1)
        return F.concat(F.transform(ss, gap), F.array(F.struct(end.alias("start"), (F.length(text) - end).alias("n"))))
    between = bound(spans, lambda ss: bound(running_max(ss["end"]), lambda far: bound(places(ss, far), lambda ps: pieces(text, ps))))
    return F.when(F.size(spans) > 0, between).otherwise(F.array(text))


def _tokens(gaps: Column, pattern: str) -> Column:
    return F.transform(gaps, lambda g: F.regexp_extract_all(F.lower(g), F.lit(pattern), F.lit(0)))


def contexts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, kind, start, end, instance, left, right) of the instances, and (side, word, n) of all tokens that stand next to any.

    ``rows`` has key, text and spans (sorted instances); rows that repeat a key are counted by ``n`` but are one in the first result.
    Each gap is beside one instance on either side, so no token stands next to more instances than it is counted.
    """
    split = rows.select("key", "spans", _gaps(F.col("text"), F.col("spans")).alias("gaps")).select(
        "key", "spans", _tokens(F.col("gaps"), LEFT).alias("l"), _tokens(F.col("gaps"), RIGHT).alias("r"))
    found = split.where(F.size("spans") > 0)
    beside = F.transform("spans", lambda s, k: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["instance"].alias("instance"),
        F.coalesce(F.try_element_at(F.get("l", k), F.lit(-1)), F.lit("")).alias("left"),
        F.coalesce(F.get(F.get("r", k + 1), 0), F.lit("")).alias("right")))
    parts = stored(found.dropDuplicates(["key"]).select("key", F.inline(beside)), "personal-data-instances")
    near = parts.select(F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("word")), F.struct(
        F.lit("r").alias("side"), F.col("right").alias("word")))).alias("p")).select("p.*").where("word != ''").distinct()
    hashes = F.concat(*[F.transform(F.flatten(F.col(side)), lambda w: F.xxhash64(F.lit(side), w)) for side in ("l", "r")])  # noqa: B023
    counts = split.select(F.explode(hashes).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    words = near.select("side", "word", F.xxhash64("side", "word").alias("h")).join(counts, "h").select("side", "word", "n")
    return parts, stored(words, "context-words")


def bootstrap(parts: DataFrame, words: DataFrame, min_seeds: int = MIN_SEEDS, accept: float = ACCEPT,
              settled: float = SETTLED) -> DataFrame:
    """(instance, confidence) of accepted candidates.

    ``parts`` has (kind, instance, left, right), kind ``ctx`` for candidates; ``words``
    has (side, word, n), how often a lower-cased token stands in the corpus on that side of anything.
    """
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("word")),
                              F.struct(F.lit("r").alias("side"), F.col("right").alias("word")))).alias("p")
    edges = parts.select("kind", "instance", sides).select("kind", "instance", "p.side", "p.word").where("word != ''")
    edges = edges.groupBy("instance", "side", "word").agg(
        F.max(F.col("kind") != "ctx").alias("seed"), F.count(F.lit(1)).alias("n_edge"))
    seeded = edges.groupBy("side", "word").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_seeds).select("side", "word")
    edges = stored(edges.join(seeded, ["side", "word"]).join(words, ["side", "word"]), "pattern-edges")
    trusted = stored(edges.groupBy("instance").agg(F.max("seed").alias("seed")).select(
        "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("trust")), "instance-trust")
    while True:
        scored = edges.join(trusted.select("instance", "trust"), "instance")
        patterns = scored.groupBy("side", "word").agg(
            F.sum((F.col("trust") > 0).cast("int")).alias("backers"),
            (F.sum(F.col("trust") * F.col("n_edge")) / F.max("n")).alias("confidence")).where(F.col("backers") >= min_seeds)
        # a share, never above 1; at 1 the logarithm of the doubt would not be finite
        patterns = stored(patterns.select("side", "word", F.least("confidence", F.lit(0.999999)).alias("confidence")), "pattern-confidence")
        belief = scored.join(patterns, ["side", "word"], "left").groupBy("instance").agg(
            F.max("seed").alias("seed"), F.max("trust").alias("before"),
            F.sum(F.log(1 - F.coalesce("confidence", F.lit(0.0)))).alias("doubt"))
        confidence = F.round(1 - F.exp("doubt"), 9)
        trust = F.when(F.col("seed"), 1.0).when(confidence >= accept, confidence).otherwise(0.0)
        trusted = stored(belief.select("instance", "seed", "before", trust.alias("trust")), "instance-trust")
        if (trusted.agg(F.max(F.col("trust") - F.col("before"))).first()[0] or 0.0) <= settled:
            return trusted.where(~F.col("seed") & (F.col("trust") > 0)).select("instance", F.col("trust").alias("confidence"))


def find_personal_data(docs: DataFrame, min_seeds: int = MIN_SEEDS, accept: float = ACCEPT, settled: float = SETTLED) -> DataFrame:
    """(doc_id, email, ip, card, phone, ctx): spans (kind, start, end) of every row."""
    text = F.col("text")
    rows = docs.select(row_key().alias("key"), "doc_id", text_or_empty().alias("text"))
    base = base_matches(text)
    shape = text.rlike(r"[0-9](?:[\x20().-]?[0-9]){5}|(?i:[\[(]at[\])])")
    found = rows.select("key", "doc_id", "text", *[_instances(base[k], k).alias(k) for k in BASE],
                        _instances(match_spans(text, CANDIDATE, shape), "ctx").alias("other"))
    found = found.select("key", "doc_id", "text", F.concat(*BASE).alias("base"), "other")
    clear = clear_of(F.col("other"), F.col("base"), "kind", "start", "end", "instance")
    found = stored(found.select("key", "doc_id", "base", clear.alias("other"), "text"), "personal-data-parts")
    ordered = F.sort_array(F.transform(F.concat("base", "other"), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["instance"].alias("instance"))))
    parts, words = contexts(found.select("key", "text", ordered.alias("spans")))
    accepted = stored(bootstrap(parts, words, min_seeds, accept, settled), "accepted-instances")
    spans = parts.where("kind = 'ctx'").join(accepted, "instance").select("key", "kind", "start", "end")
    # a document's spans are bounded by its own text
    ctx = spans.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("ctx"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def of(kind: str) -> Column:
        return kind_spans(F.filter("base", lambda s: s["kind"] == kind), kind).alias(kind)
    return found.join(ctx, "key", "left").select("doc_id", *[of(k) for k in BASE], F.coalesce("ctx", none).alias("ctx"))


def personal_data_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the result of ``find_personal_data``."""
    base = F.concat(*BASE)
    return found.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE],
                        F.sha2(span_string(base, KINDS), 256).alias("base_sha256"),
                        span_string(F.concat(base, F.col("ctx")), KINDS).alias("spans"))
