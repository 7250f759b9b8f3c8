"""Text column functions: cleaning, redaction, speech formatting, counting.

Each function is Column -> Column over built-in expressions. Composite
functions list their steps in order; quirks of the original order (a step that
undoes a later one) are kept on purpose and noted where they occur.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (ABBREVIATIONS, EMAIL_PLACEHOLDER, HASH_PREFIX_CHARS,
                         PARAGRAPH_SPLIT_CHARS, WORDS_PER_MINUTE)
from .html import html_to_text
from .regex import DIGIT, NOT_AFTER_WORD, NOT_BEFORE_WORD, NWS, WORD, WS, WS_CHARS, guarded_replace, let

SENTENCE_BREAK = rf"(?<=[.!?]){WS}+"


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (a character-set trim, no regex)."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_blank_lines(c: Column) -> Column:
    """A newline, optional whitespace and a newline become one blank line."""
    return guarded_replace(c, "\n", rf"\n{WS}*\n", "\n\n")


def redact_emails(c: Column) -> Column:
    """E-mail-like tokens become a placeholder.

    A match can only begin where a run of name characters begins or where the
    match before it ended (``\\G``): a shorter start inside a run ends at the
    same place. Long runs without ``@`` are therefore scanned once and not from
    every position.
    """
    name = r"[\p{L}\p{N}_.-]"
    return guarded_replace(c, "@", rf"(?:\G|(?<!{name})){name}++@{name}+\.{WORD}+", EMAIL_PLACEHOLDER)


def paragraphs(c: Column) -> Column:
    return F.split(c, "\n\n", -1)


def pack_sentences(sentences: Column, limit: int, strict: bool, skip_empty: bool) -> Column:
    """Greedy left-to-right packing of sentences into chunks.

    A sentence joins the current chunk while ``len(cur) + len(s)`` stays
    below ``limit`` (``strict``) or at most ``limit`` (not strict); the chunk
    text carries a trailing space while open and is stripped when closed. With
    ``skip_empty`` an empty current chunk is never emitted, so a sentence
    longer than the limit becomes a chunk of its own. The open chunk's length is carried
    along: counting its characters anew would cost a chunk per sentence.
    """
    init = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(s, x):
        size = s["n"] + F.length(x)
        fits = size < limit if strict else size <= limit
        closed = F.array_append(s["out"], strip_ws(s["cur"]))
        if skip_empty:
            closed = F.when(s["cur"] == "", s["out"]).otherwise(closed)
        return F.when(fits, F.struct(s["out"].alias("out"), F.concat(s["cur"], x, F.lit(" ")).alias("cur"), (size + 1).alias("n"))) \
            .otherwise(F.struct(closed.alias("out"), F.concat(x, F.lit(" ")).alias("cur"), (F.length(x) + 1).alias("n")))

    def finish(s):
        return F.when(s["cur"] != "", F.array_append(s["out"], strip_ws(s["cur"]))).otherwise(s["out"])

    return F.aggregate(sentences, init, step, finish)


def split_sentences(c: Column) -> Column:
    """Sentences end after ``. ! ?`` followed by whitespace."""
    return F.split(c, SENTENCE_BREAK, -1)


def resplit_long_paragraphs(paras: Column, limit: int = PARAGRAPH_SPLIT_CHARS) -> Column:
    """Paragraphs longer than ``limit`` are re-packed from their sentences.

    Uses a strict ``<`` bound and may emit an empty first piece when the
    first sentence alone reaches the limit (both kept as in the original).
    """
    return F.flatten(F.transform(
        paras,
        lambda p: F.when(F.length(p) > limit,
                         pack_sentences(split_sentences(p), limit, strict=True, skip_empty=False))
        .otherwise(F.array(p))))


def clean_content(c: Column) -> Column:
    """Blank-line collapse, e-mail redaction, long-paragraph re-packing."""
    def body(x):
        t = redact_emails(collapse_blank_lines(x))
        out = F.array_join(resplit_long_paragraphs(paragraphs(t)), "\n\n")
        return F.when(x.isNull() | (x == ""), F.lit("")).otherwise(out)
    return let(c, body)


def content_hash(url: Column, content: Column) -> Column:
    """md5 of ``url:`` plus the first characters of the content; NULL if empty."""
    return let(content, lambda c: F.when(c.isNull() | (c == ""), F.lit(None)).otherwise(
        F.md5(F.concat(url, F.lit(":"), F.substring(c, 1, HASH_PREFIX_CHARS)))))


def strip_urls(c: Column) -> Column:
    return guarded_replace(c, "http", rf"https?://{NWS}+", "")


def collapse_whitespace(c: Column) -> Column:
    """Every whitespace run becomes one space; runs that already are one space are not matched."""
    return F.regexp_replace(c, rf" {WS}+|[\s\x1c-\x1f\x85\p{{Z}}&&[^ ]]{WS}*", " ")


def space_after_punctuation(c: Column) -> Column:
    """Exactly one space after each ``. ! ?`` (also splits ``3.14`` and ``...``)."""
    return F.regexp_replace(c, rf"([.!?]){WS}*", "$1 ")


def basic_clean(c: Column) -> Column:
    """Markup to text, URLs removed, whitespace normalised, punctuation spaced."""
    t = html_to_text(c)
    t = strip_urls(t)
    t = collapse_blank_lines(t)
    t = collapse_whitespace(t)
    t = space_after_punctuation(t)
    return strip_ws(t)


def expand_abbreviations(c: Column) -> Column:
    """Each abbreviation, not preceded by a word character, becomes its spoken form.

    The pattern starts with the abbreviation itself, which the regex engine compares
    without trying anything else, and then looks back at the character before it.
    """
    out = c
    for abbr, spoken in ABBREVIATIONS:
        literal = abbr.replace(".", r"\.")
        # each rule runs only on rows that contain its abbreviation at all
        out = guarded_replace(out, abbr, rf"{literal}(?<![\p{{L}}\p{{N}}_]{literal})", spoken)
    return out


def speak_dates(c: Column) -> Column:
    return guarded_replace(
        c, "/", rf"{NOT_AFTER_WORD}({DIGIT}{{1,2}})/({DIGIT}{{1,2}})/({DIGIT}{{4}}){NOT_BEFORE_WORD}", "$1 $2 $3")


def speak_times(c: Column) -> Column:
    return guarded_replace(
        c, ":", rf"{NOT_AFTER_WORD}({DIGIT}{{1,2}}):({DIGIT}{{2}}){NOT_BEFORE_WORD}", "$1 $2")


def insert_pauses(c: Column) -> Column:
    return F.regexp_replace(c, "\n\n", ".\n\n")


def format_for_speech(c: Column) -> Column:
    return insert_pauses(speak_times(speak_dates(expand_abbreviations(c))))


def prefix_title(title: Column, text: Column) -> Column:
    return let(F.struct(title.alias("t"), text.alias("x")),
               lambda s: F.when(s["t"].isNotNull() & (s["t"] != ""),
                                F.concat(s["t"], F.lit(".\n\n"), s["x"])).otherwise(s["x"]))


def word_count(c: Column) -> Column:
    """Number of whitespace-separated tokens."""
    return F.coalesce(F.regexp_count(c, F.lit(f"{NWS}+")), F.lit(0)).cast("bigint")


def estimated_seconds(words: Column) -> Column:
    return words.cast("double") / F.lit(float(WORDS_PER_MINUTE)) * F.lit(60.0)
