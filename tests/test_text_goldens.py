"""Golden rows for the text rules (FIXTURES.md section 4.1)."""
import re

from conftest import one
from pyspark.sql import functions as F

from readaloud.functions import text as T

GOLDEN = [
    ("Dr. Smith met Mrs. Lee at 12:30 on 01/02/2024.Next",
     "Dr. Smith met Mrs. Lee at 12:30 on 01/02/2024. Next",
     "Doctor Smith met Misses Lee at 12 30 on 01 02 2024. Next", 13),
    ("See e.g. pages, i.e. this. Pi is 3.14!", "See e. g. pages, i. e. this. Pi is 3. 14!",
     "See e. g. pages, i. e. this. Pi is 3. 14!", 11),
    ("Read https://x.io/a?b=1. More  text", "Read More text", "Read More text", 3),
    ("Wait... what?!", "Wait. . . what? !", "Wait. . . what? !", 5),
    ("A\n\n\nB\n \nC", "A B C", "A B C", 3),
    ("cats, dogs, etc. End", "cats, dogs, etc. End", "cats, dogs, etcetera End", 4),
    ("at 12:30:45 or 1/2/24", "at 12:30:45 or 1/2/24", "at 12 30:45 or 1/2/24", 5),
    ("v1.2 vs. v2 approx.5", "v1. 2 vs. v2 approx. 5", "v1. 2 versus v2 approximately 5", 6),
    ("  ", "", "", 0),
    ("mr. Dr.X", "mr. Dr. X", "mr. Doctor X", 3),
]


def test_basic_clean(spark):
    got = one(spark, T.basic_clean, [g[0] for g in GOLDEN])
    assert got == [g[1] for g in GOLDEN]


def test_format_for_speech(spark):
    got = one(spark, T.format_for_speech, [g[1] for g in GOLDEN])
    assert got == [g[2] for g in GOLDEN]


def test_word_count(spark):
    got = one(spark, T.word_count, [g[2] for g in GOLDEN])
    assert got == [g[3] for g in GOLDEN]


def test_standalone_rules(spark):
    assert one(spark, T.expand_abbreviations, ["e.g. i.e. Prof. Ms. Mr. x"]) == ["for example that is Professor Miss Mister x"]
    assert one(spark, T.insert_pauses, ["a\n\nb"]) == ["a.\n\nb"]
    assert one(spark, T.collapse_blank_lines, ["a\n \t\n\nb\nc"]) == ["a\n\nb\nc"]
    assert one(spark, T.redact_emails, ["mail é.x@exa-mple.fr now"]) == ["mail [EMAIL REMOVED] now"]
    assert one(spark, T.strip_urls, ["a http://x.y/z?q b"]) == ["a  b"]


def test_unicode_whitespace_and_word_chars(spark):
    # no-break space and U+001F count as whitespace; accented letters as word characters
    assert one(spark, T.collapse_whitespace, ["a \u001fb"]) == ["a b"]
    assert one(spark, T.expand_abbreviations, ["éDr. x"]) == ["éDr. x"]
    assert one(spark, T.word_count, ["a b c"]) == [3]


def test_clean_content_repacks_long_paragraphs(spark):
    long_sentence = "W" * 1000 + "."
    text = long_sentence + " short one. another."
    out = one(spark, T.clean_content, [text, "", None])
    # a first sentence at the limit leaves an empty first piece (kept as is)
    assert out[0].split("\n\n") == ["", long_sentence, "short one. another."]
    assert out[1] == "" and out[2] == ""


def test_clean_content_is_idempotent_on_short_text(spark):
    s = "One. Two three.\n\nFour."
    assert one(spark, T.clean_content, [s]) == [s]


def test_redaction_goldens_and_long_runs(spark):
    import time
    vals = ["mail x.y-z@exa-mple.co.uk and a@b.c", "é.x@exa-mple.fr", "a@b", "@@x.y", "x@y.z@w.v"]
    blob = "a" * 100_000
    t0 = time.time()
    got = one(spark, T.redact_emails, vals + [blob + " x@y.com"])
    elapsed = time.time() - t0
    assert got == ["mail [EMAIL REMOVED] and [EMAIL REMOVED]", "[EMAIL REMOVED]", "a@b", "@@x.y", "[EMAIL REMOVED]@w.v", blob + " [EMAIL REMOVED]"]
    assert elapsed < 30   # a quadratic rescan of the long run would take minutes


def test_packing_carries_the_open_chunk_s_length(spark):
    """No step counts the characters of the chunk that is open; lengths are characters, not bytes."""
    df = spark.createDataFrame([(["é" * 3, "ab", "", "c" * 9, "d"],)], "s array<string>")
    packed = df.select(T.pack_sentences(F.col("s"), 7, strict=False, skip_empty=True).alias("c"))
    assert packed.first().c == ["ééé ab", "c" * 9, "d"]
    plan = packed._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" in plan and not re.search(r"length\(lambda [^ ()]*\.cur\)|length\([^()]*\.cur\)", plan)


def test_abbreviations_next_to_each_other_and_inside_words(spark):
    assert one(spark, T.expand_abbreviations, ["Dr.Dr. xDr. éDr. (Dr.", "etc.etc. e.g.i.e. 1e.g.", "Mrs.Mr.", None]) == [
        "DoctorDoctor xDr. éDr. (Doctor", "etceteraetcetera for examplei.e. 1e.g.", "MissesMister", None]
