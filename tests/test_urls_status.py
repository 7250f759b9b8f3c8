"""URL validity / netloc goldens and the status rules (FIXTURES.md 4.2, 4.3)."""
from pyspark.sql import functions as F

from conftest import one
from readaloud.functions import status as S
from readaloud.functions import urls as U

URLS = [
    ("https://u:p@h:80/p?q#f", True, "u:p@h:80"),
    ("http://a_b.com/", True, "a_b.com"),
    ("ftp://f/x", True, "f"),
    ("//h/p", False, "h"),
    ("mailto:a@b", False, ""),
    ("http:///x", False, ""),
    ("foo", False, ""),
    ("", False, ""),
    ("http://", False, ""),
    (" http://x.com", True, "x.com"),
    ("http://[::1/x", False, "[::1"),
]


def test_url_validity_and_netloc(spark):
    assert one(spark, U.is_valid_url, [u for u, _, _ in URLS]) == [v for _, v, _ in URLS]
    assert one(spark, U.domain, [u for u, _, _ in URLS]) == [n for _, _, n in URLS]


def test_http_only_and_pattern(spark):
    assert one(spark, U.is_http_url, ["ftp://f/x", "HTTPS://a.b", "http://", "https://x.y/z"]) == [False, True, False, True]
    assert one(spark, U.matches_url_pattern, ["https://x.y", "http://localhost", "ftp://a.b"]) == [True, False, False]


def test_content_status(spark):
    rows = [(False, False, None), (False, False, "x"), (True, True, None), (False, True, "x"),
            (True, False, None), (True, False, ""), (True, False, "x")]
    df = spark.createDataFrame(rows, "p boolean, g boolean, e string")
    got = [r.s for r in df.select(S.content_status(F.col("p"), F.col("g"), F.col("e")).alias("s")).collect()]
    assert got == ["pending", "pending", "processing", "processing", "completed", "completed", "error"]


def test_feed_status(spark):
    df = spark.createDataFrame([(False, 0), (True, 4), (True, 3)], "a boolean, n int")
    got = [r.s for r in df.select(S.feed_status(F.col("a"), F.col("n")).alias("s")).collect()]
    assert got == ["inactive", "error", "active"]


def test_display_helpers(spark):
    assert one(spark, S.secure_filename, ["My Café: A/B  test.", "../../etc", "   ", "Việt Nam ﬁne Ａbc ½ 𝐱 ø中"]) == [
        "My_Cafe_A_B_test", "etc", "", "Viet_Nam_fine_Abc_12_x"]
    long = "word " * 30
    got = one(spark, lambda c: S.truncate_words(c, 50), [long.strip(), "short"])
    assert got[0].endswith("...") and len(got[0]) <= 50 and got[1] == "short"
    assert one(spark, S.url_quote, ["a b/c~d*e+f"]) == ["a%20b/c~d%2Ae%2Bf"]
    assert one(spark, S.web_path, ["static/a.mp3", "/abs.mp3", "", None]) == ["/static/a.mp3", "/abs.mp3", None, None]
