"""Chunking invariants, timeline, reassembly, feed rules and XML parsing."""
import random
import re

from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL, one
from readaloud.functions import text as T
from readaloud.operators import feeds as FO
from readaloud.functions.urls import form_field, is_form
from readaloud.operators.chunks import chunk_text
from readaloud.operators.language import detect, train
from readaloud.plans import docs, feeds
from readaloud.sources import fixtures as X


def _pack(sentences, limit):
    """Independent statement of the packing rule: greedy, a sentence never split."""
    out, cur = [], ""
    for s in sentences:
        fits = len(cur) + len(s) <= limit
        if not fits and cur:
            out.append(cur.strip())
            cur = ""
        cur = cur + s + " "
    if cur:
        out.append(cur.strip())
    return out


def test_chunk_count_matches_known_total(spark):
    d = spark.read.parquet(f"{SF_MID}/documents.parquet")
    t = T.strip_ws(T.space_after_punctuation(T.collapse_whitespace(F.col("text"))))
    n = d.select(F.size(chunk_text(t)).alias("n")).agg(F.sum("n")).collect()[0][0]
    assert n == 1218


def test_chunks_against_python_packer(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    t = T.strip_ws(T.space_after_punctuation(T.collapse_whitespace(F.col("text"))))
    rows = d.select(t.alias("t"), chunk_text(t).alias("c")).collect()
    for r in rows:
        expect = [r.t] if len(r.t) <= 4096 else _pack(re.split(r"(?<=[.!?])\s+", r.t), 4096)
        assert r.c == expect


def test_chunk_invariants(spark):
    rows = docs.doc_chunks(spark, SF_SMALL).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        if r.n_chars > 4096:
            assert not re.search(r"[.!?]\s", r.chunk), "only a single sentence may exceed the limit"
    text = {r.doc_id: r.processed_text for r in docs.processed_docs(spark, SF_SMALL).collect()}
    for k, cs in by_doc.items():
        cs.sort(key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in cs] == list(range(len(cs)))
        assert " ".join(r.chunk for r in cs).split() == text[k].split()


def test_timeline_offsets(spark):
    rows = docs.chunk_timeline(spark, SF_SMALL).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for cs in by_doc.values():
        cs.sort(key=lambda r: r.chunk_index)
        assert cs[0].start_offset == 0
        for a, b in zip(cs, cs[1:]):
            assert abs(a.end_offset - b.start_offset) < 1e-9
        assert abs(cs[-1].end_offset - cs[-1].total_seconds) < 1e-6


def test_reassembly_restores_text(spark):
    a = {r.doc_id: r.text for r in docs.doc_reassemble(spark, SF_SMALL).collect()}
    b = {r.doc_id: r.processed_text for r in docs.processed_docs(spark, SF_SMALL).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].split() == b[k].split()


def test_new_entries_unique_and_not_known(spark):
    new = feeds.feed_new_entries(spark, SF_MID).collect()
    known = {r.url for r in X.known_content_urls(spark, SF_MID).collect()}
    urls = [r.url for r in new]
    assert urls and len(urls) == len(set(urls))
    assert not set(urls) & known
    assert all(r.pos < 10 for r in new)


def test_failure_streak_small(spark):
    rows = [(1, "2024-01-01 00:00:00", 1, True), (1, "2024-01-01 00:01:00", 2, False),
            (1, "2024-01-01 00:02:00", 3, False), (2, "2024-01-01 00:00:00", 4, False),
            (3, "2024-01-01 00:00:00", 5, False), (3, "2024-01-01 00:05:00", 6, True)]
    df = spark.createDataFrame(rows, "feed_id long, ts string, poll_id long, ok boolean") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.feed_id: r.error_count for r in FO.failure_streak(df).collect()}
    assert got == {1: 2, 2: 1, 3: 0}


def test_feed_xml_goldens(spark):
    xmls = [
        "<rss><channel><title>T</title><item><title>a</title><link>http://x/1</link></item>"
        "<item><title>b</title><link>http://x/2</link></item><item><title>nolink</title></item></channel></rss>",
        "<rss><channel><title>T</title><item><title>a</title><link>http://x/1</link></item></channel></rss>",
        "<not xml",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xmls)], "k int, xml string")
    rows = sorted(FO.parse_feed_xml(df).collect(), key=lambda r: (r.k, r.pos if r.pos is not None else -1))
    assert [(r.k, r.pos, r.link) for r in rows] == [(0, 0, "http://x/1"), (0, 1, "http://x/2"), (0, 2, None),
                                                   (1, 0, "http://x/1"), (2, None, None)]
    assert [r.ok for r in rows] == [True, True, True, True, False]


def test_feed_dates(spark):
    shapes = ["2024-01-02T03:04:05", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05.123Z",
              "Tue, 02 Jan 2024 03:04:05 +0200", "Tue, 2 Jan 2024 03:04:05 GMT", "Tue, 2 Jan 2024 03:04:05 EST", "2 Jan 2024 3:04 GMT",
              "2024-01-02 03:04", "Tue, 02 Jan 2024 03:04:05 XYZ", "2024-13-02T03:04:05", "junk", "", None]
    got = one(spark, FO.parse_feed_date, shapes)
    day = "2024-01-02 "
    assert [str(g) if g else None for g in got] == [
        day + "03:04:05", day + "03:04:05", day + "01:04:05", day + "03:04:05", day + "01:04:05", day + "03:04:05", day + "08:04:05",
        day + "03:04:00", day + "03:04:00", None, None, None, None, None]


def test_atom_and_rdf_feeds(spark):
    xmls = [
        '<feed xmlns="http://www.w3.org/2005/Atom"><title type="text">A</title><subtitle>s</subtitle><updated>2024-01-02T03:04:05Z</updated>'
        '<entry><title>one</title><link rel="self" href="no"/><link href="http://x/1"/><updated>2024-01-01T00:00:00Z</updated></entry>'
        '<entry><title>two</title></entry></feed>',
        '<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel><title>R</title><dc:date>2024-01-02</dc:date></channel>'
        '<item><title>i</title><link>http://x/2</link><dc:date>2024-01-03</dc:date></item></rdf:RDF>',
        "<html><body>no feed</body></html>"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xmls)], "k int, xml string")
    got = {r.k: r for r in FO.parse_feed_documents(df).collect()}
    assert (got[0].ok, got[0].feed_title, got[0].feed_description, got[0].feed_updated) == (True, "A", "s", "2024-01-02T03:04:05Z")
    assert [(e.title, e.link, e.dated) for e in got[0].entries] == [("one", "http://x/1", "2024-01-01T00:00:00Z"), ("two", None, None)]
    assert got[1].feed_title == "R" and [(e.title, e.link, e.dated) for e in got[1].entries] == [("i", "http://x/2", "2024-01-03")]
    assert not got[2].ok and got[2].entries is None


def test_streak_from_days_that_arrive_in_any_order(spark):
    """Summaries of single days, the late ones last, merge to what the whole history gives."""
    rng = random.Random(8)
    rows = [(f, f"2024-01-{rng.randint(1, 9):02d} {rng.randint(0, 23):02d}:00:00", i, rng.random() < (0.2, 0.9, 0.0)[f % 3]) for i in range(600) for f in (i % 7,)]
    df = spark.createDataFrame(rows, "feed_id long, ts string, poll_id long, ok boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = {}
    for f in range(7):
        own = sorted((r for r in rows if r[0] == f), key=lambda r: (r[1], r[2]), reverse=True)
        want[f] = (len(own), next((i for i, r in enumerate(own) if r[3]), len(own)))
    parts = [FO.run_summaries(df.where(F.dayofmonth("ts").isin(*days))) for days in ((2, 4, 6, 8), (1, 9), (3, 5, 7))]
    kept = parts[0].unionByName(parts[1]).unionByName(parts[2])
    for got in (FO.merged_streak(kept), FO.failure_streak(df)):
        assert {r.feed_id: (r.n_polls, r.error_count) for r in got.collect()} == want


def test_wild_feed_documents(spark):
    ns = 'xmlns:atom="http://www.w3.org/2005/Atom"'
    xmls = [
        f'<rss {ns}><channel><title>T</title><item><title>a</title><link>http://x/1</link><atom:link href="http://x/self" rel="self"/></item></channel></rss>',
        "<rss><channel><title>T</title><item><guid>http://x/2</guid></item><item><guid isPermaLink='false'>7</guid></item></channel></rss>",
        f'<rss {ns}><channel><title>T</title><item><title>c</title><atom:link href="http://x/3"/></item></channel></rss>',
        "<rss><channel><title>T</title><item><title>d &amp; e</title><link>http://x/4</link><pubDate>2024-01-02</pubDate></item>"
        "<item><title>A & <b>f</title><link>http://x/5?a=1&amp;b=2</link></item><item><title>cut</ti",
        "<a:feed><a:entry><a:title><![CDATA[g <i>]]></a:title><a:link rel='self' href='no'/><a:link href='http://x/6'/><a:updated>now</a:updated></a:entry><oops",
        "no xml", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xmls)], "k int, xml string")
    got = {r.k: r for r in FO.read_feed_documents(df).collect()}
    links = {k: [e.link for e in r.entries or []] for k, r in got.items()}
    assert links == {0: ["http://x/1"], 1: ["http://x/2", None], 2: ["http://x/3"], 3: ["http://x/4", "http://x/5?a=1&b=2"], 4: ["http://x/6"], 5: [], 6: [], 7: []}
    assert [got[k].ok for k in range(5)] == [True, True, True, False, False]
    assert [(e.title, e.dated) for e in got[3].entries][0] == ("d & e", "2024-01-02")
    # an add goes by the strict reading alone
    assert [r.entries is None for r in FO.parse_feed_documents(df).orderBy("k").collect()][3:5] == [True, True]


def test_more_feed_dates(spark):
    shapes = ["2024-01-02", "20240102T030405Z", "20240102", "02 Jan 24 03:04 GMT", "Tue, 02 Jan 2024 04:04:05 CET", "02 Jan 99 03:04 GMT", "2024-1-2"]
    assert [str(g) if g else None for g in one(spark, FO.parse_feed_date, shapes)] == [
        "2024-01-02 00:00:00", "2024-01-02 03:04:05", "2024-01-02 00:00:00", "2024-01-02 03:04:00", "2024-01-02 03:04:05", "1999-01-02 03:04:00", None]


def test_form_fields(spark):
    bodies = ["url=http%3A%2F%2Fx%2F%3Fa%3D1&voice=a+b", "voice=x", "url=&url=y", "u%72l=1", "url=100%&b=%zz", "url=a=b", "junk", "", None, "=x", "url=%E4%B8%AD"]
    assert one(spark, lambda c: form_field(c, "url"), bodies) == ["http://x/?a=1", None, "", "1", "100%", "a=b", None, None, None, None, "中"]
    assert one(spark, is_form, bodies) == [True] * 6 + [False] * 4 + [True]


def test_labels_that_look_alike_and_repeated_rows(spark):
    rows = [(1, "kalo milo kalo", "a-b"), (2, "schung erung", "a_b"), (3, "kalo milo", "a-b"), (4, "erung schung", "a_b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(df)
    asked = spark.createDataFrame([(1, "kalo"), (1, "kalo"), (1, "schung"), (None, "erung"), (5, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.detected) for r in detect(asked, model).collect()))
    assert got == [(0, "a_b"), (1, "a-b"), (1, "a-b"), (1, "a_b"), (5, "en")]
