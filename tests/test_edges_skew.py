"""Edge rows through the page pipeline, and operators on a hot-key fixture."""
import random

from pyspark.sql import functions as F

from readaloud.constants import EXTRACT_ERROR, NO_TEXT_ERROR
from readaloud.operators import feeds as FO
from readaloud.operators.chunks import synthesis_manifest
from readaloud.operators.extract import structural_extract
from readaloud.operators.jobs import admit, first_per_key
from readaloud.operators.speech import prepare_speech, with_synthesis_error


def test_edge_pages(spark):
    big = ("word " * 1000).strip() + "."          # one sentence over the chunk limit
    rows = [(1, "http://a/1", None), (2, "http://a/2", ""), (3, "http://a/3", "   "),
            (4, "http://a/4", "<p>No title here.</p>"), (5, "http://a/5", "<title></title><p>Empty title.</p>"),
            (6, "http://a/6", f"<title>T</title><article><p>{big} Short tail.</p></article>"),
            (7, "http://a/7", "<script>only()</script>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    ext = structural_extract(pages).select(F.col("page_id").alias("content_id"), "title", "original_text", "error",
                                          F.lit("nova").alias("voice"))
    got = {r.content_id: r for r in ext.collect()}
    for k in (1, 2, 7):
        assert got[k].error == EXTRACT_ERROR
    # whitespace is text to the extractor; it fails later, at synthesis, for lack of words
    assert got[3].error is None
    assert got[4].title is None and got[5].title is None and got[6].title == "T"
    jobs = with_synthesis_error(prepare_speech(ext))
    assert {r.content_id: r.error for r in jobs.collect()}[3] == NO_TEXT_ERROR
    m = synthesis_manifest(jobs, valid=F.col("error").isNull()).collect()
    by = {}
    for r in m:
        by.setdefault(r.content_id, []).append(r)
    assert set(by) == {4, 5, 6}
    six = sorted(by[6], key=lambda r: r.chunk_index)
    # title sentence, the long sentence kept whole, then the tail
    assert [r.n_chars > 4096 for r in six] == [False, True, False]
    assert six[0].input == "T." and six[2].input == "Short tail."
    assert six[1].start_offset == six[0].est_seconds


def test_hot_feed_top_entries_and_streak(spark):
    random.seed(3)
    # feed 0 holds most entries (a hot key); others are small
    entries = [(0 if i % 10 < 7 else i % 5 + 1, i, f"l{i}", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(entries, "feed_id long, entry_order long, link string, title string").repartition(8)
    top = FO.top_entries(df, 10).collect()
    want = {}
    for f, o, _, _ in sorted(entries, key=lambda e: (e[0], e[1])):
        want.setdefault(f, [])
        if len(want[f]) < 10:
            want[f].append(o)
    got = {}
    for r in top:
        got.setdefault(r.feed_id, []).append((r.pos, r.entry_order))
    assert {f: [o for _, o in sorted(v)] for f, v in got.items()} == want

    polls = [(0 if i % 3 else 9, i, random.random() < 0.7) for i in range(2000)]
    p = spark.createDataFrame(polls, "feed_id long, poll_id long, ok boolean") \
        .withColumn("ts", F.timestamp_seconds(F.col("poll_id")).cast("timestamp_ntz")).repartition(8)
    got = {r.feed_id: r.error_count for r in FO.failure_streak(p).collect()}
    for f in {0, 9}:
        seq = [ok for ff, _, ok in sorted(polls, key=lambda x: x[1]) if ff == f]
        streak = 0
        for ok in seq:
            streak = 0 if ok else streak + 1
        assert got[f] == streak


def test_hot_client_admission_and_first_per_key(spark):
    reqs = [(i, 1 if i % 4 else i % 7 + 2, i * 60) for i in range(5000)]   # client 1 is hot
    df = spark.createDataFrame(reqs, "request_id long, client long, sec long") \
        .withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz")).drop("sec").repartition(8)
    got = {r.request_id: r.admitted for r in admit(df, "client", "ts", "request_id", 5, "1 day").collect()}
    seen = {}
    for rid, c, sec in sorted(reqs, key=lambda r: (r[2], r[0])):
        key = (c, sec // 86400)
        seen[key] = seen.get(key, 0) + 1
        assert got[rid] == (seen[key] <= 5)
    content = spark.createDataFrame([(i, f"u{i % 3}", i % 2 == 0, None) for i in range(900, 0, -1)],
                                    "id long, url string, is_processed boolean, error string")
    first = {r.url: r.id for r in first_per_key(content, "url", "id", ["id", "is_processed"]).collect()}
    assert first == {"u0": 3, "u1": 1, "u2": 2}
