"""Streams drained with availableNow equal their batch counterparts."""
import os
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from readaloud.functions.status import content_status
from readaloud.plans import feeds, jobs
from readaloud.sources import fixtures as X
from readaloud.streaming import admission
from readaloud.streaming import jobs as S


def test_latest_status_equals_batch_status(spark):
    got = {r.id: r.status for r in S.stream_latest_status(spark, SF_SMALL).collect()}
    c = X.content_jobs(spark, SF_SMALL)
    want = {r.id: r.s for r in c.select("id", content_status(F.col("is_processed"), F.col("is_processing"),
                                                               F.col("error")).alias("s")).collect()}
    assert got == want


def test_feed_poll_equals_batch_refresh(spark):
    got = sorted(tuple(r) for r in S.stream_feed_poll(spark, SF_SMALL).collect())
    want = sorted(tuple(r) for r in feeds.feed_new_entries(spark, SF_SMALL)
                  .select("url", "feed_id", "pos", "title", "user_id").collect())
    assert got == want and got


def test_quota_windows_are_closed_and_counted(spark):
    rows = S.stream_quota_windows(spark, SF_SMALL).collect()
    assert rows
    last = X.submissions(spark, SF_SMALL).agg(F.max("ts")).collect()[0][0]
    for r in rows:
        assert (r.window_end - r.window_start).total_seconds() == 3600
        assert r.window_end.timestamp() <= last.timestamp() - 3600 + 1e-6


def _split(spark, tmp_path, files=6):
    """The small tables with events, documents and pages cut into several files, in the order of time or id."""
    for name in os.listdir(SF_SMALL):
        shutil.copy(f"{SF_SMALL}/{name}", tmp_path / name) if name[:-8] not in ("events", "documents", "pages") else None
    for name, order in (("events", "ts"), ("documents", "doc_id"), ("pages", "page_id")):
        df = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        df.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(str(tmp_path / f"{name}.parquet"))
        parts = sorted(p for p in os.listdir(tmp_path / f"{name}.parquet") if p.endswith(".parquet"))
        for age, part in enumerate(reversed(parts)):  # a stream takes files by age
            os.utime(tmp_path / f"{name}.parquet" / part, (1_700_000_000 - 60 * age,) * 2)
    return str(tmp_path)


STREAMS = ("stream_dedupe_submissions", "stream_quota_windows", "stream_latest_status", "stream_feed_poll", "stream_convert",
           "stream_admission", "stream_fetch_join", "stream_attempts")


@pytest.mark.parametrize("name", STREAMS)
def test_results_do_not_depend_on_batches(spark, tmp_path, name):
    stream = getattr(S, name)
    want = sorted(map(tuple, stream(spark, SF_SMALL).collect()), key=repr)
    split = _split(spark, tmp_path)
    got = sorted(map(tuple, stream(spark, split, max_files=1).collect()), key=repr)
    assert got == want and got


def test_a_stream_resumes_in_its_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    split, work = _split(spark, tmp_path / "in", files=4), str(tmp_path / "work")
    whole = sorted(map(tuple, S.stream_dedupe_submissions(spark, SF_SMALL).collect()))
    parts = sorted(p for p in os.listdir(f"{split}/events.parquet") if p.endswith(".parquet"))
    held = tmp_path / "held"
    held.mkdir()
    for p in parts[2:]:
        shutil.copy(f"{split}/events.parquet/{p}", held / p)
        os.remove(f"{split}/events.parquet/{p}")
    first = S.stream_dedupe_submissions(spark, split, work, max_files=1)
    early = {r.url for r in first.collect()}
    for p in parts[2:]:
        shutil.copy(held / p, f"{split}/events.parquet/{p}")
    again = [r.url for r in S.stream_dedupe_submissions(spark, split, work, max_files=1).collect()]
    assert len(again) == len(set(again)) and early < set(again)
    assert sorted((u,) for u in again) == whole or set(again) <= {u for (u,) in whole}


def test_polls_advance_the_last_check_and_remember_links(spark, tmp_path):
    work = str(tmp_path / "work")
    first = {r.url for r in S.stream_feed_poll(spark, SF_SMALL, work).collect()}
    now = X.now_ts()
    S.land_entries(spark, SF_SMALL, work, 1)
    for minutes, due in ((10, 0), (40, 1)):
        S.refresh_poll(spark, SF_SMALL, work, 1, now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
        polled = spark.read.parquet(f"{work}/checked/poll_id=1").count()
        created = spark.read.parquet(f"{work}/created/poll_id=1").count()
        assert (polled > 0) == bool(due) or minutes == 10
        assert not first & {r.url for r in spark.read.parquet(f"{work}/created/poll_id=1").collect()} and created >= 0


def test_quota_counts_are_whole_when_files_span_all_times(spark, tmp_path):
    for name in os.listdir(SF_SMALL):
        shutil.copy(f"{SF_SMALL}/{name}", tmp_path / name) if name[:-8] != "events" else None
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(5, F.rand(7)).write.parquet(str(tmp_path / "events.parquet"))
    want = sorted(map(tuple, S.stream_quota_windows(spark, SF_SMALL).collect()), key=repr)
    work = str(tmp_path / "work")
    got = sorted(map(tuple, S.stream_quota_windows(spark, str(tmp_path), work, max_files=1).collect()), key=repr)
    assert len(os.listdir(f"{work}/out")) >= 5 and got == want and got
    again = sorted(map(tuple, S.stream_quota_windows(spark, str(tmp_path), work, max_files=1).collect()), key=repr)
    assert again == got


def _shuffled(spark, tmp_path, name, files=5):
    """The small tables with one of them in files that each span the whole range."""
    for n in os.listdir(SF_SMALL):
        shutil.copy(f"{SF_SMALL}/{n}", tmp_path / n) if n[:-8] != name else None
    spark.read.parquet(f"{SF_SMALL}/{name}.parquet").repartition(files, F.rand(7)).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_admission_equals_the_batch_rule_in_any_order(spark, tmp_path):
    """Requests that come late but are earlier in time take their place; the verdict they displace is issued again."""
    want = {r.request_id: r.admitted for r in jobs.request_admission(spark, SF_SMALL).collect()}
    work = str(tmp_path / "work")
    (tmp_path / "in").mkdir()
    got = S.stream_admission(spark, _shuffled(spark, tmp_path / "in", "events"), work, max_files=1).collect()
    assert {r.request_id: r.admitted for r in got} == want and set(want.values()) == {True, False}
    issued = spark.read.parquet(f"{work}/out").where("ceiling = 'admitted'")
    assert issued.count() > len(want)


def test_fetch_join_has_a_row_per_submission(spark, tmp_path):
    got = S.stream_fetch_join(spark, _shuffled(spark, tmp_path, "pages"), max_files=1).collect()
    pages = {r.content_id for r in S.stream_convert(spark, SF_SMALL).select("content_id").distinct().collect()}
    n = spark.read.parquet(f"{SF_SMALL}/pages.parquet").count()
    lost = {r.submission_id for r in got if r.submission_id < 0}
    assert lost == {-1 - k for k in range(0, n, 10)} and all(r.error and r.n_chars is None for r in got if r.submission_id < 0)
    assert {r.submission_id for r in got if r.error is None} == pages and len(got) == n + len(lost)


def test_attempts_show_every_outcome(spark):
    rows = [(1, 0, "pending"), (1, 1, "processing"), (1, 2, "completed"), (1, 100, "pending"), (1, 101, "processing"), (2, 0, "pending"),
            (3, 0, "processing"), (3, 1, "pending"), (4, 0, "pending"), (4, 1, "error"), (4, 2, "processing"), (5, 0, "pending"), (5, 0, "processing"),
            (5, 1, "completed"), (5, 2, "completed"), (6, 0, "completed")]
    df = spark.createDataFrame(rows, "id bigint, m int, status string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("m")))
    got = sorted((r.id, r.started, r.outcome) for r in S.attempts(df).collect())
    assert [(i, o) for i, _, o in got] == [(1, "complete"), (1, "stuck"), (2, "waiting"), (3, "illegal"), (4, "illegal"), (5, "illegal"), (6, "illegal")]
    assert {r.outcome for r in S.stream_attempts(spark, SF_SMALL).collect()} >= {"complete", "stuck", "illegal"}


def test_dedupe_reads_each_submission_once(spark, tmp_path, monkeypatch):
    """Twenty batches: a batch reads its own file and remembers addresses in keyed state, not in earlier output."""
    ended = []
    drain = S._drain
    monkeypatch.setattr(S, "_drain", lambda *a: ended.append(drain(*a)))
    (tmp_path / "in").mkdir()
    urls = S.stream_dedupe_submissions(spark, _shuffled(spark, tmp_path / "in", "events", 20), str(tmp_path / "work"), max_files=1)
    progress = [p for p in ended[0].recentProgress if p["numInputRows"]]
    n = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert len(progress) == 20 and sum(p["numInputRows"] for p in progress) == n
    assert max(p["numInputRows"] for p in progress) < 2 * n / 20
    assert urls.count() == urls.distinct().count()


def test_admission_state_is_an_entry_per_bucket_and_day(spark, tmp_path, monkeypatch):
    """The store holds a row per bucket's day, however many clients and requests there are; verdicts are the same."""
    want = sorted(map(tuple, S.stream_admission(spark, SF_SMALL).collect()))
    ended, drain = [], S._drain
    monkeypatch.setattr(S, "_drain", lambda *a: ended.append(drain(*a)))
    monkeypatch.setattr(admission, "CLIENT_BUCKETS", 2)
    (tmp_path / "in").mkdir()
    got = S.stream_admission(spark, _shuffled(spark, tmp_path / "in", "events", 2), str(tmp_path / "work"), max_files=1)
    assert sorted(map(tuple, got.collect())) == want
    days = len({r[3] for r in want})
    held = spark.read.format("statestore").option("stateVarName", "kept").load(str(tmp_path / "work" / "checkpoint"))
    assert 0 < held.count() <= 2 * days < len({(r[1], r[3]) for r in want})


def test_admission_of_requests_without_client(spark, tmp_path):
    rows = [(None, i, 10 * i) for i in range(7)] + [(c, 100 * c + i, 10 * i) for c in (1, 2, 3) for i in range(c * 2)]
    df = spark.createDataFrame(rows, "client bigint, request_id bigint, s int").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")))
    df.select("client", "request_id", "ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    requests, found = spark.readStream.schema("client bigint, request_id bigint, ts timestamp").parquet(str(tmp_path / "in")), []
    with admission.state_store(spark):
        S._drain(admission.verdicts(requests, {"admitted": (5, "1 day")}), lambda batch, i: found.extend(batch.where("admitted").collect()), str(tmp_path / "work"))
    assert sorted((r.client or 0, r.request_id) for r in found) == sorted((c or 0, k) for c, k, s in rows if s < 50)


def test_fetch_join_converts_before_it_holds(spark, monkeypatch):
    """What the join holds is a page's outcome, not its markup."""
    before, converted = [], S._converted
    monkeypatch.setattr(S, "_converted", lambda pages: before.append(pages._jdf.queryExecution().logical().toString()) or converted(pages))
    S.stream_fetch_join(spark, SF_SMALL)
    assert len(before) == 1 and "Join" not in before[0]
