"""Structured Streaming forms of submission intake, conversion, quotas, job status and feed polling.

Every stream reads files, a bounded number per micro-batch, and keeps its
checkpoint and output in one work folder. Given the same folder again, a stream
resumes from its checkpoint; without one it starts afresh under the shared
checkpoint folder. What a stream must remember (addresses already emitted,
feeds already polled) is a table in that folder, written per batch or poll so that a replay
overwrites its own rows, and results don't depend on how files fall into
batches.
"""
from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..constants import ADMISSION_LIMIT, EXTRACT_ERROR, FIXTURE_EPOCH, RATE_API_SUBMIT, RATE_WEB_SUBMIT
from ..functions.status import content_status
from ..operators import feeds as FO
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as X
from ..operators.chunks import synthesis_manifest
from ..operators.extract import structural_extract
from ..operators.speech import prepare_speech, with_synthesis_error
from ..sources.tables import table_path
from .admission import VERDICT, standing, state_store, verdicts

WATERMARK = "1 hour"


#: Files taken into one micro-batch.
MAX_FILES = 32


def _workdir(spark: SparkSession, name: str, work: str | None = None) -> str:
    """The caller's work folder, or a new one under the shared checkpoint folder."""
    return work or os.path.join(ensure_checkpoint_dir(spark), "readaloud-streams", f"{name}-{uuid.uuid4().hex}")


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int = MAX_FILES) -> DataFrame:
    """A table (one file or a folder of files) as a streaming source."""
    path = table_path(sf_dir, name)
    schema = spark.read.parquet(path).schema
    # a glob that matches exactly this path, be it a file or a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path[:-1] + "[" + path[-1] + "]")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _drain(df: DataFrame, each, work: str) -> StreamingQuery:
    """Run ``each(batch, batch_id)`` over everything available now; the ended query tells how it went."""
    q = (df.writeStream.foreachBatch(each).option("checkpointLocation", os.path.join(work, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_available(writer: DataStreamWriter, work: str, fmt: str = "parquet") -> str:
    """Run a stream over everything available now; return the output folder."""
    out = os.path.join(work, "out")
    q = (writer.option("checkpointLocation", os.path.join(work, "checkpoint"))
         .trigger(availableNow=True).format(fmt).start(out))
    q.awaitTermination()
    return out


def write_batch_output(df: DataFrame, sink: str, batch_id: int) -> None:
    """Idempotent micro-batch write: each batch owns the folder ``batch_id=N``.

    A batch that is re-run after a failure overwrites its own folder instead of
    appending a second copy; readers see ``batch_id`` as a partition column.
    """
    df.write.mode("overwrite").parquet(os.path.join(sink, f"batch_id={batch_id}"))


def _event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; the tables carry TIMESTAMP_NTZ (UTC wall clock)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def submissions_stream(spark: SparkSession, sf_dir: str, max_files: int = MAX_FILES) -> DataFrame:
    e = stream_table(spark, sf_dir, "events", max_files)
    k = F.col("event_id")
    s = e.select(k.alias("request_id"), F.col("user_id").alias("client"), X.submission_url(k).alias("url"),
                 X.voice_by(k).alias("voice"), F.col("ts"))
    return _event_time(s)


#: Folders that the processed addresses are dealt into.
BUCKETS = 256


def stream_dedupe_submissions(spark: SparkSession, sf_dir: str, work: str | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """URLs that need a new job: not processed already and not emitted by an earlier batch.

    What was emitted is the state of a stream-wide ``dropDuplicates``, kept on disk by key, so a batch reads its own rows' keys and no
    earlier output. The addresses processed before the stream began are dealt into bucket folders once; a batch reads
    those that its new addresses fall into.
    """
    work = _workdir(spark, "dedupe", work)
    sink, known, fresh = (os.path.join(work, name) for name in ("out", "known", "fresh"))
    bucket = F.pmod(F.xxhash64("url"), F.lit(BUCKETS)).cast("int").alias("bucket")
    if not _exists(spark, os.path.join(known, "_SUCCESS")):
        done = X.content_log(spark, sf_dir).where(F.col("is_processed")).select("url", bucket).distinct()
        done.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(known)

    def emit(batch: DataFrame, batch_id: int) -> None:
        write_batch_output(batch, fresh, batch_id)  # the stateful part runs once
        new = spark.read.schema("url string, bucket int").parquet(os.path.join(fresh, f"batch_id={batch_id}"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        old = spark.read.schema("url string, bucket int").parquet(known).where(F.col("bucket").isin(touched))
        write_batch_output(new.join(old, ["bucket", "url"], "left_anti").select("url"), sink, batch_id)
    with state_store(spark):
        _drain(submissions_stream(spark, sf_dir, max_files).select("url", bucket).dropDuplicates(["url"]), emit, work)
    return spark.read.schema("url string, batch_id bigint").parquet(sink).select("url")


def _converted(pages: DataFrame) -> DataFrame:
    """Pages with url, html and voice through extraction and speech preparation."""
    jobs = structural_extract(pages, extra=["voice"]).select(F.col("page_id").alias("content_id"), "url", "title", "original_text", "error", "voice")
    return with_synthesis_error(prepare_speech(jobs))


def stream_convert(spark: SparkSession, sf_dir: str, work: str | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """Fetched pages through extraction and speech preparation to the synthesis manifest, as they arrive.

    A page comes with its markup, so a batch reads its own files alone; everything is row-local and the output append-only.
    """
    work = _workdir(spark, "convert", work)
    pages = stream_table(spark, sf_dir, "pages", max_files).select("page_id", "url", "html", X.voice_by(F.col("page_id")).alias("voice"))
    manifest = synthesis_manifest(_converted(pages), valid=F.col("error").isNull())
    return spark.read.schema(manifest.schema).parquet(run_available(manifest.writeStream.outputMode("append"), work))


#: A page that has not come so long after its submission never will.
FETCH_TIMEOUT = "10 minutes"
#: How far apart in event time rows may arrive; what both streams hold back for.
FETCH_LATENESS = "366 days"
_END = "2999-01-01 00:00:00"


def _with_end(spark: SparkSession, rows: DataFrame, key: str, time: str, work: str, side: str) -> DataFrame:
    """``rows`` and, once :func:`_end_streams` has written it, the row that ends the stream; the watermark counts both.

    The last row has a key, no other's: one without would be filtered before the watermark sees it.
    """
    schema = f"{key} bigint, {time} timestamp"
    end = spark.readStream.schema(schema).parquet(os.path.join(work, "end", side))
    return rows.unionByName(end, allowMissingColumns=True).withWatermark(time, FETCH_LATENESS)


def _end_streams(spark: SparkSession, work: str, sides: dict[str, tuple[str, str]], ended: bool) -> None:
    for i, (side, (key, time)) in enumerate(sides.items()):
        row = spark.range(1).select(F.lit(i - 2 ** 62).alias(key), F.lit(_END).cast("timestamp").alias(time)).where(F.lit(ended))
        row.write.mode("append" if ended else "ignore").parquet(os.path.join(work, "end", side))


def stream_fetch_join(spark: SparkSession, sf_dir: str, work: str | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """Submissions and fetched pages as two streams, joined: a row per submission with its outcome.

    A page counts if it comes within ``FETCH_TIMEOUT`` of its submission. A submission whose page has not come is the
    outer side of the join: the row that says it could not be extracted. It is issued when the watermarks have passed, at the latest
    when the streams end, which a last row on either side says; a stream that goes on simply never writes it. Both sides are held for ``FETCH_LATENESS``
    on disk, so that rows may come in any order; where they come in order a short one holds less. A page is converted as it
    arrives, once for all its submissions, so what is held is its outcome and not its markup.
    Every tenth page has a second submission whose page never comes.
    """
    work = _workdir(spark, "fetch", work)
    sides = {"submitted": ("submission_id", "ts"), "fetched": ("page_id", "fetched_at")}
    if not _exists(spark, os.path.join(work, "end")):
        _end_streams(spark, work, sides, False)
    k = F.col("page_id")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(FIXTURE_EPOCH).cast("timestamp")) + k * 60)
    pages = stream_table(spark, sf_dir, "pages", max_files)
    lost = F.when(k % 10 == 0, F.array(k, -1 - k)).otherwise(F.array(k))
    subs = pages.select(F.explode(lost).alias("submission_id"), "url", at.alias("ts"))
    arrived = stream_table(spark, sf_dir, "pages", max_files).select("page_id", "url", "html", X.voice_by(k).alias("voice"))
    fetched = _converted(arrived).select(F.col("content_id").alias("page_id"), "title", "error", F.length("processed_text").cast("bigint").alias("n_chars"),
                                         "word_count").withColumn("fetched_at", at + F.expr("interval 20 seconds"))
    subs, fetched = (_with_end(spark, rows, *sides[side], work, side) for side, rows in (("submitted", subs), ("fetched", fetched)))
    near = (F.col("submission_id") == k) & (F.col("fetched_at") >= F.col("ts")) & (F.col("fetched_at") <= F.col("ts") + F.expr(f"interval {FETCH_TIMEOUT}"))
    both = subs.join(fetched, near, "leftOuter").where(F.col("ts") < F.lit(_END).cast("timestamp"))
    missed = F.when(F.col("page_id").isNull(), F.lit(EXTRACT_ERROR))  # no page has come
    done = both.select("submission_id", "url", "title", F.coalesce(missed, "error").alias("error"), "n_chars", "word_count")
    with state_store(spark):
        for ended in (False, True):
            if ended:
                _end_streams(spark, work, sides, True)
            out = run_available(done.writeStream.outputMode("append"), work)
    return spark.read.schema(done.schema).parquet(out)


QUOTA = "client bigint, window_start timestamp, window_end timestamp, n bigint, last timestamp, batch_id bigint"


def stream_quota_windows(spark: SparkSession, sf_dir: str, work: str | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """Requests per client per hour, for windows that ended ``WATERMARK`` before the latest request of all.

    Each batch lands its own counts and they are summed over all batches, so a request counts however late it comes.
    """
    limit, period = RATE_API_SUBMIT
    work = _workdir(spark, "quota", work)
    sink = os.path.join(work, "out")

    def land(batch: DataFrame, batch_id: int) -> None:
        g = batch.groupBy(F.window("ts", period), "client").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
        write_batch_output(g.select("client", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                                    "n", "last"), sink, batch_id)
    _drain(submissions_stream(spark, sf_dir, max_files), land, work)
    landed = spark.read.schema(QUOTA).parquet(sink)
    closed = landed.agg(F.expr(f"max(last) - interval {WATERMARK}").alias("closed"))  # one row
    r = landed.groupBy("client", "window_start", "window_end").agg(F.sum("n").alias("n_requests"))
    return r.crossJoin(F.broadcast(closed)).where("window_end <= closed").select(
        "client", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n_requests", (F.col("n_requests") > limit).alias("over_limit"))


#: Ceilings that a request is judged under: the day's, which binds on the test tables, and the two of the submission forms.
CEILINGS = {"admitted": ADMISSION_LIMIT, "admitted_api": RATE_API_SUBMIT, "admitted_web": RATE_WEB_SUBMIT}


def stream_admission(spark: SparkSession, sf_dir: str, work: str | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """A verdict per request under each ceiling, issued as requests arrive and revised where a late one comes first in time."""
    work = _workdir(spark, "admission", work)
    sink = os.path.join(work, "out")
    requests = submissions_stream(spark, sf_dir, max_files).select("client", "request_id", "ts")
    with state_store(spark):
        _drain(verdicts(requests, CEILINGS), lambda batch, batch_id: write_batch_output(batch, sink, batch_id), work)
    landed = spark.read.schema(f"{VERDICT}, batch_id bigint").parquet(sink)
    ts = F.timestamp_micros("ts").cast("timestamp_ntz")
    return standing(landed, list(CEILINGS)).select("request_id", "client", ts.alias("ts"), F.date_trunc("day", ts).cast("timestamp_ntz").alias("window_start"), *CEILINGS)


def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job state changes derived from the content table: pending, processing, final."""
    c = X.content_jobs(spark, sf_dir)
    final = content_status(F.col("is_processed"), F.lit(False), F.col("error"))
    one_min = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1))
    ev = F.array(
        F.struct(F.col("created_at").alias("ts"), F.lit("pending").alias("status")),
        F.when(F.col("is_processing") | F.col("is_processed"),
               F.struct((F.col("created_at") + one_min).alias("ts"), F.lit("processing").alias("status"))),
        F.when(F.col("is_processed") & ~F.col("is_processing"),
               F.struct((F.col("created_at") + one_min + one_min).alias("ts"), final.alias("status"))))
    x = c.select("id", F.explode(F.filter(ev, lambda s: s.isNotNull())).alias("e"))
    return x.select("id", F.col("e.ts").alias("ts"), F.col("e.status").alias("status"))


def stream_latest_status(spark: SparkSession, sf_dir: str, work: str | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """Latest status per job from the transition stream (state: one row per job)."""
    work = _workdir(spark, "status", work)
    log_dir = os.path.join(work, "log")
    if not _exists(spark, log_dir):
        status_transitions(spark, sf_dir).write.parquet(log_dir)
    schema = spark.read.parquet(log_dir).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(log_dir)
    latest = src.groupBy("id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("updated_at"))
    sink = os.path.join(work, "batches")

    def write_batch(df: DataFrame, batch_id: int) -> None:
        write_batch_output(df, sink, batch_id)

    q = (latest.writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", os.path.join(work, "checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    r = spark.read.parquet(sink)
    last = r.groupBy("id").agg(F.max_by(F.struct("status", "updated_at"), "batch_id").alias("s"))
    return last.select("id", F.col("s.status").alias("status"))


#: A job's next change within this time belongs to the same attempt.
ATTEMPT_GAP = "30 minutes"


def attempt_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state changes of :func:`status_transitions`, with second attempts that stop in processing and final states that come too early."""
    t = status_transitions(spark, sf_dir)
    again = t.where((F.col("id") % 7 == 3) & (F.col("status") != "error")).where(F.col("status").isin("pending", "processing")).select(
        "id", (F.col("ts") + F.expr("interval 2 hours")).alias("ts"), "status")
    early = F.when((F.col("id") % 11 == 5) & ~F.col("status").isin("pending", "processing"), F.col("ts") - F.expr("interval 90 seconds")).otherwise(F.col("ts"))
    return t.withColumn("ts", early).unionByName(again)


def attempts(transitions: DataFrame) -> DataFrame:
    """One row per attempt of a job: a session of changes no further apart than ``ATTEMPT_GAP``, and how it went.

    An attempt is complete when pending, processing and one final state follow in that order, waiting or stuck when it ends
    in pending or processing, illegal otherwise. Counts and extreme times say so, so a session's
    changes are never gathered, however many there are.
    """
    def when(status: Column) -> dict[str, Column]:
        own = F.when(status, F.col("ts"))
        return {"n": F.count(own), "first": F.min(own), "last": F.max(own)}
    pending, processing = F.col("status") == "pending", F.col("status") == "processing"
    kinds = {"p": when(pending), "r": when(processing), "f": when(~pending & ~processing)}
    g = transitions.groupBy("id", F.session_window("ts", ATTEMPT_GAP).alias("w")).agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n_changes"),
        *[c.alias(f"{k}_{n}") for k, cs in kinds.items() for n, c in cs.items()])
    in_order = (F.col("p_n") == 1) & (F.col("r_n") <= 1) & (F.col("f_n") <= 1) & F.coalesce(F.col("r_first") >= F.col("p_last"), F.lit(True)) & \
        F.coalesce(F.col("f_first") >= F.col("r_last"), F.col("f_n") == 0)
    outcome = F.when(~in_order, "illegal").when(F.col("f_n") == 1, "complete").when(F.col("r_n") == 1, "stuck").otherwise("waiting")
    return g.select("id", "started", "ended", "n_changes", outcome.alias("outcome"))


def stream_attempts(spark: SparkSession, sf_dir: str, work: str | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """Attempts of all jobs from the stream of their state changes; an open session is closed by the row that ends the stream."""
    work = _workdir(spark, "attempts", work)
    log_dir, sides = os.path.join(work, "log"), {"changes": ("id", "ts")}
    schema = "id bigint, ts timestamp, status string"
    if not _exists(spark, log_dir):
        _event_time(attempt_transitions(spark, sf_dir)).write.parquet(log_dir)
        _end_streams(spark, work, sides, False)
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(log_dir)
    done = attempts(_with_end(spark, log, "id", "ts", work, "changes")).where(F.col("ended") < F.lit(_END).cast("timestamp"))
    for ended in (False, True):
        if ended:
            _end_streams(spark, work, sides, True)
        out = run_available(done.writeStream.outputMode("append"), work)
    ntz = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")]
    return spark.read.schema(done.schema).parquet(out).select("id", *ntz, "n_changes", "outcome")


ENTRIES = "feed_id bigint, entry_order bigint, link string, title string, batch_id bigint"
CREATED = "url string, feed_id bigint, pos int, title string, user_id bigint, poll_id bigint"
CHECKED = "feed_id bigint, checked timestamp_ntz, poll_id bigint"


def land_entries(spark: SparkSession, sf_dir: str, work: str, poll_id: int, max_files: int = MAX_FILES) -> None:
    """Land the entries that a poll fetched; a snapshot may arrive in any number of batches."""
    sink = os.path.join(work, f"snapshot-{poll_id}")

    def land(batch: DataFrame, batch_id: int) -> None:
        write_batch_output(X.entries_of(batch), sink, batch_id)
    _drain(stream_table(spark, sf_dir, "documents", max_files), land, os.path.join(work, f"landing-{poll_id}"))


def refresh_poll(spark: SparkSession, sf_dir: str, work: str, poll_id: int, now) -> None:
    """One refresh over a whole landed snapshot: due feeds, first entries per feed, new links only.

    Links are checked against the stored content and what earlier polls
    created, and a feed's last check is the latest of its stored one and the earlier
    polls'. Rows are written per poll, so a repeated refresh replaces its own.
    """
    created, checked = os.path.join(work, "created"), os.path.join(work, "checked")
    feeds, known = X.feeds(spark, sf_dir), X.known_content_urls(spark, sf_dir)
    if _exists(spark, created):
        known = known.unionByName(spark.read.schema(CREATED).parquet(created).where(F.col("poll_id") < poll_id).select("url"))
    if _exists(spark, checked):
        last = spark.read.schema(CHECKED).parquet(checked).where(F.col("poll_id") < poll_id).groupBy("feed_id").agg(F.max("checked").alias("_at"))
        feeds = feeds.join(last.withColumnRenamed("feed_id", "id"), "id", "left").withColumn(
            "last_checked", F.greatest("last_checked", "_at")).drop("_at")
    entries = spark.read.schema(ENTRIES).parquet(os.path.join(work, f"snapshot-{poll_id}")).drop("batch_id")
    due = FO.due_feeds(feeds, now).select(F.col("id").alias("feed_id"))
    top = FO.top_entries(entries.join(due, "feed_id", "left_semi"))
    FO.new_entries(top, known, feeds).select("url", "feed_id", "pos", "title", "user_id").write.mode("overwrite").parquet(
        os.path.join(created, f"poll_id={poll_id}"))
    due.select("feed_id", now.alias("checked")).write.mode("overwrite").parquet(os.path.join(checked, f"poll_id={poll_id}"))


def stream_feed_poll(spark: SparkSession, sf_dir: str, work: str | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """Feed polling: the fetched snapshot streams in, then one refresh runs over all of it."""
    work = _workdir(spark, "feedpoll", work)
    land_entries(spark, sf_dir, work, 0, max_files)
    refresh_poll(spark, sf_dir, work, 0, X.now_ts())
    return spark.read.schema(CREATED).parquet(os.path.join(work, "created")).select("url", "feed_id", "pos", "title", "user_id")
