"""Application tables derived deterministically from the given test tables.

The engine's own tables (content jobs, feeds, feed entries, submissions,
users, poll outcomes) are not shipped with the test data, so each is derived
here by a fixed rule from a given table; the same rules are restated in SQL
by the oracle module. No rule reads the wall clock.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import EXTRACT_ERROR, FIXTURE_EPOCH, FIXTURE_NOW, VOICES
from .tables import read_table

UNKNOWN_VOICE = "robot"


def now_ts() -> Column:
    return F.lit(FIXTURE_NOW).cast("timestamp_ntz")


def epoch_ts() -> Column:
    return F.lit(FIXTURE_EPOCH).cast("timestamp_ntz")


def voice_by(key: Column) -> Column:
    """One of the six voices, an unknown name, or missing, by ``key % 8``."""
    m = key % 8
    out = F.when(m == 6, F.lit(UNKNOWN_VOICE))
    for i, v in enumerate(VOICES):
        out = out.when(m == i, F.lit(v))
    return out.otherwise(F.lit(None).cast("string"))


def submission_url(event_id: Column) -> Column:
    return F.concat(F.lit("http://h"), (event_id % 1000).cast("string"), F.lit(".example.com/p"))


def _job_flags(key: Column) -> list[Column]:
    return [
        (key % 7 == 0).alias("is_processing"),
        (key % 3 != 0).alias("is_processed"),
        F.when(key % 11 == 0, F.lit(EXTRACT_ERROR)).when(key % 13 == 0, F.lit(""))
         .otherwise(F.lit(None).cast("string")).alias("error"),
    ]


def content_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content rows, one per page (id = page_id)."""
    p = read_table(spark, sf_dir, "pages", "page_id", "url")
    k = F.col("page_id")
    words = (F.length("url") * 50 + k % 100).cast("bigint")
    return p.select(
        k.alias("id"),
        F.col("url"),
        F.when(k % 19 == 0, F.lit("")).when(k % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Post "), k.cast("string"), F.lit(": "), F.col("url"))).alias("title"),
        words.alias("word_count"),
        F.when(k % 17 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("static/audio/"), F.md5("url"), F.lit(".mp3"))).alias("file_path"),
        (words.cast("double") / 150.0 * 60.0).alias("duration"),
        voice_by(k).alias("voice"),
        F.when(k % 2 == 0, k % 23).cast("bigint").alias("feed_id"),
        (epoch_ts() + F.make_dt_interval(F.lit(0), F.lit(0), k.cast("int"))).alias("created_at"),
        F.when(k % 5 != 0, k % 200 + 1).cast("bigint").alias("user_id"),
        *_job_flags(k),
    )


def content_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier content rows keyed by submission URL, from view/purchase events."""
    e = read_table(spark, sf_dir, "events", "event_id", "event_type")
    k = F.col("event_id")
    return (e.where(F.col("event_type").isin("view", "purchase"))
            .select(k.alias("id"), submission_url(k).alias("url"), *_job_flags(k)))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id")
    k = F.col("event_id")
    return e.select(k.alias("request_id"), F.col("user_id").alias("client"),
                    submission_url(k).alias("url"), voice_by(k).alias("voice"), F.col("ts"))


def feed_number(source: Column) -> Column:
    return F.regexp_extract(source, r"(\d+)$", 1).try_cast("bigint")


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed per document source (a partial aggregate, no wide state)."""
    d = read_table(spark, sf_dir, "documents", "source")
    ids = d.select("source").distinct().select("source", feed_number(F.col("source")).alias("id"))
    i = F.col("id")
    return ids.select(
        i,
        F.concat(F.lit("https://feeds.example.com/"), F.col("source"), F.lit(".xml")).alias("url"),
        F.when(i % 6 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Feed "), F.col("source"))).alias("title"),
        F.concat(F.lit("Articles from "), F.col("source")).alias("description"),
        F.when(i % 5 == 0, F.lit(None).cast("timestamp_ntz"))
         .otherwise(now_ts() - F.make_dt_interval(F.lit(0), F.lit(0), (i * 7).cast("int"))).alias("last_checked"),
        F.when(i % 3 == 0, F.lit(None).cast("timestamp_ntz"))
         .otherwise(now_ts() - F.make_dt_interval(F.lit(0), i.cast("int"))).alias("last_updated"),
        (i % 6).cast("int").alias("error_count"),
        (i % 4 != 0).alias("is_active"),
        (epoch_ts() + F.make_dt_interval(F.lit(0), i.cast("int"))).alias("created_at"),
        (i % 7 + 1).cast("bigint").alias("user_id"),
    )


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of every feed; document order within a feed is ``doc_id``.

    No position column is materialised here: numbering a whole feed would sort
    a hot feed in one task. Operators that need positions take the first N
    per feed, which Spark plans as a partial (map-side) group limit.
    """
    return entries_of(read_table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def entries_of(documents: DataFrame, *kept: str) -> DataFrame:
    """Feed entries from document rows (batch or one streaming micro-batch), with the columns ``kept``."""
    return documents.select(
        *kept,
        feed_number(F.col("source")).alias("feed_id"),
        F.col("doc_id").alias("entry_order"),
        F.when(F.col("doc_id") % 97 == 0, F.lit("")).otherwise(F.md5("text")).alias("link"),
        first_line(F.col("text")).alias("title"),
    )


def entry_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed_id, entry_order) of every entry, without reading a text."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "source")
    return d.select(feed_number(F.col("source")).alias("feed_id"), F.col("doc_id").alias("entry_order"))


def with_entry_texts(spark: SparkSession, sf_dir: str, chosen: DataFrame) -> DataFrame:
    """(feed_id, pos, link, title, entry_order) of chosen entries; text is read for these only."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    rows = d.join(chosen.select("pos", F.col("entry_order").alias("doc_id")), "doc_id")
    return entries_of(rows, "pos").select("feed_id", "pos", "link", "title", "entry_order")


def known_content_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs already in the content table: links of every fifth document."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.where(F.col("doc_id") % 5 == 0).select(F.md5("text").alias("url"))


def feed_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return e.select(F.col("user_id").alias("feed_id"), F.col("ts"), F.col("event_id").alias("poll_id"),
                    (F.col("event_type") != "error").alias("ok"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"),
                    F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email"))
