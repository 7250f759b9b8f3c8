"""Constraint report and schema-evolution queries."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as C
from ..schemas import LENGTHS
from ..sources import fixtures as X
from ..sources.tables import read_table

#: Declared lengths come from the schema of each table.
CONTENT_LIMITS, USER_LIMITS, FEED_LIMITS = LENGTHS["content"], LENGTHS["user"], LENGTHS["feed"]


def doc_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content rows as a feed would create them from documents (title = first line, hash of url and text)."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select(F.col("doc_id").alias("id"), F.md5("text").alias("url"),
                    F.element_at(F.split("text", "\n", -1), 1).alias("title"),
                    F.md5("text").alias("content_hash"),
                    F.concat(F.element_at(F.split("text", "\n", -1), 1), F.lit(".mp3")).alias("filename"),
                    F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("voice"))


def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    content, feeds, users = X.content_jobs(spark, sf_dir), X.feeds(spark, sf_dir), X.users(spark, sf_dir)
    return reduce(DataFrame.unionByName, [
        C.orphans(content, "id", "feed_id", feeds, "id", "content.feed_id"),
        C.orphans(content, "id", "user_id", users, "id", "content.user_id"),
        C.orphans(feeds, "id", "user_id", users, "id", "feed.user_id"),
    ])


def length_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        C.length_violations(X.content_jobs(spark, sf_dir), "content", "id", CONTENT_LIMITS),
        C.length_violations(doc_content(spark, sf_dir), "doc_content", "id", CONTENT_LIMITS),
        C.length_violations(X.users(spark, sf_dir), "user", "id", USER_LIMITS),
        C.length_violations(X.feeds(spark, sf_dir), "feed", "id", FEED_LIMITS),
    ])


def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that break a unique column: user names and addresses, content hashes, feed urls (nulls may repeat)."""
    users, feeds, content = X.users(spark, sf_dir), X.feeds(spark, sf_dir), doc_content(spark, sf_dir)
    host = users.select("username", F.regexp_replace("email", "[0-9]", "").alias("email"))  # addresses without digits collide
    parts = [("user.username", users, "username"), ("user.email", host, "email"), ("feed.url", feeds, "url"),
             ("content.content_hash", content, "content_hash")]
    return reduce(DataFrame.unionByName, [C.unique_violations(df, column).select(
        F.lit(name).alias("column_name"), F.col(column).alias("value"), "n_rows") for name, df, column in parts])


def null_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that would break NOT NULL url: content, feeds, and feed entries without a link."""
    e = X.feed_entries(spark, sf_dir).select("entry_order", F.when(F.col("link") != "", F.col("link")).alias("url"))
    return reduce(DataFrame.unionByName, [
        C.null_violations(X.content_jobs(spark, sf_dir), "content", "id", "url"),
        C.null_violations(X.feeds(spark, sf_dir), "feed", "id", "url"),
        C.null_violations(e, "feed_entry", "entry_order", "url"),
    ])


def schema_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written before the feed column existed, unioned with rows written after.

    The older rows simply lack ``feed_id``; ``unionByName`` fills it with NULL,
    which is what the additive migration does to stored rows.
    """
    old = X.content_log(spark, sf_dir).select(F.lit("log").alias("source"), "id", "url", "is_processed")
    new = X.content_jobs(spark, sf_dir).select(F.lit("jobs").alias("source"), "id", "url", "is_processed", "feed_id")
    return old.unionByName(new, allowMissingColumns=True)
