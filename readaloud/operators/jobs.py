"""Job, request and quota operators.

Lookups by key are aggregates with partial (map-side) combine rather than
windows over whole key groups, so a hot key never sorts in one task; the
one per-row ranking (admission) ranks only the first ``limit`` rows per
group, which Spark plans as a partial group limit.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.status import truthy
from ..functions.urls import is_valid_url


def first_per_key(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """One row per ``key``: the row with the lowest ``order``, a unique id.

    The least id is a hash aggregate (the minimum of a struct would sort every task's rows), and its row is joined back.
    """
    low = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
    names = [c for c in cols if c != order]
    return low.join(df.select(F.col(order), *[c for c in names if c != key]), order).select(key, *cols)


def cache_lookup(requests: DataFrame, content: DataFrame, api_rule: bool) -> DataFrame:
    """Request -> existing content decision, one row per request.

    Web rule: a processed row (even with an error) is reused. API rule: only a
    processed row without error is reused. Anything else queues a new job.
    The content side is first reduced to one row per URL, then left-joined.
    """
    first = first_per_key(content, "url", "id", ["id", "is_processed", "error"])
    j = requests.join(first, "url", "left")
    reuse = F.col("is_processed") & (~truthy(F.col("error")) if api_rule else F.lit(True))
    valid = is_valid_url(F.col("url"))
    hit = F.coalesce(reuse, F.lit(False))
    action = (F.when(~valid, F.lit("invalid"))
              .when(hit, F.lit("already_processed" if api_rule else "result"))
              .otherwise(F.lit("processing" if api_rule else "new_job")))
    return j.select("request_id", "url", action.alias("action"),
                    F.when(valid & hit, F.col("id")).alias("content_id"))


def admit(requests: DataFrame, key: str, ts: str, order: str, limit: int, period: str) -> DataFrame:
    """Per-request admission under ``limit`` requests per key per tumbling period.

    The first ``limit`` requests of each (key, window) are found with a ranked
    filter (planned as a partial group limit, so each task keeps at most
    ``limit`` rows per group before the shuffle); the last admitted position
    per group is joined back and every request is compared with it.
    """
    w = F.window(F.col(ts), period).start.alias("window_start")
    r = requests.select("*", w)
    spec = Window.partitionBy(key, "window_start").orderBy(F.col(ts), F.col(order))
    top = r.select(key, "window_start", ts, order).withColumn("_rn", F.row_number().over(spec)).where(F.col("_rn") <= limit)
    last = top.groupBy(key, "window_start").agg(F.max(F.struct(F.col(ts), F.col(order))).alias("_last"))
    j = r.join(last, [key, "window_start"], "left")
    admitted = F.struct(F.col(ts), F.col(order)) <= F.col("_last")
    return j.select(*requests.columns, "window_start", F.coalesce(admitted, F.lit(False)).alias("admitted"))


def window_counts(requests: DataFrame, key: str, ts: str, limit: int, period: str) -> DataFrame:
    """Requests, admitted and rejected per (key, window): a pure partial aggregate."""
    g = requests.groupBy(key, F.window(F.col(ts), period).start.alias("window_start")) \
        .agg(F.count(F.lit(1)).alias("n_requests"))
    return g.select(key, "window_start", "n_requests",
                    F.least(F.col("n_requests"), F.lit(limit).cast("bigint")).alias("n_admitted"),
                    F.greatest(F.col("n_requests") - limit, F.lit(0).cast("bigint")).alias("n_rejected"))


def status_json(c: DataFrame, base_url: str) -> Column:
    """Status document with fields depending on state (completed keeps null fields)."""
    from ..functions.status import content_status
    st = content_status(F.col("is_processed"), F.col("is_processing"), F.col("error"))
    audio = F.concat(F.lit(base_url + "/download/"), F.col("id").cast("string"))
    done = F.col("is_processed") & ~truthy(F.col("error"))
    failed = F.col("is_processed") & truthy(F.col("error"))
    full = F.to_json(F.struct(st.alias("status"), F.col("id").alias("content_id"), audio.alias("audio_url"),
                              F.col("title"), F.col("duration"), F.col("word_count")),
                     {"ignoreNullFields": "false"})
    err = F.to_json(F.struct(st.alias("status"), F.col("id").alias("content_id"), F.col("error")))
    bare = F.to_json(F.struct(st.alias("status"), F.col("id").alias("content_id")))
    return F.when(done, full).when(failed, err).otherwise(bare)
