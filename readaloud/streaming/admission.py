"""Admission of a request stream under ceilings: a verdict per request, as it arrives.

A ceiling lets the first ``limit`` requests of a client and window through, by time and then by id. The state of a client's day
is the list of requests let through so far under each ceiling, so it never holds more than the ceilings allow. Clients are dealt
into ``CLIENT_BUCKETS`` and a bucket's day is one entry of the store, because what a call into Python and to the store costs
is many times what a request costs. A request
that arrives late but is earlier in time takes its place and the last one let through loses it: that one's verdict is
issued again. The latest verdict of a request stands, so results don't depend on how requests fall into batches. A
timer drops the state ``lateness`` after its day; what comes later than that is not judged.

A bucket is one state per day, not one for all time. This is the one place of the article engine where Python runs per row: keyed state
with timers has no built-in form.
"""
from __future__ import annotations

import sys
from bisect import insort
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000_000
LATENESS_DAYS = 366
#: Groups of clients that are judged together, a day at a time; a client without an id is a group of its own.
CLIENT_BUCKETS = 1024
VERDICT = "client bigint, request_id bigint, ts bigint, ceiling string, admitted boolean"

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Admission(StatefulProcessor):
    """``ceilings``: (name, limit, window in microseconds that divides a day)."""

    def __init__(self, ceilings: list[tuple[str, int, int]], lateness_days: int):
        self.ceilings, self.lateness = ceilings, lateness_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one row of columns: rows of their own are sent to the store one by one
        self.kept = handle.getValueState("kept", "client array<bigint>, ceiling array<int>, ts array<bigint>, request_id array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bucket, day = key
        held: dict[tuple[int | None, int, int], list] = {}
        for client, c, ts, request in zip(*(self.kept.get() or ([],) * 4), strict=True):
            held.setdefault((client, c, ts // self.ceilings[c][2]), []).append((ts, request))
        for places in held.values():
            places.sort()
        verdicts: dict[tuple[int | None, int, int, int], bool] = {}
        for frame in rows:
            clients = [None] * len(frame) if pd.isna(bucket) else frame["client"].tolist()  # a null key may come as NaN
            for client, ts, request in zip(clients, frame["us"].tolist(), frame["request_id"].tolist(), strict=True):
                for c, (_, limit, width) in enumerate(self.ceilings):
                    places = held.setdefault((client, c, ts // width), [])
                    verdicts[client, c, ts, request] = True
                    insort(places, (ts, request))
                    if len(places) > limit:
                        out = places.pop()
                        verdicts[(client, c, *out)] = False
        kept = [(client, c, ts, request) for (client, c, _), places in held.items() for ts, request in places]
        self.kept.update(tuple(map(list, zip(*kept, strict=True))))
        self.handle.registerTimer((day * DAY + DAY + self.lateness) // 1000)
        yield pd.DataFrame({"client": [k[0] for k in verdicts], "request_id": [k[3] for k in verdicts], "ts": [k[2] for k in verdicts],
                            "ceiling": [self.ceilings[k[1]][0] for k in verdicts], "admitted": list(verdicts.values())})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def verdicts(requests: DataFrame, ceilings: dict[str, tuple[int, str]], lateness_days: int = LATENESS_DAYS) -> DataFrame:
    """Stream of verdicts over a stream of (client, request_id, ts); ``ceilings``: name -> (limit, window such as '1 hour')."""
    minutes = {"minute": 1, "hour": 60, "day": 1440}
    rules = []
    for name, (limit, window) in ceilings.items():
        n, unit = window.split()
        rules.append((name, limit, int(n) * minutes[unit] * 60_000_000))
        if DAY % rules[-1][2]:
            raise ValueError(f"{window} doesn't divide a day")
    # workers get the processor itself: files added to the session don't reach the one that sets up its state
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    us = F.unix_micros("ts")
    bucket = F.when(F.col("client").isNotNull(), F.pmod(F.xxhash64("client"), F.lit(CLIENT_BUCKETS)))
    keyed = requests.withWatermark("ts", f"{lateness_days} days").select(
        "client", "request_id", "ts", us.alias("us"), bucket.alias("bucket"), F.floor(us / DAY).cast("bigint").alias("day"))
    return keyed.groupBy("bucket", "day").transformWithStateInPandas(
        _Admission(rules, lateness_days), outputStructType=VERDICT, outputMode="Update", timeMode="EventTime")


@contextmanager
def state_store(spark: SparkSession):
    """Streams with timers need the store that keeps state on disk; the session's own choice comes back afterwards."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def standing(landed: DataFrame, names: list[str]) -> DataFrame:
    """The latest verdict of each request, a column per ceiling; ``landed`` has a ``batch_id``."""
    latest = [F.max_by(F.when(F.col("ceiling") == n, F.col("admitted")), F.when(F.col("ceiling") == n, F.col("batch_id"))).alias(n) for n in names]
    return landed.groupBy("request_id", "client", "ts").agg(*latest)
