"""Pacing, budgets, expiry and deduplication: closed forms on tables, and the same on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.retrieval import first_seen
from ..operators.scans import placed, running

#: Seconds between the calls of an endpoint, calls in a run, days that a vector is kept.
INTERVALS = {"s2": 1.1, "s2_keyed": 0.5, "arxiv": 3.0, "ar5iv": 1.0, "pdf": 1.0}
BUDGETS = {"s2": 40, "arxiv": 40, "ar5iv": 150, "pdf": 30}
TTL_DAYS = 90


def paced(calls: DataFrame, interval: float | Column, endpoint: str = "endpoint", arrival: str = "arrival", order: str = "call_id") -> DataFrame:
    """calls with the second at which each is granted: not before it arrives, nor within the interval after the grant before it.

    In order of arrival, grant i is the greatest of arrival j + (i - j) * interval over j <= i:
    a running maximum, found by a partitioned prefix scan, so an endpoint may have any number of calls.
    """
    d = F.lit(float(interval)) if isinstance(interval, (int, float)) else interval
    rows = running(placed(calls.withColumn("_d", d), [endpoint], [arrival, order]), [endpoint], "_n", "sum", F.lit(1), before=True)
    top = running(rows, [endpoint], "_top", "max", F.col(arrival) - F.col("_n") * F.col("_d"))
    return top.withColumn("granted", F.col("_top") + F.col("_n") * F.col("_d")).withColumn("waited", F.col("granted") - F.col(arrival)).drop("_n", "_d", "_top", "_at", "_part")


def budgeted(calls: DataFrame, budget: int, keys: list[str], *order: str) -> DataFrame:
    """calls with whether they are within the first `budget` of their key, which may have any number of calls."""
    return running(placed(calls, keys, list(order)), keys, "_n", "sum", F.lit(1)).withColumn("allowed", F.col("_n") <= budget).drop("_n", "_at", "_part")


def backoff(attempt: Column, retry_after: Column, most: int = 3) -> Column:
    """Seconds to wait after a failed attempt (from 0): what the server says, else 2 ** attempt; null when attempts are used up."""
    return F.when(attempt + 1 < most, F.coalesce(retry_after.cast("double"), F.pow(F.lit(2.0), attempt)))


def single_flight(calls: DataFrame, key: str = "key", start: str = "started", end: str = "ended", order: str = "call_id") -> DataFrame:
    """calls with whether they start while an earlier call of their key, as it was asked for, is still open."""
    w = Window.partitionBy(key).orderBy(start, order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("joined", F.coalesce(F.max(end).over(w) > F.col(start), F.lit(False)))


def cache_key(content: Column) -> Column:
    return F.sha2(content, 256)


def alive(created: Column, now: Column, days: int = TTL_DAYS) -> Column:
    """Whether no more than `days` whole days have gone since a time; what is no time has expired."""
    seconds = now.try_cast("timestamp").cast("long") - created.try_cast("timestamp").cast("long")
    return F.coalesce(F.floor(seconds / 86_400) <= days, F.lit(False))


def paced_stream(calls: DataFrame, interval: float, endpoint: str = "endpoint", arrival: str = "arrival") -> DataFrame:
    """A stream of (endpoint, call_id, arrival) with grants; the state of an endpoint is its last grant.

    Within a micro-batch calls are taken by arrival and id; later batches come after.
    """

    def grant(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        got = pd.concat(list(batches)).sort_values([arrival, "call_id"])
        out = []
        for a in got[arrival]:
            last = a if last is None else max(a, last + interval)
            out.append(last)
        if last is not None:
            state.update((float(last),))
        yield pd.DataFrame({"endpoint": key[0], "call_id": got["call_id"], "granted": out})

    return calls.select(F.col(endpoint).alias("endpoint"), "call_id", F.col(arrival).cast("double").alias(arrival)).groupBy("endpoint").applyInPandasWithState(grant, "endpoint string, call_id long, granted double", "last double", "append", GroupStateTimeout.NoTimeout)


def first_entries(entries: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """A stream's first entry of each key within a delay."""
    return entries.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def keep_first_batch(target: str, keys: list[str], *order: str):
    """foreachBatch sink: append what the target table does not have yet, the first row of each key."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = first_seen(batch, keys, *order)
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(target).select(*keys), keys, "left_anti")
        new.write.mode("append").parquet(target)

    return write


def windowed(events: DataFrame, time: str, size: str, slide: str | None = None, *keys: str) -> DataFrame:
    """Counts and sums of value by window: tumbling, or sliding."""
    return events.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    return events.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")
