"""Stateful streams against their closed forms, on logs that are replayed in batches, and state that timers drop."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheaf.streaming import keyed, pacing

START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def replayed(spark, tmp_path, rows, schema, make, batches=4):
    """Rows, in order, through a stream of as many files; stopped and started again after each."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    n = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * n : (i + 1) * n], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = make(spark.readStream.schema(schema).parquet(str(source)))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def cache_log(n, seed=1):
    r, at, rows = random.Random(seed), START, []
    for i in range(n):
        at += timedelta(days=r.choice([0, 0, 1, 30, 91]), hours=r.randint(0, 30))
        rows.append((f"k{r.randint(0, 3)}", at, i, r.choice(["get", "get", "put"]), f"v{i}"))
    return rows


def test_cache(rocks, tmp_path):
    schema = "key string, at timestamp, seq long, op string, value string"
    rows = cache_log(120)
    got = sorted(tuple(r) for r in replayed(rocks, tmp_path, rows, schema, keyed.cached_stream).select("seq", "key", "hit", "value").collect())
    want = sorted(tuple(r) for r in keyed.looked_up(rocks.createDataFrame(rows, schema)).select("seq", "key", "hit", "value").collect())
    held, brute = {}, []
    for key, at, seq, op, value in rows:
        if op == "put":
            held[key] = at, value
        else:
            hit = key in held and (at - held[key][0]).days <= pacing.TTL_DAYS
            brute.append((seq, key, hit, held[key][1] if hit else None))
    assert want == sorted(brute) == got and 0 < sum(r[2] for r in got) < len(got)


def test_cache_state():
    """accessed is touched by hits only; a put resets both times; a read of an expired entry deletes it."""
    cache = keyed.Cache(90)

    def rows(*entries):
        return pd.DataFrame([("k", START + timedelta(days=d), i, op, v) for i, (d, op, v) in enumerate(entries)], columns=["key", "at", "seq", "op", "value"])

    day = lambda d: (START + timedelta(days=d) - datetime(1970, 1, 1)).total_seconds()
    out, state, until = cache.step(None, rows((0, "get", None), (1, "put", "a"), (5, "get", None)))
    assert out["hit"].tolist() == [False, True] and state == ("a", day(1), day(5)) and until == day(92)
    assert cache.step(state, rows((91.9, "get", None)))[0]["hit"].tolist() == [True]
    out, gone, _ = cache.step(state, rows((92, "get", None)))
    assert out["hit"].tolist() == [False] and gone is None
    assert cache.step(state, rows((92, "get", None), (93, "put", "b")))[1] == ("b", day(93), day(93))
    assert cache.step(None, rows((1, "get", None)))[1] is None


def test_budget_and_flight(rocks, tmp_path):
    r = random.Random(2)
    at, calls = START, []
    for i in range(150):
        at += timedelta(seconds=r.randint(1, 9))
        calls.append((f"r{r.randint(0, 1)}", f"e{r.randint(0, 2)}", at, i, at + timedelta(seconds=r.randint(0, 30))))
    schema = "run_id string, endpoint string, at timestamp, seq long, ended timestamp"
    table = rocks.createDataFrame(calls, schema)
    got = replayed(rocks, tmp_path / "a", calls, schema, lambda s: keyed.budgeted_stream(s, 7))
    want = pacing.budgeted(table, 7, ["run_id", "endpoint"], "at", "seq")
    assert sorted(tuple(x) for x in got.select("seq", "allowed").collect()) == sorted(tuple(x) for x in want.select("seq", "allowed").collect())
    of_key = lambda df: df.withColumn("key", F.col("endpoint"))
    got = replayed(rocks, tmp_path / "b", calls, schema, lambda s: keyed.single_flight_stream(of_key(s)))
    want = pacing.single_flight(of_key(table), start="at", end="ended", order="seq")
    joined = sorted(tuple(x) for x in got.select("seq", "joined").collect())
    assert joined == sorted(tuple(x) for x in want.select("seq", "joined").collect()) and 0 < sum(j for _, j in joined) < 150


class Store:
    def __init__(self, row=None):
        self.row = row

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def clear(self):
        self.row = None


@pytest.mark.parametrize(("until", "expiry", "kept"), [(10.0, 10_000, False), (10.0, 9_000, True), (12.5, 12_500, False)])
def test_timers_drop_only_what_is_over(until, expiry, kept):
    class Info:
        def getExpiryTimeInMs(self):  # noqa: N802
            return expiry

    made = keyed.Budget(1, 5.0)
    made.state = Store((3, until))
    assert list(made.handleExpiredTimer(("k",), None, Info())) == [] and made.state.exists() is kept
    assert np.isfinite(until)
