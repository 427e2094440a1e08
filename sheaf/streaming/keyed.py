"""Caches, call budgets and single flights on streams: one state for each key, forgotten by a timer of event time.

Each is the closed form of `pacing` (for the cache, `looked_up`) as a stateful operator: what a
key's rows of one micro-batch need of the past is one small row of state, and the rest is computed
on whole columns. Rows of a micro-batch are taken in the order of their time and number; batches
come in order, as a log that is replayed does. Rows behind the watermark are dropped by Spark. The
state store must be RocksDB (spark.sql.streaming.stateStore.providerClass).

State is dropped when the watermark says that it can't matter any more: a cache's entry when it has
expired, a flight when it has landed, and a run's budget after it had no call for `idle` seconds,
which is taken as the run's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scans import placed, running
from .pacing import TTL_DAYS

DAY = 86_400.0


class OneRow(StatefulProcessor):
    """A key's state is one row of `schema`; `step` takes it and the key's rows, and gives the rows' results, the new state, and the second until which it is of use."""

    schema = ""
    #: Columns that order the rows.
    order: tuple[str, str] = ("at", "seq")

    def step(self, state: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple | None, float]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema + ", until double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        whole = pd.concat(list(rows)).sort_values(list(self.order), kind="stable").reset_index(drop=True)
        before = self.state.get() if self.state.exists() else None
        out, state, until = self.step(None if before is None else tuple(before)[:-1], whole)
        if state is None:
            self.state.clear()
        else:
            self.state.update((*state, float(until)))
            self.handle.registerTimer(int(np.ceil(until * 1000)))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # older timers of a state that was renewed since find it of use still
        if self.state.exists() and tuple(self.state.get())[-1] * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def seconds(column: pd.Series) -> np.ndarray:
    return pd.to_datetime(column, utc=True).astype("datetime64[us, UTC]").astype("int64").to_numpy() / 1e6


class Cache(OneRow):
    """get, and put, which replaces: of a key (value, created, accessed)."""

    schema = "value string, created double, accessed double"

    def __init__(self, days: int):
        self.days = days

    def step(self, state, rows):
        at, is_put = seconds(rows["at"]), (rows["op"] == "put").to_numpy()
        # the last put before each row: -1 is the state's
        last = np.maximum.accumulate(np.where(is_put, np.arange(len(rows)), -1))
        last = np.where(is_put, last, np.concatenate(([-1], last[:-1]))) if len(rows) else last
        created = np.where(last >= 0, at[np.maximum(last, 0)], state[1] if state else -np.inf)
        value = np.where(last >= 0, rows["value"].to_numpy(object)[np.maximum(last, 0)], state[0] if state else None)
        hit = ~is_put & np.isfinite(created) & (np.floor((at - created) / DAY) <= self.days)
        got = rows[~is_put]
        out = pd.DataFrame({"key": got["key"], "at": got["at"], "seq": got["seq"], "hit": hit[~is_put], "value": np.where(hit, value, None)[~is_put]})
        if not is_put.any() and state is None:
            return out, None, 0.0
        end = int(last[-1])
        kept = (rows["value"].iloc[end], float(at[end])) if end >= 0 else state[:2]
        touched = at[hit & (np.arange(len(rows)) > end)]
        accessed = float(touched[-1]) if len(touched) else kept[1] if end >= 0 else state[2]
        if ((~is_put & ~hit) & (np.arange(len(rows)) > end)).any():
            return out, None, 0.0  # deleted by the read that found it expired
        return out, (*kept, accessed), kept[1] + (self.days + 1) * DAY


class Budget(OneRow):
    """The first calls of a run and endpoint are allowed: of a key the number of its calls."""

    schema = "n long"

    def __init__(self, budget: int, idle: float):
        self.budget, self.idle = budget, idle

    def step(self, state, rows):
        n = (state[0] if state else 0) + np.arange(1, len(rows) + 1)
        out = pd.DataFrame({"run_id": rows["run_id"], "endpoint": rows["endpoint"], "seq": rows["seq"], "allowed": n <= self.budget})
        return out, (int(n[-1]),), float(seconds(rows["at"]).max()) + self.idle


class Flight(OneRow):
    """Calls that start while an earlier one of their key is open join it: of a key the latest end."""

    schema = "ended double"

    def step(self, state, rows):
        at, end = seconds(rows["at"]), seconds(rows["ended"])
        open_until = np.maximum.accumulate(np.concatenate(([state[0] if state else -np.inf], end)))
        out = pd.DataFrame({"key": rows["key"], "seq": rows["seq"], "joined": open_until[:-1] > at})
        return out, (float(open_until[-1]),), float(open_until[-1])


def stateful(rows: DataFrame, keys: list[str], made: OneRow, schema: str, delay: str) -> DataFrame:
    return rows.withWatermark("at", delay).groupBy(*keys).transformWithStateInPandas(made, schema, "Append", "EventTime")


def cached_stream(log: DataFrame, days: int = TTL_DAYS, delay: str = "0 seconds") -> DataFrame:
    """(key, at, seq, hit, value) of each get in a stream of (key, at, seq, op `get` or `put`, value)."""
    return stateful(log.select("key", "at", "seq", "op", "value"), ["key"], Cache(days), "key string, at timestamp, seq long, hit boolean, value string", delay)


def budgeted_stream(calls: DataFrame, budget: int, idle: float = 3600.0, delay: str = "0 seconds") -> DataFrame:
    """(run_id, endpoint, seq, allowed) of a stream of calls (run_id, endpoint, at, seq); budgets are of a run and endpoint."""
    return stateful(calls.select("run_id", "endpoint", "at", "seq"), ["run_id", "endpoint"], Budget(budget, idle), "run_id string, endpoint string, seq long, allowed boolean", delay)


def single_flight_stream(calls: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(key, seq, joined) of a stream of calls (key, at, ended, seq)."""
    return stateful(calls.select("key", "at", "ended", "seq"), ["key"], Flight(), "key string, seq long, joined boolean", delay)


def looked_up(log: DataFrame, days: int = TTL_DAYS) -> DataFrame:
    """What `cached_stream` gives, of a whole log as a table: each get sees the last put before it, if that has not expired.

    The last put is a running maximum, found by a partitioned scan, so a key may have any number of rows.
    """
    put = F.when(F.col("op") == "put", F.struct("at", "seq", "value"))
    rows = running(placed(log, ["key"], ["at", "seq"]), ["key"], "_put", "max", put)
    age = F.floor((F.unix_micros("at") - F.unix_micros("_put.at")) / F.lit(DAY * 1e6))
    hit = F.coalesce(age <= days, F.lit(False))
    return rows.filter("op = 'get'").select("key", "at", "seq", hit.alias("hit"), F.when(hit, F.col("_put.value")).alias("value"))
