"""Queries over calls and events: pacing, budgets, expiry, windows; and general relational extensions on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joins import as_of
from ..streaming import pacing
from .base import query


@query("token_bucket", (
    ", r AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY arrival, call_id) - 1 AS n FROM calls), g AS (SELECT call_id, endpoint, arrival, "
    "max(arrival - n * 1.1) OVER (PARTITION BY endpoint ORDER BY arrival, call_id) + n * 1.1 AS granted FROM r) SELECT call_id, endpoint, "
    "round(granted, 6) AS granted, round(granted - arrival, 6) AS waited FROM g"
), "calls")
def token_bucket(t):
    return pacing.paced(t("calls"), 1.1).select("call_id", "endpoint", "granted", "waited")


@query("call_budget", " SELECT call_id, row_number() OVER (PARTITION BY endpoint ORDER BY arrival, call_id) <= 40 AS allowed FROM calls", "calls")
def call_budget(t):
    return pacing.budgeted(t("calls"), 40, ["endpoint"], "arrival", "call_id").select("call_id", "allowed")


@query("retry_backoff", " SELECT call_id, CAST(CASE call_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 7 END AS DOUBLE) AS wait FROM calls", "calls")
def retry_backoff(t):
    return t("calls").select("call_id", pacing.backoff((F.col("call_id") % 4).cast("int"), F.when(F.col("call_id") % 4 == 1, 7)).alias("wait"))


@query("single_flight", (
    ", w AS (SELECT call_id, arrival, max(arrival + 2) OVER (PARTITION BY user_id ORDER BY arrival, "
    "call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM calls) SELECT call_id, coalesce(e > arrival, false) AS joined FROM w"
), "calls")
def single_flight(t):
    calls = t("calls").select("call_id", F.col("user_id").alias("key"), F.col("arrival").alias("started"), (F.col("arrival") + 2).alias("ended"))
    return pacing.single_flight(calls).select("call_id", "joined")


@query("ttl_expiry", " SELECT o_orderkey, floor((epoch(TIMESTAMP '1998-08-02 12:00:00') - epoch(o_orderdate)) / 86400) <= 90 AS alive FROM orders")
def ttl_expiry(t):
    return t("orders").select("o_orderkey", pacing.alive(F.col("o_orderdate").cast("string"), F.lit("1998-08-02 12:00:00")).alias("alive"))


@query("embedding_keys", " SELECT doc_id, sha256(text) AS cache_key FROM documents")
def embedding_keys(t):
    return t("documents").select("doc_id", pacing.cache_key(F.col("text")).alias("cache_key"))


@query("tumbling_windows", " SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_windows(t):
    return pacing.windowed(t("events"), "ts", "1 hour", None, "event_type")


@query("sliding_windows", (
    " SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS start, count(*) AS n, round(sum(value), 6) AS total "
    "FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL"
))
def sliding_windows(t):
    return pacing.windowed(t("events"), "ts", "1 hour", "30 minutes")


@query("session_windows", (
    ", o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS b "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id "
    "ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", user_id, count(*) AS n FROM s "
    "GROUP BY user_id, k"
).replace(", o AS", " WITH o AS", 1))
def session_windows(t):
    return pacing.sessions(t("events"), "ts", "30 minutes", "user_id")


@query("json_properties", " SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_properties(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("revenue_rollup", " SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def revenue_rollup(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("as_of_events", (
    " SELECT a.event_id, b.event_id AS before_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, "
    "max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts"
))
def as_of_events(t):
    e = t("events")
    views = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("before_id"))
    return as_of(e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id"), views, ["user_id"], "ts", ["before_id"]).select("event_id", "before_id")
