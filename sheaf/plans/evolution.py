"""Drafts evolved step by step within their limits, and the final selection by a fresh evaluation.

A step works on the trajectories that are still active, all of them in one plan; what has stopped is
set aside and not read again, and when none is left the loop ends. A trajectory stops

- before a step that begins after `max_seconds` (`time`),
- before a step whose judging would take its calls past `max_calls`, or after one that did (`calls`),
- at a step whose score reaches the plateau (`plateau`); that step's resolution is not taken.

A step's calls are one for each judged dimension, one for its gaps, and one to resolve them, if that
is done: if retrieval found a source, or, with `resolve_unfound`, if there is a gap. The state of
each step is settled in the shared folder, so plans stay short and lost executors lose nothing.

The last drafts are judged once more. A trajectory whose calls leave no room for that has an empty
evaluation: its score is 0 and it is not valid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fitness, graph, retrieval
from ..session import settled

KEYS = ["run_id", "trajectory"]


@dataclass(frozen=True)
class Limits:
    steps: int = 2
    plateau: float | None = None
    max_calls: int = 1000
    max_seconds: float | None = None
    resolve_unfound: bool = False


def scores_of(completions: DataFrame) -> DataFrame:
    """(run_id, trajectory, dim, score) of the judges' replies among completions (run_id, trajectory, stage, task, reply)."""
    return completions.filter("stage = 'judge'").select(*KEYS, F.col("task").alias("dim"), fitness.parsed_score(F.col("reply")).alias("score"))


def evolved(drafts: DataFrame, completions: DataFrame, weights: DataFrame, retrieved: DataFrame, limits: Limits, clock: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(run_id, trajectory, draft, calls, stopped_by) after the steps, and a record of each step that was judged.

    drafts (run_id, trajectory, draft; calls so far, 0 where the column is missing); completions
    (run_id, trajectory, step, stage `judge`, `gaps` or `resolve`, task, reply); retrieved (query,
    source_id, ord); clock (run_id, trajectory, step, elapsed) has the seconds at which steps begin.
    """
    n_dims = weights.count()  # a row for each dimension
    calls = F.col("calls").cast("long") if "calls" in drafts.columns else F.lit(0).cast("long").alias("calls")
    active = drafts.select(*KEYS, "draft", calls, F.lit(None).cast("string").alias("stopped_by"))
    done, records = [], []
    for step in range(limits.steps):
        if limits.max_seconds is not None and clock is not None:
            begins = clock.filter(F.col("step") == step).groupBy(*KEYS).agg(F.max("elapsed").alias("elapsed"))
            late = F.coalesce(F.col("elapsed") > limits.max_seconds, F.lit(False))
            active = active.join(begins, KEYS, "left").withColumn("stopped_by", F.when(late, "time")).drop("elapsed")
        stops = F.coalesce("stopped_by", F.when(F.col("calls") + n_dims > limits.max_calls, "calls"))
        checked = settled(active.withColumn("stopped_by", stops))
        done.append(checked.filter("stopped_by IS NOT NULL"))
        active = checked.filter("stopped_by IS NULL")
        if not active.limit(1).count():
            active = active.limit(0)
            break
        now = completions.filter(F.col("step") == step).join(active.select(*KEYS), KEYS, "left_semi")
        scores = fitness.weighted(scores_of(now), weights, KEYS)
        gaps = now.filter("stage = 'gaps'").select(*KEYS, F.posexplode(graph.gaps_of(F.col("reply"))).alias("gap", "g")).select(*KEYS, "gap", F.col("g.query").alias("query"))
        n_gaps = gaps.groupBy(*KEYS).agg(F.count("*").alias("n_gaps"))
        found = retrieval.first_seen(gaps.join(retrieved, "query"), [*KEYS, "source_id"], "gap", "ord").groupBy(*KEYS).agg(F.count("*").alias("n_sources"))
        resolved = now.filter("stage = 'resolve'").groupBy(*KEYS).agg(F.max("reply").alias("new"))
        state = active
        for part in (scores, n_gaps, found, resolved):
            state = state.join(part, KEYS, "left")
        state = state.fillna(0, ["n_gaps", "n_sources"]).withColumn("weighted", F.coalesce("weighted", F.lit(0.0)))
        resolves = (F.col("n_sources") > 0) | (F.lit(limits.resolve_unfound) & (F.col("n_gaps") > 0))
        state = state.withColumn("calls", F.col("calls") + n_dims + 1 + resolves.cast("long"))
        reached = F.lit(False) if limits.plateau is None else F.col("weighted") >= limits.plateau
        state = state.withColumn("stopped_by", F.when(reached, "plateau").when(F.col("calls") > limits.max_calls, "calls"))
        changed = resolves & F.col("new").isNotNull() & ~reached
        state = settled(state.withColumn("changed", changed).withColumn("draft", F.when(changed, F.col("new")).otherwise(F.col("draft"))))
        records.append(state.select(*KEYS, F.lit(step).alias("step"), "weighted", "n_gaps", "n_sources", "changed", "calls"))
        state = state.select(*active.columns)
        done.append(state.filter("stopped_by IS NOT NULL"))
        active = state.filter("stopped_by IS NULL")
    out = active
    for part in done:
        out = out.unionByName(part)
    empty = active.limit(0).select(*KEYS, F.lit(0).alias("step"), F.lit(0.0).alias("weighted"), F.lit(0).cast("long").alias("n_gaps"), F.lit(0).cast("long").alias("n_sources"), F.lit(False).alias("changed"), "calls")
    whole = records[0] if records else empty
    for part in records[1:]:
        whole = whole.unionByName(part)
    return out, whole


def selected(last: DataFrame, completions: DataFrame, weights: DataFrame, kind: str, limits: Limits, vetoes: DataFrame | None = None) -> DataFrame:
    """last (see `evolved`) with evaluated, valid, weighted and rank in its run, by a fresh evaluation: completions of the stage `judge`, whatever their step.

    Rank 1 is what is merged from, or taken. vetoes (run_id, trajectory, reason) are of the last drafts.
    """
    n_dims = weights.count()
    room = last.withColumn("evaluated", F.col("calls") + n_dims <= limits.max_calls)
    fresh = scores_of(completions).join(room.filter("evaluated").select(*KEYS), KEYS, "left_semi")
    judged = fitness.weighted(fresh, weights, KEYS).join(fitness.validity(fresh, KEYS, kind, vetoes), KEYS)
    rated = room.join(judged, KEYS, "left").withColumns({"valid": F.coalesce("valid", F.lit(False)), "weighted": F.coalesce("weighted", F.lit(0.0)), "ord": F.col("trajectory")})
    return fitness.best_first(rated, ["run_id"]).drop("ord")
