"""The evolution of drafts and their final selection against a plain simulation."""

from __future__ import annotations

import random

import pytest

from sheaf.plans import evolution
from sheaf.plans.evolution import Limits

DIMS = {"faithfulness": 0.5, "b": 0.25, "c": 0.25}
RETRIEVED = {f"q{i}": [f"s{i % 3}", f"s{i}"] for i in range(0, 8, 2)}


def made(seed, runs=4, trajectories=3, steps=3):
    """Replies of a random evolution; scores are None where a judge's reply can't be read."""
    r = random.Random(seed)
    return {(run, t, step): {"scores": {d: r.choice([1, 2, 3, 4, 5, None]) for d in DIMS}, "gaps": [f"q{r.randint(0, 7)}" for _ in range(r.randint(0, 3))], "new": r.choice([None, f"draft {run} {t} {step}"]), "elapsed": step * 100.0 + 40 * t} for run in range(runs) for t in range(trajectories) for step in [*range(steps), -1]}


def weighted(scores):
    there = sum(w for d, w in DIMS.items() if scores[d] is not None)
    return sum(DIMS[d] * s for d, s in scores.items() if s is not None) / there if there else 0.0


def simulated(replies, limits, before):
    out = {}
    for run, t in sorted({k[:2] for k in replies}):
        draft, calls, why, steps = "first", before, None, []
        for step in range(limits.steps):
            x = replies[run, t, step]
            if limits.max_seconds is not None and x["elapsed"] > limits.max_seconds:
                why = "time"
                break
            if calls + len(DIMS) > limits.max_calls:
                why = "calls"
                break
            found = {s for q in x["gaps"] for s in RETRIEVED.get(q, [])}
            resolves = bool(found) or (limits.resolve_unfound and bool(x["gaps"]))
            calls += len(DIMS) + 1 + resolves
            reached = limits.plateau is not None and weighted(x["scores"]) >= limits.plateau
            changed = resolves and x["new"] is not None and not reached
            steps.append((step, round(weighted(x["scores"]), 9), len(x["gaps"]), len(found), changed, calls))
            if reached:
                why = "plateau"
                break
            draft = x["new"] if changed else draft
            if calls > limits.max_calls:
                why = "calls"
                break
        out[run, t] = draft, calls, why, steps
    ranks = {}
    for run in {k[0] for k in out}:
        rated = []
        for (r, t), (_, calls, _, _) in out.items():
            if r == run:
                fresh = replies[run, t, -1]["scores"]
                room = calls + len(DIMS) <= limits.max_calls
                valid = room and (fresh["faithfulness"] or 0) >= 4
                rated.append((not valid, -round(weighted(fresh), 9) if room else 0.0, t, room))
        ranks |= {(run, t): (i + 1, room, not bad, -w) for i, (bad, w, t, room) in enumerate(sorted(rated))}
    return out, ranks


def tables(spark, replies, before):
    rows, last, clock = [], [], []
    for (run, t, step), x in replies.items():
        to = last if step < 0 else rows
        for d, s in x["scores"].items():
            to.append((run, t, max(step, 0), "judge", d, "no verdict" if s is None else f"<score>{s}</score>"))
        if step >= 0:
            rows.append((run, t, step, "gaps", "", "".join(f"<gap><description>{q}</description></gap>" for q in x["gaps"])))
            clock.append((run, t, step, x["elapsed"]))
            if x["new"] is not None:
                rows.append((run, t, step, "resolve", "", x["new"]))
    schema = "run_id int, trajectory int, step int, stage string, task string, reply string"
    drafts = sorted({k[:2] for k in replies})
    return (
        spark.createDataFrame([(*k, "first", before) for k in drafts], "run_id int, trajectory int, draft string, calls int"), spark.createDataFrame(rows, schema), spark.createDataFrame(last, schema),
        spark.createDataFrame([*DIMS.items()], "dim string, weight double"), spark.createDataFrame([(q, s, i) for q, v in RETRIEVED.items() for i, s in enumerate(v)], "query string, source_id string, ord int"),
        spark.createDataFrame(clock, "run_id int, trajectory int, step int, elapsed double"),
    )


@pytest.mark.parametrize(("limits", "before"), [
    (Limits(2, 3.0), 0), (Limits(3, 3.0, 12, None, True), 1), (Limits(3, None, 9, 130.0), 0), (Limits(2, None, 2), 0),
])
def test_evolution(spark, limits, before):
    replies = made(limits.max_calls)
    drafts, completions, final, weights, retrieved, clock = tables(spark, replies, before)
    last, records = evolution.evolved(drafts, completions, weights, retrieved, limits, clock)
    want, ranks = simulated(replies, limits, before)
    assert {(r["run_id"], r["trajectory"]): (r["draft"], r["calls"], r["stopped_by"]) for r in last.collect()} == {k: v[:3] for k, v in want.items()}
    got = sorted((r["run_id"], r["trajectory"], r["step"], round(r["weighted"], 9), r["n_gaps"], r["n_sources"], r["changed"], r["calls"]) for r in records.collect())
    assert got == sorted((*k, *s) for k, v in want.items() for s in v[3])
    chosen = evolution.selected(last, final, weights, "synthesis", limits)
    assert {(r["run_id"], r["trajectory"]): (r["rank"], r["evaluated"], r["valid"], round(r["weighted"], 9)) for r in chosen.collect()} == ranks


def test_vetoes_and_empty_tables(spark):
    replies = made(5, runs=1)
    drafts, completions, final, weights, retrieved, _ = tables(spark, replies, 0)
    vetoes = spark.createDataFrame([(0, t, "no") for t in range(3)], "run_id int, trajectory int, reason string")
    last, _ = evolution.evolved(drafts, completions, weights, retrieved, Limits(1))
    assert not any(r["valid"] for r in evolution.selected(last, final, weights, "synthesis", Limits(1), vetoes).collect())
    none, records = evolution.evolved(drafts.limit(0), completions, weights, retrieved, Limits(2))
    assert none.collect() == [] and records.collect() == []
    kept, _ = evolution.evolved(drafts.drop("calls"), completions.limit(0), weights, retrieved, Limits(2))
    assert {(r["draft"], r["calls"]) for r in kept.collect()} == {("first", 8)}
