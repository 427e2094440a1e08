"""Judged candidates: parsing, weighted scores, gates, ranking, feedback, run guards."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, strip, tag_body
from .scans import placed, running

#: The dimension that must reach GATE_SCORE, by kind of candidate.
GATES = {"graph": "groundedness", "synthesis": "faithfulness", "review": "faithfulness", "plan": "corpus_fit"}
GATE_SCORE, FEEDBACK_THRESHOLD = 4, 3
#: The calls that a tournament may take in a run.
MOST_CALLS = 32


def clamped(digits: Column) -> Column:
    """Digits as a score between 1 and 5; null stays null."""
    n = digits.try_cast("bigint")
    return F.when(n.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), n))).cast("int")


def lone_digit(text: Column) -> Column:
    """The first digit 1-5 that stands alone."""
    return F.nullif(F.regexp_extract(text, r"(?U)(?<!\w)([1-5])(?!\w)", 1), F.lit("")).cast("int")


def parsed_score(reply: Column) -> Column:
    """A judge's score 1-5, or null.

    The first score tag's whole number, clamped, or lone digit; else the first score tag with
    digits only; else a lone digit in the first 200 characters.
    """
    text = strip(reply)
    inner = strip(tag_body(text, "score"))
    whole = F.when(inner.rlike(r"^[+-]?\d+$"), clamped(inner))
    tagged = clamped(F.nullif(F.regexp_extract(text, r"<score>\s*(\d+)\s*</score>", 1), F.lit("")))
    return F.when(~blank(reply), F.coalesce(whole, lone_digit(inner), tagged, lone_digit(F.substring(text, 1, 200))))


def weighted(scores: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean of the scores (keys, dim, score) that are there; dimensions without a weight count 0; 0 if none is there.

    A candidate's few dimensions are added in their order, so the mean is the same however rows are spread.
    The weights, a row for each dimension, go to the scores.
    """
    joined = scores.join(F.broadcast(weights), "dim", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    terms = F.sort_array(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("dim", F.col("score").cast("double").alias("score"), F.col("weight").cast("double").alias("weight")))))
    added = lambda f: F.aggregate("_terms", F.lit(0.0), lambda total, x: total + f(x))
    mean = added(lambda x: x["score"] * x["weight"]) / F.nullif(added(lambda x: x["weight"]), F.lit(0.0))
    return joined.groupBy(*keys).agg(terms.alias("_terms")).select(*keys, F.coalesce(mean, F.lit(0.0)).alias("weighted"))


def weights_sum(weights: DataFrame) -> DataFrame:
    """Whether weights sum to 1 within a thousandth."""
    return weights.agg(F.sum("weight").alias("total"), (F.abs(F.sum("weight") - 1) <= 0.001).alias("ok"))


def validity(scores: DataFrame, keys: list[str], profile: str, vetoes: DataFrame | None = None) -> DataFrame:
    """Whether each candidate's gate dimension scores GATE_SCORE or more, and no veto (keys, reason) stands against it."""
    out = scores.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("dim") == GATES[profile], F.col("score"))) >= GATE_SCORE, F.lit(False)).alias("valid"))
    if vetoes is not None:
        out = out.join(vetoes, keys, "left").withColumn("valid", F.col("valid") & F.col("reason").isNull()).drop("reason")
    return out


def best_first(candidates: DataFrame, group: list[str]) -> DataFrame:
    """Rank by validity, then weighted score (nine places), then the order they came in (ord)."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("valid"), F.desc(F.round("weighted", 9)), "ord")))


def plan_tournament(candidates: DataFrame, scores: DataFrame, weights: DataFrame, vetoes: DataFrame, most_redrafts: int = 2, most_calls: int = MOST_CALLS) -> DataFrame:
    """The plan that each run develops under: (run_id, candidate, valid, weighted, n_calls).

    candidates (run_id, candidate, redraft: 0 for drafts, 1, 2, ... for redrafts as they would
    come) are vetoed (run_id, candidate, reason), and then not judged at all, or judged by scores
    (run_id, candidate, dim, score). The best draft wins. As long as the winner is not valid the
    next redraft, if there is one, is tried and replaces it if it is better. Calls are one for
    each draft and redraft tried, and one for each dimension (weights) that one is judged by; a
    redraft whose calls would take the run past most_calls is not tried, and none after it.
    """
    keys = ["run_id", "candidate"]
    judged = scores.join(vetoes.select(*keys), keys, "left_anti")
    both = weighted(judged, weights, keys).join(validity(judged, keys, "plan"), keys)
    n_dims = weights.agg(F.count("*").alias("n_dims"))
    rated = candidates.join(both, keys, "left").join(vetoes.select(*keys, F.lit(True).alias("vetoed")).distinct(), keys, "left").join(F.broadcast(n_dims))  # one row
    rated = rated.select(*keys, "redraft", F.struct(F.coalesce("valid", F.lit(False)).alias("valid"), F.round(F.coalesce("weighted", F.lit(0.0)), 9).alias("weighted"), F.col("candidate")).alias("plan"), F.when(F.col("vetoed"), 1).otherwise(F.col("n_dims") + 1).alias("calls"))
    drafts = rated.filter("redraft = 0").groupBy("run_id").agg(F.min_by("plan", F.struct(~F.col("plan.valid"), -F.col("plan.weighted"), "candidate")).alias("winner"), F.sum("calls").alias("n_calls"))
    tried = rated.filter((F.col("redraft") > 0) & (F.col("redraft") <= most_redrafts)).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("redraft", "plan", "calls"))).alias("redrafts"))
    start = F.struct("winner", F.col("n_calls").cast("bigint").alias("n_calls"), F.lit(False).alias("over"))

    def step(now: Column, r: Column) -> Column:
        better = (r["plan"]["valid"] & ~now["winner"]["valid"]) | ((r["plan"]["valid"] == now["winner"]["valid"]) & (r["plan"]["weighted"] > now["winner"]["weighted"]))
        over = now["n_calls"] + r["calls"] > most_calls
        ended = F.struct(now["winner"].alias("winner"), now["n_calls"].alias("n_calls"), F.lit(True).alias("over"))
        return F.when(now["winner"]["valid"] | now["over"], now).when(over, ended).otherwise(F.struct(F.when(better, r["plan"]).otherwise(now["winner"]).alias("winner"), (now["n_calls"] + r["calls"]).cast("bigint").alias("n_calls"), F.lit(False).alias("over")))

    end = drafts.join(tried, "run_id", "left").withColumn("end", F.when(F.col("redrafts").isNull(), start).otherwise(F.aggregate("redrafts", start, step)))
    return end.select("run_id", "end.winner.candidate", "end.winner.valid", "end.winner.weighted", "end.n_calls")


def valid_source(source: Column, member: Column) -> Column:
    """An id of a paper, by its prefix in any case, or a member of the panel."""
    s = strip(source)
    return (s != "") & (s.rlike("(?i)^(arxiv:|s2:)") | member)


def with_membership(rows: DataFrame, panel: DataFrame, column: str) -> DataFrame:
    """rows with `member`: whether the trimmed id is on the panel (source_id)."""
    ids = panel.select(F.col("source_id").alias("_id"), F.lit(True).alias("member")).distinct()
    return rows.withColumn("_trim", strip(F.col(column))).join(ids, F.col("_trim") == F.col("_id"), "left").withColumn("member", F.coalesce("member", F.lit(False))).drop("_trim", "_id")


#: What candidates without any content are told: fixed values.
NO_CLAIMS = "Traceability veto: synthesis has zero claims — every claim must cite at least one source paper ID."
NO_NODES = "Traceability veto: argumentation graph has zero nodes — every node must have a non-empty expert_id."


def with_empty(vetoes: DataFrame, candidates: DataFrame | None, content: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """vetoes, and one for each candidate (keys) that has no content."""
    if candidates is None:
        return vetoes
    empty = candidates.select(*keys).distinct().join(content.select(*keys).distinct(), keys, "left_anti")
    return vetoes.unionByName(empty.withColumn("reason", F.lit(reason)))


def synthesis_vetoes(claims: DataFrame, sources: DataFrame, panel: DataFrame, keys: list[str], candidates: DataFrame | None = None) -> DataFrame:
    """keys and reason of syntheses whose first faulty claim (claim_ord, text) has no source, or only invalid ones; and of candidates (keys) without any claim."""
    checked = with_membership(sources, panel, "source_id")
    checked = checked.groupBy(*keys, "claim_ord").agg(F.max(valid_source(F.col("source_id"), F.col("member"))).alias("some_valid"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_ord", "source_id"))), lambda s: s["source_id"]), ", ").alias("labels"))
    short = F.substring("text", 1, 80)
    message = (
        F.when(F.col("some_valid").isNull(), F.concat(F.lit('Traceability veto: claim has no sources — "'), short, F.lit('"… Every claim must cite at least one source paper ID.')))
        .when(~F.col("some_valid"), F.concat(F.lit("Traceability veto: claim sources are all invalid ids ("), "labels", F.lit(') — sources must be arxiv:… or s2:… paper ids of the provided papers (claim: "'), short, F.lit('"…).')))
    )
    judged = claims.join(checked, [*keys, "claim_ord"], "left").withColumn("reason", message)
    return judged.groupBy(*keys).agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("claim_ord"))).alias("reason")).filter("reason is not null").transform(with_empty, candidates, claims, keys, NO_CLAIMS)


def graph_vetoes(nodes: DataFrame, panel: DataFrame, keys: list[str], candidates: DataFrame | None = None) -> DataFrame:
    """keys and reason of graphs whose first faulty node (node_ord, expert_id, claim) has a blank or invalid expert; and of candidates (keys) without any node."""
    short = F.substring("claim", 1, 80)
    checked = with_membership(nodes, panel, "expert_id")
    message = (
        F.when(blank(F.col("expert_id")), F.concat(F.lit('Traceability veto: node has empty expert_id — "'), short, F.lit('"… Every node must have a non-empty expert_id (the source paper ID).')))
        .when(~valid_source(F.col("expert_id"), F.col("member")), F.concat(F.lit("Traceability veto: node expert_id is invalid ("), "expert_id", F.lit(') — expert_id must be an arxiv:… or s2:… paper id or a known panel id (claim: "'), short, F.lit('"…).')))
    )
    judged = checked.withColumn("reason", message)
    return judged.groupBy(*keys).agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("node_ord"))).alias("reason")).filter("reason is not null").transform(with_empty, candidates, nodes, keys, NO_NODES)


def feedback(scores: DataFrame, keys: list[str], threshold: int = FEEDBACK_THRESHOLD, vetoes: DataFrame | None = None) -> DataFrame:
    """A note for each candidate: dimensions (dim_ord, dim, score) to improve, and those to keep."""
    line = F.concat(F.lit("- **"), "dim", F.lit("**: "), F.when(F.col("score").isNull(), "score unavailable (parse failure)").otherwise(F.concat(F.lit("score="), F.col("score").cast("string"))))
    low = F.col("score").isNull() | (F.col("score") <= threshold)

    def listed(which: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("dim_ord", "line")))), lambda x: x["line"]), "\n")

    out = scores.withColumn("line", line).groupBy(*keys).agg(listed(low).alias("priority"), listed(~low).alias("strengths"))
    out = out.join(vetoes, keys, "left") if vetoes is not None else out.withColumn("reason", F.lit(None).cast("string"))
    strong = F.col("priority") == ""
    head = F.when(F.col("reason").isNull(), "").otherwise(F.concat(F.lit("## HARD FAIL — Traceability veto\n"), "reason", F.lit("\nEvery claim MUST cite at least one source paper ID. Fix this before anything else.\n\n")))
    text = F.concat(
        head, F.lit(f"## Priority Improvements (Score ≤ {threshold})\n"),
        F.when(strong, "No dimensions below threshold — candidate is strong.\n").otherwise(F.concat("priority", F.lit("\n"))),
        F.lit("\n## Strengths to Preserve\n"), F.when(F.col("strengths") == "", "No dimensions above threshold.\n").otherwise(F.concat("strengths", F.lit("\n"))),
        F.lit("\n## Evolutionary Guidance\n"),
        F.when(strong, "The candidate meets the threshold on all scored dimensions. Focus on preserving identified strengths in the revised draft.\n")
        .otherwise("Focus on resolving the priority improvements listed above. Preserve the strengths while addressing the low-scoring dimensions.\n"),
    )
    return out.select(*keys, text.alias("feedback"))


def guarded(calls: DataFrame, group: list[str], most_calls: int, most_seconds: float) -> DataFrame:
    """calls (ord, seconds, judges) with whether the run's guards still let each one go ahead; a run may have any number of calls."""
    rows = running(placed(calls, group, ["ord"]), group, "_used", "sum", F.lit(1), before=True)
    rows = running(rows, group, "_spent", "sum", F.coalesce(F.col("seconds").cast("double"), F.lit(0.0)), before=True)
    stop = F.when(F.col("_spent") > most_seconds, "time").when(F.col("_used") + F.coalesce("judges", F.lit(0)) >= most_calls, "calls")
    return rows.withColumn("stopped_by", stop).drop("_used", "_spent", "_at", "_part")


def sampling(n: int, diverse: bool, seed: int = 42, temperatures: tuple[float, float] = (0.5, 1.0), shares: tuple[float, float] = (0.85, 0.95)) -> list[tuple[int, float, float, int, int | None]]:
    """(trajectory, temperature, top_p, top_k, seed): all alike, or drawn from the ranges, each trajectory with a seed of its own."""
    if not diverse:
        return [(i, 1.0, 1.0, 0, None) for i in range(n)]
    draws = [random.Random(seed + i) for i in range(n)]
    return [(i, r.uniform(*temperatures), r.uniform(*shares), 40, seed + i) for i, r in enumerate(draws)]


def telemetry(scores: DataFrame) -> DataFrame:
    """Long rows of scores, with -1 for those that are not there."""
    return scores.withColumn("score", F.coalesce("score", F.lit(-1)))
