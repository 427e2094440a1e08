"""Queries over judged candidates, claims, sources, quotes and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens
from ..operators import fitness, graph, provenance
from .base import all_quotes, dealt, query
from .retrieval_queries import COSINE

REPLY = (
    "CASE doc_id % 8 WHEN 0 THEN concat('<fitness_evaluation><score> ', doc_id % 9, ' </score><rationale>ok</rationale></fitness_evaluation>') WHEN 1 THEN "
    "concat('score is ', 1 + doc_id % 5, ' of many') WHEN 2 THEN '  ' WHEN 3 THEN 'no digits at all, 77' WHEN 4 THEN "
    "concat('<score>about ', 1 + doc_id % 5, '</score>') WHEN 5 THEN concat('<score>', doc_id, '</score> trailing <b>') WHEN 6 THEN "
    "concat(repeat('x ', 110), ' 3') ELSE concat('a4b ', 1 + doc_id % 5) END"
)
SCORED = "CASE doc_id % 8 WHEN 0 THEN greatest(1, least(5, doc_id % 9)) WHEN 1 THEN 1 + doc_id % 5 WHEN 4 THEN 1 + doc_id % 5 WHEN 5 THEN greatest(1, least(5, doc_id)) WHEN 7 THEN 1 + doc_id % 5 END"


@query("parse_fitness", f" SELECT doc_id, {SCORED} AS score FROM documents")
def parse_fitness(t):
    return t("documents").select("doc_id", fitness.parsed_score(F.expr(REPLY)).alias("score"))


WEIGHTED = (
    ", w AS (SELECT run_id, candidate, coalesce(sum(score * coalesce(weight, 0)) / nullif(sum(CASE WHEN score IS NOT NULL THEN "
    "coalesce(weight, 0) END), 0), 0) AS weighted FROM scores LEFT JOIN weights USING (dim) GROUP BY ALL)"
)


@query("weighted_sum", WEIGHTED + " SELECT run_id, candidate, round(weighted, 6) AS weighted FROM w", "scores", "weights")
def weighted_sum(t):
    return fitness.weighted(t("scores"), t("weights"), ["run_id", "candidate"])


@query("weights_sum", " SELECT round(sum(weight), 6) AS total, abs(sum(weight) - 1) <= 0.001 AS ok FROM weights", "weights")
def weights_sum(t):
    return fitness.weights_sum(t("weights"))


@query("validity_rank", WEIGHTED + (
    ", v AS (SELECT run_id, candidate, coalesce(max(CASE WHEN dim = 'dim1' THEN score END) >= 4, false) AS valid FROM scores GROUP BY ALL) SELECT run_id, "
    "candidate, valid, row_number() OVER (PARTITION BY run_id ORDER BY valid DESC, round(weighted, 9) DESC, candidate) AS rank "
    "FROM w JOIN v USING (run_id, candidate)"
), "scores", "weights")
def validity_rank(t):
    keys = ["run_id", "candidate"]
    s = t("scores").withColumn("dim", F.when(F.col("dim") == "dim1", "groundedness").otherwise(F.col("dim")))
    w = t("weights").withColumn("dim", F.when(F.col("dim") == "dim1", "groundedness").otherwise(F.col("dim")))
    c = fitness.weighted(s, w, keys).join(fitness.validity(s, keys, "graph"), keys).withColumn("weighted", F.round("weighted", 9)).withColumn("ord", F.col("candidate"))
    return fitness.best_first(c, ["run_id"]).select("run_id", "candidate", "valid", "rank")


VALID = "(trim(source_id) <> '' AND (regexp_matches(lower(trim(source_id)), '^(arxiv:|s2:)') OR trim(source_id) IN (SELECT source_id FROM panel)))"


TRACED = f""", s AS (SELECT claim_id, max(CAST({VALID} AS INT)) AS ok, string_agg(source_id, ', ' ORDER BY source_ord) AS labels FROM claim_sources WHERE claim_id % 4 <> 0 GROUP BY claim_id),
j AS (SELECT run_id, claims.claim_id, CASE WHEN ok IS NULL THEN 'no sources' WHEN ok = 0 THEN labels END AS why FROM claims LEFT JOIN s USING (claim_id))
SELECT run_id, arg_min(why, claim_id) AS why FROM j WHERE why IS NOT NULL GROUP BY run_id
UNION ALL SELECT c_custkey, 'zero claims' FROM customer WHERE c_custkey NOT IN (SELECT run_id FROM claims)"""


# every fourth claim of the fixture has no sources, and some customers have no claims
@query("traceability_veto", TRACED, "claims", "claim_sources", "panel")
def traceability_veto(t):
    claims = t("claims").withColumn("claim_ord", F.col("claim_id"))
    sources = t("claim_sources").filter("claim_id % 4 <> 0").join(claims.select("claim_id", "run_id", "claim_ord"), "claim_id")
    candidates = t("customer").select(F.col("c_custkey").alias("run_id"))
    vetoes = fitness.synthesis_vetoes(claims, sources, t("panel"), ["run_id"], candidates)
    labels = F.regexp_extract("reason", r"invalid ids \((.*)\) — sources", 1)
    why = F.when(F.contains("reason", F.lit("has no sources")), "no sources").when(F.contains("reason", F.lit("zero claims")), "zero claims").otherwise(labels)
    return vetoes.select("run_id", why.alias("why"))


GRAPHED = """, j AS (SELECT graph_ord, node_ord, CASE WHEN node_ord % 3 = 0 THEN '' ELSE expert_id END AS e FROM nodes),
k AS (SELECT graph_ord, node_ord * 1000 AS o, CASE WHEN e = '' THEN 'empty' WHEN e NOT IN (SELECT source_id FROM panel) THEN e END AS why FROM j)
SELECT graph_ord, min(o) // 1000 AS node_ord FROM k WHERE why IS NOT NULL GROUP BY graph_ord
UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey NOT IN (SELECT graph_ord FROM nodes)"""


@query("graph_veto", GRAPHED, "nodes", "panel")
def graph_veto(t):
    nodes = t("nodes").withColumn("expert_id", F.expr("CASE WHEN node_ord % 3 = 0 THEN '' ELSE expert_id END")).withColumn("claim", F.col("node_ord").cast("string"))
    candidates = nodes.select("graph_ord").unionByName(t("nation").select(F.col("n_nationkey").alias("graph_ord")))
    vetoes = fitness.graph_vetoes(nodes, t("panel"), ["graph_ord"], candidates)
    return vetoes.select("graph_ord", F.regexp_extract("reason", r'(?:"|claim: ")(\d+)"', 1).try_cast("bigint").alias("node_ord"))


@query("feedback_doc", (
    ", f AS (SELECT run_id, candidate, string_agg(CASE WHEN score IS NULL OR score <= 3 THEN concat('- **', dim, '**: ', CASE "
    "WHEN score IS NULL THEN 'score unavailable (parse failure)' ELSE concat('score=', score) END) END, chr(10) ORDER BY dim_ord, dim, "
    "score NULLS FIRST) AS p, string_agg(CASE WHEN score > 3 THEN concat('- **', dim, '**: score=', score) END, chr(10) ORDER BY dim_ord) AS s FROM scores "
    "GROUP BY ALL) SELECT run_id, candidate, concat('## Priority Improvements (Score ≤ 3)', chr(10), "
    "coalesce(p || chr(10), 'No dimensions below threshold — candidate is strong.' || chr(10)), chr(10), '## Strengths to Preserve', chr(10), "
    "coalesce(s || chr(10), 'No dimensions above threshold.' || chr(10)), chr(10), '## Evolutionary Guidance', chr(10), CASE "
    "WHEN p IS NULL THEN 'The candidate meets the threshold on all scored dimensions. Focus on preserving identified strengths in the revised draft.' ELSE 'Focus on resolving the priority improvements listed above. Preserve the strengths while addressing the low-scoring dimensions.' END, "
    "chr(10)) AS feedback FROM f"
), "scores")
def feedback_doc(t):
    return fitness.feedback(t("scores"), ["run_id", "candidate"])


@query("score_telemetry", " SELECT run_id, candidate, dim, coalesce(score, -1) AS score FROM scores", "scores")
def score_telemetry(t):
    return fitness.telemetry(t("scores")).select("run_id", "candidate", "dim", "score")


@query("trajectory_guards", (
    ", w AS (SELECT *, coalesce(sum(waits) OVER x, 0) AS spent, count(*) OVER x AS used FROM (SELECT endpoint, "
    "call_id, CAST(call_id % 7 AS DOUBLE) AS waits, call_id % 3 AS judges FROM calls) WINDOW x AS (PARTITION BY endpoint "
    "ORDER BY call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT endpoint, call_id, CASE WHEN spent > 600 THEN 'time' "
    "WHEN used + judges >= 150 THEN 'calls' END AS stopped_by FROM w"
), "calls")
def trajectory_guards(t):
    calls = t("calls").select("endpoint", "call_id", F.col("call_id").alias("ord"), (F.col("call_id") % 7).cast("double").alias("seconds"), (F.col("call_id") % 3).alias("judges"))
    return fitness.guarded(calls, ["endpoint"], 150, 600).select("endpoint", "call_id", "stopped_by")


@query("candidate_selection", WEIGHTED + (
    ", r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(weighted, 9) DESC, candidate) AS rank FROM w) SELECT run_id, candidate FROM r "
    "WHERE rank = 1"
), "scores", "weights")
def candidate_selection(t):
    c = fitness.weighted(t("scores"), t("weights"), ["run_id", "candidate"]).withColumns({"valid": F.lit(True), "ord": F.col("candidate"), "weighted": F.round("weighted", 9)})
    return fitness.best_first(c, ["run_id"]).filter("rank = 1").select("run_id", "candidate")


TOURNAMENT = """, c AS (SELECT run_id, candidate, candidate % 5 = 0 AS veto, candidate % 4 = 0 AS again,
  CASE WHEN candidate % 5 = 0 THEN 0 ELSE round(coalesce(sum(score * coalesce(weight, 0)) / nullif(sum(CASE WHEN score IS NOT NULL THEN coalesce(weight, 0) END), 0), 0), 9) END AS w,
  candidate % 5 <> 0 AND coalesce(max(CASE WHEN dim = 'dim1' THEN score END) >= 4, false) AS valid FROM scores LEFT JOIN weights USING (dim) GROUP BY run_id, candidate),
k AS (SELECT *, CASE WHEN veto THEN 1 ELSE 1 + (SELECT count(*) FROM weights) END AS calls, row_number() OVER (PARTITION BY run_id, again ORDER BY candidate) AS n, row_number() OVER (PARTITION BY run_id, again ORDER BY valid DESC, w DESC, candidate) AS place FROM c),
s0 AS (SELECT run_id, sum(calls) AS spent FROM k WHERE NOT again GROUP BY run_id),
w0 AS (SELECT k.run_id, candidate, valid, w, spent AS calls FROM k JOIN s0 ON s0.run_id = k.run_id WHERE NOT again AND place = 1),
w1 AS (SELECT a.run_id, (NOT a.valid AND r.run_id IS NOT NULL) AS tried, (tried AND (r.valid OR r.w > a.w)) AS better, CASE WHEN better THEN r.candidate ELSE a.candidate END AS candidate, CASE WHEN better THEN r.valid ELSE a.valid END AS valid,
  CASE WHEN better THEN r.w ELSE a.w END AS w, a.calls + CASE WHEN tried THEN r.calls ELSE 0 END AS calls FROM w0 a LEFT JOIN (SELECT * FROM k WHERE again AND n = 1) r ON r.run_id = a.run_id),
w2 AS (SELECT a.run_id, (NOT a.valid AND r.run_id IS NOT NULL) AS tried2, (tried2 AND (r.valid OR r.w > a.w)) AS better2, CASE WHEN better2 THEN r.candidate ELSE a.candidate END AS candidate, CASE WHEN better2 THEN r.valid ELSE a.valid END AS valid,
  CASE WHEN better2 THEN r.w ELSE a.w END AS w, a.calls + CASE WHEN tried2 THEN r.calls ELSE 0 END AS calls FROM w1 a LEFT JOIN (SELECT * FROM k WHERE again AND n = 2) r ON r.run_id = a.run_id)
SELECT run_id, candidate, valid, round(w, 6) AS weighted, CAST(calls AS BIGINT) AS n_calls FROM w2"""


@query("plan_tournament", TOURNAMENT, "scores", "weights")
def plan_tournament(t):
    scores, weights = (t(n).withColumn("dim", F.when(F.col("dim") == "dim1", "corpus_fit").otherwise(F.col("dim"))) for n in ("scores", "weights"))
    order = Window.partitionBy("run_id", F.col("candidate") % 4 == 0).orderBy("candidate")
    candidates = scores.select("run_id", "candidate").distinct().withColumn("redraft", F.when(F.col("candidate") % 4 == 0, F.row_number().over(order)).otherwise(0))
    vetoes = candidates.filter("candidate % 5 = 0").select("run_id", "candidate", F.lit("lint").alias("reason"))
    return fitness.plan_tournament(candidates, scores, weights, vetoes, most_calls=1 << 30)  # runs here have more drafts than a tournament


@query("synthesis_patch", " SELECT run_id, text, agreement_level FROM claims UNION ALL SELECT doc_id, substr(text, 1, 40), 'divided' FROM documents WHERE doc_id % 3 = 0", "claims")
def synthesis_patch(t):
    patch = t("documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("run_id"), F.substring("text", 1, 40).alias("text"))
    return graph.patched(t("claims").select("run_id", "text", "agreement_level"), patch)


NORMAL = """, x AS (SELECT claim_id, source_ord, source_id, regexp_replace(split_part(source_id, ':', 1), '^new_', '') AS bare FROM claim_sources),
m AS (SELECT claim_id, source_ord, x.source_id, (SELECT arg_max(p.source_id, length(p.source_id)) FROM panel p WHERE bare = p.source_id OR starts_with(bare, p.source_id || '_') OR starts_with(bare, p.source_id || ':')) AS a,
(SELECT arg_max(p.source_id, length(p.source_id)) FROM panel p WHERE x.source_id = p.source_id OR starts_with(x.source_id, p.source_id || '_') OR starts_with(x.source_id, p.source_id || ':')) AS b FROM x),
n AS (SELECT claim_id, min(source_ord) AS source_ord, coalesce(a, b, source_id) AS source_id FROM m GROUP BY claim_id, coalesce(a, b, source_id))"""


@query("normalise_ids", NORMAL + " SELECT * FROM n", "claim_sources", "panel")
def normalise_ids(t):
    return provenance.normalised_sources(t("claim_sources"), t("panel")).select("claim_id", "source_ord", "source_id")


@query("strip_invalid", f" SELECT claim_id, source_ord, source_id FROM claim_sources WHERE {VALID}", "claim_sources", "panel")
def strip_invalid(t):
    return provenance.without_invalid(t("claim_sources"), t("panel")).select("claim_id", "source_ord", "source_id")


LEVEL = (
    ", n AS (SELECT claim_id, count(DISTINCT source_id) AS n FROM claim_sources WHERE source_id NOT IN ('system', 'system_resolution') GROUP BY claim_id), "
    "s AS (SELECT count(*) AS k FROM panel), l AS (SELECT claims.claim_id, n / (SELECT k FROM s) AS r, agreement_level AS old FROM claims "
    "LEFT JOIN n USING (claim_id)), lev AS (SELECT claim_id, CASE WHEN r >= 0.75 THEN 'consensus' WHEN r >= 0.5 THEN 'majority' "
    "WHEN r >= 0.15 THEN 'divided' WHEN r IS NOT NULL THEN 'minority' ELSE old END AS agreement_level FROM l)"
)


@query("agreement_level", LEVEL + " SELECT * FROM lev", "claims", "claim_sources", "panel")
def agreement_level(t):
    return provenance.agreement(t("claims"), t("claim_sources"), t("panel")).select("claim_id", "agreement_level")


COVERED = (
    ", m AS (SELECT source_id FROM panel_wide WHERE source_id NOT IN (SELECT source_id FROM cited)) SELECT round(((SELECT count(*) "
    "FROM panel_wide) - (SELECT count(*) FROM m)) / (SELECT count(*) FROM panel_wide), 6) AS coverage"
)


@query("expert_coverage", COVERED, "panel_wide", "cited")
def expert_coverage(t):
    return provenance.coverage(t("panel_wide"), t("cited"))[1]


@query("missing_experts", " SELECT source_id FROM panel_wide WHERE source_id NOT IN (SELECT source_id FROM cited)", "panel_wide", "cited")
def missing_experts(t):
    return provenance.coverage(t("panel_wide"), t("cited"))[0]


MINORITY = """, c AS (SELECT source_id, max(CAST(coalesce(agreement_level <> 'minority', true) AS INT)) AS o, count(DISTINCT claim_id) AS n_claims FROM cited JOIN claims USING (claim_id) GROUP BY source_id)
SELECT source_id, n_claims FROM c WHERE o = 0 AND source_id NOT IN ('m1', 'm2')"""


@query("minority_only", MINORITY, "claims", "cited")
def minority_only(t):
    reports = t("cited").filter("source_id in ('m1', 'm2')").select("source_id")
    claims, cited = dealt((t("claims"), "claim_id"), (t("cited"), "claim_id"))
    return provenance.minority_only(claims, cited, reports)


@query("label_vocabularies", (
    " SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'emerging' WHEN 1 THEN 'single-source' END AS support, CASE doc_id % 4 "
    "WHEN 2 THEN 'majority' ELSE 'divided' END AS agreement FROM documents"
))
def label_vocabularies(t):
    label = F.expr("CASE doc_id % 4 WHEN 0 THEN ' Emerging' WHEN 1 THEN 'SINGLE-source ' WHEN 2 THEN ' Majority ' ELSE 'other' END")
    return t("documents").select("doc_id", provenance.support_level(label).alias("support"), provenance.agreement_label(label).alias("agreement"))


@query("gap_candidates", (
    " SELECT claim_id, 'single_source' AS kind FROM claim_sources GROUP BY claim_id HAVING count(*) = 1 UNION ALL SELECT claim_id, 'no_counterargument' "
    "FROM claims WHERE agreement_level = 'consensus' AND claim_id % 10 <> 0"
), "claims", "claim_sources")
def gap_candidates(t):
    return provenance.gaps(t("claims"), t("claim_sources"), t("claims").filter("claim_id % 10 = 0").select("claim_id"))


@query("draft_gaps", (
    " SELECT doc_id, list_filter([CASE WHEN doc_id % 7 > 2 * (doc_id % 3) THEN 'Check for additional areas of disagreement' END, CASE "
    "WHEN doc_id % 2 = 0 THEN 'Identify uncertainties in the expert responses' END], lambda g: g IS NOT NULL) AS gaps FROM documents"
))
def draft_gaps(t):
    return t("documents").select("doc_id", provenance.draft_gaps(F.col("doc_id") % 7, F.col("doc_id") % 3, F.col("doc_id") % 2).alias("gaps"))


@query("heuristic_resolve", (
    ", one AS (SELECT claim_id FROM claim_sources GROUP BY claim_id HAVING count(*) = 1) SELECT DISTINCT claim_id, source_id FROM (SELECT claim_id, "
    "source_id FROM claim_sources UNION ALL SELECT claim_id, concat('e', claim_id % 5) FROM one UNION ALL SELECT claim_id, 'r' FROM one)"
), "claim_sources")
def heuristic_resolve(t):
    claims = t("claims").select("claim_id")
    found = claims.select("claim_id", F.lit(1).alias("ord"), F.expr("concat('e', claim_id % 5)").alias("source_id")).unionByName(claims.select("claim_id", F.lit(2).alias("ord"), F.lit("r").alias("source_id")))
    return provenance.resolved_sources(t("claim_sources"), found).select("claim_id", "source_id")


@query("revision_guard", " SELECT doc_id, doc_id % 3 = 0 OR (doc_id % 4 > 0 AND doc_id % 5 = 0) AS keeps FROM documents")
def revision_guard(t):
    return t("documents").select("doc_id", provenance.revision_kept(F.col("doc_id") % 4, F.col("doc_id") % 5, F.col("doc_id") % 3 != 0).alias("keeps"))


VERIFIED = r"""SELECT quote_id, source_id, CASE WHEN coalesce(quote, '') = '' OR coalesce(text, '') = '' THEN 'unverified' WHEN contains(text, regexp_replace(quote, '^\s+|\s+$', '', 'g')) THEN 'verified'
WHEN contains(lower(text), lower(quote)) THEN 'paraphrased' ELSE 'absent' END AS status FROM quotes"""


@query("quote_verify", " " + VERIFIED, "quotes")
def quote_verify(t):
    q = t("quotes")
    texts = t("documents").select(F.col("doc_id").alias("source_id"), "text")
    return provenance.quotes_verified(q.select("quote_id", "source_id", "quote"), texts).select("quote_id", "source_id", "status")


TOKENS = "list_distinct(list_transform(list_filter(regexp_split_to_array({0}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) > 2), lambda w: lower(w)))"


@query("content_tokens", f" SELECT item_id, len({TOKENS.format('text')}) AS n_tokens, array_to_string(list_sort({TOKENS.format('text')}), ' ') AS tokens FROM benchmark")
def content_tokens_query(t):
    tokens = content_tokens(F.col("text"))
    return t("benchmark").select("item_id", F.size(tokens).alias("n_tokens"), F.array_join(F.array_sort(tokens), " ").alias("tokens"))


# a quote of every document: some of its words, and one that it has not
SNAPPED = rf"""WITH d AS (SELECT doc_id AS quote_id, 'zzzz ' || array_to_string(string_split(text, ' ')[3:14], ' ') AS quote, text FROM documents),
s AS (SELECT quote_id, quote, trim(x, ' ' || chr(10) || chr(9)) AS sentence FROM (SELECT quote_id, quote, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\r\f]', '\1' || chr(1), 'g'), chr(1) || '|\n')) AS x FROM d)),
k AS (SELECT quote_id, len(list_intersect({TOKENS.format('quote')}, {TOKENS.format('sentence')})) AS o, len({TOKENS.format('quote')}) AS n FROM s WHERE sentence <> '')
SELECT quote_id, round(max(o / n), 6) AS score FROM k WHERE o >= 4 AND n >= 4 AND o / n >= 0.55 GROUP BY quote_id"""


@query("quote_snap", SNAPPED)
def quote_snap(t):
    quote = F.expr("'zzzz ' || array_join(slice(split(text, ' '), 3, 12), ' ')")
    return provenance.snapped(t("documents").select(F.col("doc_id").alias("quote_id"), quote.alias("quote"), "text")).select("quote_id", "score")


FOUND = """WITH q AS (SELECT item_id AS quote_id, doc_id AS source_id, d.text,
CASE item_id % 3 WHEN 0 THEN upper(b.text) WHEN 1 THEN concat(' ', b.text, ' ') ELSE concat(b.text, ' x') END AS quote FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
v AS (SELECT *, CASE WHEN contains(text, trim(quote)) THEN 'verified' WHEN contains(lower(text), lower(quote)) THEN 'paraphrased' ELSE 'absent' END AS status FROM q)"""

SNAP_VERIFIED = rf"""{FOUND},
s AS (SELECT quote_id, source_id, quote, trim(x, ' ' || chr(10) || chr(9)) AS sentence FROM
(SELECT *, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\r\f]', '\1' || chr(1), 'g'), chr(1) || '|\n')) AS x FROM v WHERE status <> 'verified')),
k AS (SELECT quote_id, source_id, len(list_intersect({TOKENS.format('quote')}, {TOKENS.format('sentence')})) AS o, len({TOKENS.format('quote')}) AS n FROM s WHERE sentence <> ''),
h AS (SELECT DISTINCT quote_id, source_id FROM k WHERE o >= 4 AND n >= 4 AND o / n >= 0.55)
SELECT quote_id, source_id, CASE WHEN h.quote_id IS NOT NULL THEN 'verified' ELSE status END AS status, h.quote_id IS NOT NULL AS snapped FROM v LEFT JOIN h USING (quote_id, source_id)"""


@query("snap_verified", SNAP_VERIFIED)
def snap_verified(t):
    texts = t("documents").select(F.col("doc_id").alias("source_id"), "text")
    return provenance.quotes_resolved(all_quotes(t("benchmark"), t("documents")).select("quote_id", "source_id", "quote"), texts).select("quote_id", "source_id", "status", "snapped")


REFS = (
    ", n1 AS (SELECT node_id, arg_min(expert_id, node_ord * 10 + graph_ord) AS e, arg_min(CASE WHEN node_ord % 2 = 0 THEN 'verified' ELSE 'absent' END, "
    "node_ord * 10 + graph_ord) AS st, arg_min(concat('q', node_ord), node_ord * 10 + graph_ord) AS q FROM nodes GROUP BY node_id)"
)


@query("attach_quotes", REFS + (
    ", r AS (SELECT DISTINCT claim_id, e AS source_id, q AS quote FROM claims JOIN n1 ON n1.node_id = concat('n', claim_id % 300) "
    "WHERE st = 'verified' AND claim_id % 6 <> 0) SELECT * FROM r"
), "nodes", "claims")
def attach_quotes(t):
    nodes = t("nodes").withColumn("node_ord", F.col("node_ord") * 10 + F.col("graph_ord")).withColumns({"status": F.expr("CASE WHEN (node_ord div 10) % 2 = 0 THEN 'verified' ELSE 'absent' END"), "quote": F.expr("concat('q', node_ord div 10)")})
    refs = t("claims").select("claim_id", F.lit(1).alias("ref_ord"), F.expr("concat('n', claim_id % 300)").alias("node_id"))
    have = t("claims").filter("claim_id % 6 = 0").select("claim_id", F.lit("e").alias("source_id"), F.lit("x").alias("quote"), F.lit("verified").alias("status"), F.lit(None).cast("string").alias("node_id"))
    return provenance.node_quotes(refs, nodes, have).select("claim_id", "source_id", "quote")


@query("inherit_quote", ", c AS (SELECT claim_id, claim_id % 13 AS k FROM claims) SELECT claim_id, concat('e', k) AS source_id, concat('quote ', k) AS quote FROM c WHERE k % 2 = 0", "claims")
def inherit_quote(t):
    claims = t("claims").select("claim_id", F.expr("concat('alpha beta gamma delta epsilon number', claim_id % 13)").alias("text"))
    sources = claims.select("claim_id", F.expr("concat('e', claim_id % 13)").alias("source_id"))
    nodes = t("nation").filter("n_nationkey < 13").selectExpr("concat('e', n_nationkey) AS expert_id", "n_nationkey AS node_ord", "CASE WHEN n_nationkey % 2 = 0 THEN concat('alpha beta gamma delta zeta eta number', n_nationkey) ELSE 'alpha beta other words here' END AS claim", "concat('quote ', n_nationkey) AS quote", "'verified' AS status")
    none = claims.filter("false").select("claim_id", F.lit("").alias("source_id"), F.lit("").alias("quote"), F.lit("").alias("status"))
    return provenance.inherited_quotes(claims, sources, nodes, none, none.select("claim_id"))


@query("merge_graph_nodes", " SELECT node_id, arg_min(expert_id, CAST(graph_ord AS BIGINT) * 1000000000 + node_ord) AS expert_id FROM nodes GROUP BY node_id", "nodes")
def merge_graph_nodes(t):
    return graph.merged_nodes(t("nodes").dropDuplicates(["node_id", "graph_ord", "node_ord"])).select("node_id", "expert_id")


@query("merge_graph_edges", " SELECT source, target, arg_min(relation, CAST(graph_ord AS BIGINT) * 1000000000 + edge_ord) AS relation FROM edges GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY source, target"), "edges")
def merge_graph_edges(t):
    return graph.merged_edges(t("edges")).select("source", "target", "relation")


@query("edge_relation_stats", (
    " SELECT 'expert' AS kind, expert_id AS name, count(*) AS n FROM nodes GROUP BY expert_id UNION ALL SELECT 'relation', relation, count(*) FROM edges "
    "GROUP BY relation"
), "nodes", "edges")
def edge_relation_stats(t):
    return graph.fan_in(t("nodes"), t("edges"))


@query("node_namespaces", " SELECT DISTINCT CASE WHEN graph_ord % 2 = 0 THEN concat(expert_id, '_x') ELSE concat(expert_id, '_', node_id) END AS id FROM nodes", "nodes")
def node_namespaces(t):
    node = F.expr("CASE WHEN graph_ord % 2 = 0 THEN concat(expert_id, '_x') ELSE node_id END")
    return t("nodes").select(graph.namespaced(F.col("expert_id"), node).alias("id")).distinct()


@query("gap_blocks", " SELECT doc_id, concat('d', doc_id) AS description, CASE WHEN doc_id % 2 = 0 THEN concat('d', doc_id) ELSE 'q' END AS query FROM documents WHERE doc_id % 3 <> 0")
def gap_blocks(t):
    reply = F.expr((
        "concat('x <gap><description>', CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat(' d', doc_id) END, '</description>', CASE "
        "WHEN doc_id % 2 = 0 THEN '' ELSE '<query>q </query>' END, '</gap>')"
    ))
    return t("documents").select("doc_id", F.explode(graph.gaps_of(reply)).alias("g")).select("doc_id", "g.description", "g.query")


ELEMENTS = """SELECT doc_id AS reply_id, 0 AS ord, 'claim' AS kind, concat('C', doc_id) AS id, 'a & b' AS text, '' AS source, '' AS target, '' AS relation, 2 AS children FROM documents
UNION ALL SELECT doc_id, 1, 'edge', '', '', 'n1', 'n2', 'supports', 0 FROM documents
UNION ALL SELECT doc_id, 2, 'claim', 'cut', 'rest', '', '', '', 0 FROM documents"""


@query("reply_elements", ELEMENTS)
def reply_elements(t):
    reply = F.expr("concat('<claims><claim id=\"C', doc_id, '\"><text>a & b</text><source id=\"s1\"/><quote source=\"s2\">q</quote></claim><edge source=\"n1\" target=\"n2\" relation=\"supports\"/><claim id=\"cut\"><text>rest')")
    return graph.parsed_replies(t("documents").select(F.col("doc_id").alias("reply_id"), reply.alias("reply"))).withColumn("children", F.size("children"))


EVIDENCE = f"""{FOUND} SELECT source_id, count(*) AS n_quotes, CASE WHEN max(CAST(contains(text, trim(quote)) AS INT)) = 1 THEN 1 END AS n_sections, 'High' AS tier FROM v GROUP BY source_id"""


@query("graph_evidence", EVIDENCE)
def graph_evidence(t):
    nodes = all_quotes(t("benchmark"), t("documents")).select(F.col("source_id").alias("expert_id"), F.col("quote_id").alias("node_ord"), F.col("quote"), F.lit("verified").alias("status"))
    texts = t("documents").select(F.col("doc_id").alias("source_id"), F.concat(F.lit("## head\n"), "text").alias("text"))
    tiers = t("documents").select(F.col("doc_id").alias("source_id"), F.lit("High").alias("tier"))
    return graph.evidence(nodes, texts, tiers).select("source_id", F.size("quotes").alias("n_quotes"), F.size("sections").alias("n_sections"), "tier")


@query("seed_selection", (
    ", f AS (SELECT query_id AS question_id, source_id AS paper_id, min(lane * 1000 + rank) AS o FROM lanes GROUP BY ALL), r AS (SELECT *, "
    "row_number() OVER (PARTITION BY question_id ORDER BY CAST(substr(paper_id, 2) AS INT) % 10 DESC, o) AS n FROM f) SELECT question_id, paper_id FROM r "
    "WHERE n <= 3"
), "lanes")
def seed_selection(t):
    found = t("lanes").select(F.col("query_id").alias("question_id"), F.col("lane").alias("search"), "rank", F.col("source_id").alias("paper_id"), (F.expr("CAST(substr(source_id, 2) AS INT)") % 10).alias("citation_count"))
    return graph.seeds(found).select("question_id", "paper_id")


@query("cache_misses", " SELECT DISTINCT doc_id AS cache_key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_misses(t):
    return graph.cached(t("documents").select(F.col("doc_id").alias("cache_key")), t("labels").select(F.col("doc_id").alias("cache_key"), "quality"))[1]


def level(n: int) -> str:
    """The ten best of candidates n{n} (seed, p), as l{n}."""
    return f"""l{n} AS (SELECT seed, p, c FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY c DESC, p) AS r FROM (SELECT k.seed, k.p, {COSINE} AS c FROM n{n} k JOIN embeddings e ON e.vec_id = k.p JOIN embeddings q ON q.vec_id = k.seed) WHERE c >= 0) WHERE r <= 10)"""


FRONTIER = f"""WITH g AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), s AS (SELECT vec_id AS seed FROM embeddings WHERE vec_id % 100 = 0),
n1 AS (SELECT DISTINCT seed, dst AS p FROM s JOIN g ON src = seed WHERE dst <> seed), {level(1)},
n2 AS (SELECT seed, dst AS p FROM l1 JOIN g ON src = p EXCEPT (SELECT seed, p FROM l1 UNION SELECT seed, seed FROM s)), {level(2)}
SELECT seed, seed AS paper_id, 0 AS level, 1.0 AS relevance FROM s UNION ALL SELECT seed, p, 1, round(c, 6) FROM l1 UNION ALL SELECT seed, p, 2, round(c, 6) FROM l2"""


@query("bfs_frontier", FRONTIER)
def bfs_frontier(t):
    papers = t("embeddings").select(F.col("vec_id").alias("paper_id"), "embedding")
    start = papers.filter("paper_id % 100 = 0").select(F.col("paper_id").alias("seed"), "paper_id")
    edges = t("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.expr("CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END").alias("kind"), F.col("l_orderkey").alias("edge_ord"))
    anchor = papers.filter("paper_id % 100 = 0").select(F.col("paper_id").alias("seed"), F.col("embedding").alias("anchor"))
    return graph.frontier(start, edges, papers, anchor, least=0.0)


HEURISTIC = """ SELECT graph_ord AS graph_id, node_id, claim, expert_id, 'verified' AS status FROM nodes
UNION ALL SELECT doc_id % 7, concat('heuristic_n', row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) - 1), substr(text, 1, 200), concat('d', doc_id), 'unverified' FROM documents"""


@query("heuristic_nodes", HEURISTIC, "nodes")
def heuristic_nodes(t):
    nodes = t("nodes").select(F.col("graph_ord").alias("graph_id"), "node_id", "claim", "expert_id", F.lit("verified").alias("status"))
    retrieved = t("documents").select((F.col("doc_id") % 7).alias("graph_id"), F.col("doc_id").alias("ord"), F.expr("concat('d', doc_id)").alias("source_id"), F.col("text").alias("content"))
    return graph.heuristic_nodes(nodes, retrieved)


FALLBACK = """WITH a AS (SELECT o_orderkey AS draft_id, o_orderkey % 3 AS p, o_orderkey % 5 AS f FROM orders)
SELECT 'graph' AS kind, draft_id, CASE WHEN p = 0 THEN 'patch' WHEN f < 2 THEN 'full' ELSE 'heuristic' END AS taken FROM a
UNION ALL SELECT 'synthesis', draft_id, CASE WHEN p = 0 THEN 'patch' WHEN p = 2 THEN 'abort' WHEN f < 2 THEN 'full' WHEN f = 4 THEN 'abort' ELSE 'heuristic' END FROM a"""


@query("resolve_fallback", FALLBACK)
def resolve_fallback(t):
    o = t("orders").select(F.col("o_orderkey").alias("draft_id"))
    patch = o.select("draft_id", F.lit("patch").alias("way"), F.expr("CASE draft_id % 3 WHEN 0 THEN 'parsed' WHEN 1 THEN 'unparsed' ELSE 'error' END").alias("outcome"))
    full = o.select("draft_id", F.lit("full").alias("way"), F.expr("CASE WHEN draft_id % 5 < 2 THEN 'parsed' WHEN draft_id % 5 < 4 THEN 'unparsed' ELSE 'error' END").alias("outcome"))
    attempts = patch.unionByName(full)
    each = [graph.fallen_back(attempts, kind).select(F.lit(kind).alias("kind"), "draft_id", "taken") for kind in ("graph", "synthesis")]
    return each[0].unionByName(each[1])


@query("unverified_nodes", " SELECT doc_id % 7 AS graph_id, concat('n', doc_id) AS node_id, substr(text, 1, 100) AS claim FROM documents WHERE doc_id % 4 IN (0, 1)")
def unverified_nodes(t):
    status = F.expr("CASE doc_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'unverified' WHEN 2 THEN 'absent' ELSE 'verified' END")
    return graph.unverified(t("documents").select((F.col("doc_id") % 7).alias("graph_id"), F.expr("concat('n', doc_id)").alias("node_id"), F.col("text").alias("claim"), status.alias("status")))


DRAFTED = """ SELECT run_id AS question_id, count(*) FILTER (WHERE claim_id % 4 <> 0) AS n_graphs, count(*) FILTER (WHERE claim_id % 4 = 0) AS n_failed, count(*) FILTER (WHERE claim_id % 4 <> 0) > 1 AS resolves FROM claims GROUP BY run_id"""


@query("drafted_graphs", DRAFTED, "claims")
def drafted_graphs(t):
    return graph.drafted(t("claims").select(F.col("run_id").alias("question_id"), F.col("claim_id").alias("expert_id"), (F.col("claim_id") % 4 != 0).alias("ok")))
