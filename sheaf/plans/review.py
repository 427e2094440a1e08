"""The engine's entry points: ingest a folder, search in three lanes, evolve drafts, post-process a synthesis, render it.

Language-model calls are a table of completions (run_id, stage, trajectory, step, task, reply);
what they would have been asked is not rebuilt here. All else is plans over tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import citations, corpus, fitness, graph, provenance, replies, retrieval
from ..session import settled
from ..sources import corpora

PROFILES = {"v1": "delphi", "v2": "lit-review", "v3": "lit-review-long"}


@dataclass(frozen=True)
class Options:
    """What a review may be told."""

    profile: str = "v2"
    top_k: int = 10
    most_top_k: int = 50
    rerank: bool = True
    rerank_floor: float = 0.3
    topicality: bool = True
    local_only: bool = False
    drafts: int = 5
    steps: int = 2
    threshold: int = 3
    plateau: float | None = None

    def checked(self) -> Options:
        if self.profile not in PROFILES:
            raise ValueError(f"unknown profile {self.profile}")
        return replace(self, top_k=max(1, min(self.top_k, self.most_top_k)))


@dataclass(frozen=True)
class Tables:
    """A synthesis as tables, keyed by run_id and claim_id."""

    claims: DataFrame
    sources: DataFrame
    quotes: DataFrame
    refs: DataFrame


class Engine:
    def __init__(self, spark: SparkSession, options: Options | None = None):
        self.spark, self.options = spark, (options or Options()).checked()

    def ingest(self, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(papers, chunks, failures) of a folder's files."""
        files = corpora.local_corpus(self.spark, folder)
        texts = corpora.file_texts(files)
        chunks = corpora.plain_chunks(texts.filter("failure is null"))
        papers = files.select("paper_id", F.lit("local").alias("source"), "title").join(texts.filter("failure is null").select("paper_id"), "paper_id", "left_semi")
        return papers, chunks, texts.filter("failure is not null").select("paper_id", "failure")

    def lanes(self, queries: DataFrame, chunks: DataFrame, live: list[DataFrame]) -> DataFrame:
        """The lanes that `search` takes: the stored chunks (paper_id, chunk_index, source_type, title, embedding) nearest to each query's vector, one for each paper, as lane 0, and the live lanes (query_id, rank, source_type, source_id, title) as 1 and on.

        A store of several chunks for each paper is asked for more of them, and a paper keeps the rank of its nearest one.
        """
        found = retrieval.nearest(queries, chunks, self.options.most_top_k, id_column="chunk_id")
        best = found.groupBy("query_id", F.col("paper_id").alias("source_id")).agg(F.min("rank").alias("first"), F.min_by("source_type", "rank").alias("source_type"), F.min_by("title", "rank").alias("title"))
        order = Window.partitionBy("query_id").orderBy("first")
        out = best.select("query_id", F.lit(0).alias("lane"), F.row_number().over(order).alias("rank"), "source_type", "source_id", "title").filter(F.col("rank") <= self.options.top_k)
        for n, rows in enumerate([] if self.options.local_only else live, 1):
            out = out.unionByName(rows.select("query_id", F.lit(n).alias("lane"), "rank", "source_type", "source_id", "title"))
        return out

    def search(self, lanes: DataFrame, queries: DataFrame, scores: DataFrame | None = None, replies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(hits by position, a status for each query): fuse, gate, rerank, top k, topicality.

        lanes as for `retrieval.fused`; queries (query_id, lane_reason); scores of a
        cross-encoder by position; replies of a topicality judge. With local_only the live
        lanes (numbered from 1) are left out.
        """
        o = self.options
        kept, status = retrieval.gated(retrieval.fused(lanes.filter("lane = 0") if o.local_only else lanes), queries)
        order = Window.partitionBy("query_id").orderBy("position")
        kept = kept.withColumn("position", F.row_number().over(order) - 1)
        if scores is not None and o.rerank:
            before = kept.groupBy("query_id").agg(F.count("*").alias("had"))
            kept = retrieval.reranked(kept, scores, o.rerank_floor).withColumn("position", F.col("new_position") - 1).drop("new_position", "rerank_score")
            after = kept.groupBy("query_id").agg(F.count("*").alias("have"))
            status = status.join(before, "query_id", "left").join(after, "query_id", "left")
            lost = F.coalesce("had", F.lit(0).cast("long")) - F.coalesce("have", F.lit(0).cast("long"))
            status = status.withColumn("reason", retrieval.folded(F.col("reason"), retrieval.rerank_reason(lost, o.rerank_floor))).drop("had", "have")
        kept = kept.withColumn("position", F.col("position") + 1).filter(F.col("position") <= o.top_k)
        if replies is not None and o.topicality:
            kept = retrieval.topical(kept, replies)
        return kept, status

    def panel(self, hits: DataFrame, chunks: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(panel, its conservation): no source of the hits may be lost or doubled."""
        made = corpus.panel(hits, chunks, papers)
        return made, corpus.conservation(hits, made)

    def ranked(self, completions: DataFrame, weights: DataFrame, kind: str, vetoes: DataFrame | None = None) -> DataFrame:
        """Candidates (run_id, trajectory) of judged completions (task is the dimension), best first."""
        keys = ["run_id", "trajectory"]
        scores = completions.select(*keys, F.col("task").alias("dim"), fitness.parsed_score(F.col("reply")).alias("score"))
        both = fitness.weighted(scores, weights, keys).join(fitness.validity(scores, keys, kind, vetoes), keys)
        return fitness.best_first(both.withColumn("ord", F.col("trajectory")), ["run_id"])

    def evolved(self, drafts: DataFrame, completions: DataFrame, weights: DataFrame, retrieved: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(last drafts, the steps' records) after `steps` rounds of judging, gaps, retrieval and resolving.

        drafts (run_id, trajectory, draft); completions of the stages `judge` (a reply for each
        dimension), `gaps` and `resolve`; retrieved (query, source_id, ord). All trajectories
        of a step are one plan. A draft without retrieved sources, or without a resolution,
        stays as it is; with a plateau, a draft that has reached it is not refined any more.
        """
        keys = ["run_id", "trajectory"]
        records = None
        for step in range(self.options.steps):
            now = completions.filter(F.col("step") == step)
            judged = now.filter("stage = 'judge'").select(*keys, F.col("task").alias("dim"), fitness.parsed_score(F.col("reply")).alias("score"))
            scores = fitness.weighted(judged, weights, keys)
            gaps = now.filter("stage = 'gaps'").select(*keys, F.posexplode(graph.gaps_of(F.col("reply"))).alias("gap", "g")).select(*keys, "gap", F.col("g.query").alias("query"))
            found = retrieval.first_seen(gaps.join(retrieved, "query"), [*keys, "source_id"], "gap", "ord").groupBy(*keys).agg(F.count("*").alias("n_sources"))
            resolved = now.filter("stage = 'resolve'").groupBy(*keys).agg(F.max("reply").alias("new"))
            state = drafts.join(scores, keys, "left").join(found, keys, "left").join(resolved, keys, "left")
            done = F.lit(False) if self.options.plateau is None else F.coalesce(F.col("weighted") >= self.options.plateau, F.lit(False))
            take = ~done & (F.coalesce("n_sources", F.lit(0)) > 0) & F.col("new").isNotNull()
            state = state.withColumn("changed", take)
            record = state.select(*keys, F.lit(step).alias("step"), "weighted", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "changed")
            records = record if records is None else records.unionByName(record)
            drafts = state.select(*keys, F.when(take, F.col("new")).otherwise(F.col("draft")).alias("draft"))
        return drafts, records

    def post_processed(self, made: Tables, nodes: DataFrame, texts: DataFrame, panel: DataFrame) -> tuple[Tables, DataFrame]:
        """(the synthesis with its ids, levels and quotes settled, the panel members nobody cites).

        Ids are normalised; v2 and v3 strip invalid ones and take quotes from the graph, v1
        computes agreement levels. Quotes are verified against stored texts, and again with
        those that were added.
        """
        sources = provenance.normalised_sources(made.sources, panel)
        quotes = provenance.panel_id_of(made.quotes, panel, "source_id", "quote_id")
        claims = made.claims
        if self.options.profile == "v1":
            claims = provenance.agreement(claims, sources, panel)
        else:
            sources, quotes = provenance.without_invalid(sources, panel), provenance.without_invalid(quotes, panel)
        kept = ["quote_id", "claim_id", "source_id", "quote", "node_id"]
        checked = provenance.quotes_resolved(quotes.select(*kept), texts)
        if self.options.profile != "v1":
            cited = provenance.node_quotes(made.refs, nodes, checked).select(F.concat_ws("|", F.lit("node"), "claim_id", "node_id").alias("quote_id"), "claim_id", "source_id", "quote", "node_id")
            taken = provenance.inherited_quotes(claims, sources, nodes, checked, made.refs).select(F.concat_ws("|", F.lit("claim"), "claim_id", "source_id").alias("quote_id"), "claim_id", "source_id", "quote", F.lit(None).cast("string").alias("node_id"))
            more = provenance.quotes_resolved(cited.unionByName(taken).select(*kept), texts).withColumn("inherited", F.lit(True))
            checked = checked.withColumn("quote_id", F.col("quote_id").cast("string")).withColumn("inherited", F.lit(False)).unionByName(more)
        return Tables(claims, sources, checked, made.refs), provenance.coverage(panel, sources)[0]

    def revised(self, made: Tables, revision: DataFrame) -> tuple[Tables, bool]:
        """(the synthesis that a revision's reply gives, whether it is taken): it is not if it can't be parsed, or has claims but no source any more while the one before had some.

        revision has one row, the reply. What was lost is judged on the parsed claims, before their ids are normalised.
        """
        got = settled(replies.parsed(revision.select(F.lit(1).alias("reply_id"), F.lit("synthesis").alias("kind"), "reply", F.lit(self.options.profile if self.options.profile == "v1" else "v2").alias("profile"))))
        had = made.sources.limit(1).count()
        verdict = got.select((F.col("status") != "failed").alias("parsed"), F.coalesce(replies.lost_sources(got), F.lit(False)).alias("lost")).first()
        if verdict is None or not verdict["parsed"] or (had and verdict["lost"]):
            return made, False
        each = got.select(F.posexplode("synthesis.claims").alias("claim_id", "c"))
        quotes = each.select("claim_id", F.posexplode("c.quotes").alias("quote_ord", "q"))
        return Tables(
            each.select("claim_id", "c.text", "c.agreement_level"),
            each.select("claim_id", F.posexplode("c.sources").alias("source_ord", "source_id")),
            quotes.select(F.concat_ws("|", F.lit("revised"), "claim_id", "quote_ord").alias("quote_id"), "claim_id", F.col("q.source").alias("source_id"), F.col("q.text").alias("quote"), "q.node_id"),
            each.select("claim_id", F.posexplode("c.node_refs").alias("ref_ord", "node_id")),
        ), True

    def finished(self, made: Tables, nodes: DataFrame, texts: DataFrame, panel: DataFrame, revision: DataFrame | None = None, reports: DataFrame | None = None) -> tuple[Tables, DataFrame, DataFrame]:
        """(the synthesis after all steps, the panel members that nobody cites still, minority reports to be added).

        The steps of `post_processed`; where a panel member is not cited and there is a revision's
        reply, the revision, if it is taken, through the same steps again; and in v1 the sources
        that only minority claims cite and that have no report (source_id).
        """
        out, missing = self.post_processed(made, nodes, texts, panel)
        if revision is not None and missing.limit(1).count():
            again, taken = self.revised(out, revision)
            if taken:
                out, missing = self.post_processed(again, nodes, texts, panel)
        if self.options.profile != "v1":
            return out, missing, panel.select("source_id", F.lit(0).cast("long").alias("n_claims")).limit(0)
        known = reports if reports is not None else panel.select("source_id").limit(0)
        return out, missing, provenance.minority_only(out.claims, out.sources, known).join(panel.select("source_id").distinct(), "source_id", "left_semi")

    def live(self, log: DataFrame, found: DataFrame, queries: DataFrame, chunks_of: Callable[[DataFrame], DataFrame], stored: DataFrame, k: int, skip: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The live lane: papers that were found (a log of writes, as `corpus.upserted` takes it) are ingested, then every query is searched in the whole store.

        chunks_of makes chunks (chunk_id, paper_id, embedding, ...) of papers; those in skip (paper_id), or with chunks in
        stored already, are not made anew. Gives (the papers after the writes, the k nearest chunks of each query).
        """
        papers = corpus.upserted(log.unionByName(found, allowMissingColumns=True))
        known = stored.select("paper_id").distinct() if skip is None else stored.select("paper_id").union(skip.select("paper_id")).distinct()
        new = corpus.not_ingested(papers.join(found.select("paper_id").distinct(), "paper_id", "left_semi"), known)
        return papers, retrieval.nearest(queries, stored.unionByName(chunks_of(new)), k)

    def rendered(self, documents: DataFrame, claims: DataFrame, sources: DataFrame, papers: DataFrame) -> DataFrame:
        """documents (doc, text) with author-year citations for their claims' markers, and the list of references at the end."""
        clean = citations.sanitised(documents, claims)
        shown = citations.with_citations(clean, claims, sources, papers)
        own = claims.select("doc", "claim_id").join(sources, "claim_id")
        first = retrieval.first_seen(own, ["doc", "source_id"], "claim_id", "source_ord")
        lines = citations.references(sources, papers).select("source_id", "line")
        refs = first.join(lines, "source_id").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", "source_ord", "line"))), lambda x: x["line"]), "\n").alias("refs"))
        return shown.join(refs, "doc", "left").select("doc", F.when(F.col("refs").isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n\n## References\n\n"), "refs")).alias("text"))

    @staticmethod
    def notice(*reasons: Column) -> Column:
        """What a review has to say about itself; null if nothing was degraded."""
        return retrieval.folded(*reasons)
