"""Argument graphs: merging, namespaces, parsing of replies, evidence, statistics, frontier expansion."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, sections, strip, tag_bodies, tag_body
from ..functions.vectors import cosine
from ..session import settled
from .retrieval import first_seen

EVIDENCE_CHARS, EVIDENCE_SECTIONS = 3000, 3
HEURISTIC_CHARS, UNVERIFIED_CHARS = 200, 100
SEEDS, LEVEL_BEST, LEVEL_LEAST, PER_EDGE = 3, 10, 0.3, 100


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """The first node of each id, by graph and ordinal."""
    return first_seen(nodes, ["node_id"], "graph_ord", "node_ord")


def merged_edges(edges: DataFrame) -> DataFrame:
    """The first edge between two nodes, whatever its relation."""
    return first_seen(edges, ["source", "target"], "graph_ord", "edge_ord")


def namespaced(expert: Column, node: Column) -> Column:
    """`{expert}_{node}`, unless the id is the expert's already."""
    return F.when((node == expert) | node.startswith(F.concat(expert, F.lit("_"))), node).otherwise(F.concat_ws("_", expert, node))


def gaps_of(reply: Column) -> Column:
    """Array of (description, query) out of a reply's gap blocks; a gap needs a description, which is its query by default."""
    each = F.transform(tag_bodies(reply, "gap"), lambda g: F.struct(strip(tag_body(g, "description")).alias("description"), strip(tag_body(g, "query")).alias("query")))
    return F.transform(F.filter(each, lambda g: F.coalesce(g["description"], F.lit("")) != ""), lambda g: F.struct(g["description"].alias("description"), F.coalesce(F.nullif(g["query"], F.lit("")), g["description"]).alias("query")))


class Reply(HTMLParser):
    """Collects claims, nodes and edges of a reply as far as it goes; a cut reply keeps what came before."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, dict[str, str], dict[str, str], list[dict[str, str]]]] = []
        self.open: tuple[str, dict[str, str]] | None = None
        self.fields: dict[str, str] = {}
        self.children: list[dict[str, str]] = []
        self.field: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = {k: v or "" for k, v in attrs}
        if tag in ("claim", "node", "edge", "gap") and (self.open is None or tag != "claim"):
            self.close_row()
            self.open = tag, found
        elif self.open is not None:
            if tag in ("source", "quote", "ref"):
                self.children.append({"kind": tag, **found, "text": ""})
            self.field = tag
            self.fields.setdefault(tag, "")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.open and self.open[0] == tag:
            self.close_row()
        self.field = None

    def handle_data(self, data: str) -> None:
        if self.open is not None and self.field:
            self.fields[self.field] += data
            if self.children and self.children[-1]["kind"] == self.field:
                self.children[-1]["text"] += data

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag == self.open[0]:
            self.close_row()
        elif tag == self.field:
            self.field = None

    def close_row(self) -> None:
        if self.open is not None:
            self.rows.append((*self.open, {k: v.strip() for k, v in self.fields.items()}, self.children))
        self.open, self.fields, self.children, self.field = None, {}, [], None


def parsed_replies(replies: DataFrame) -> DataFrame:
    """(reply_id, ord, kind, id, text, source, target, relation, children) of each element in replies (reply_id, reply)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, reply in zip(batch["reply_id"], batch["reply"], strict=True):
                parser = Reply()
                parser.feed(reply or "")
                parser.close()
                parser.close_row()
                for i, (kind, attrs, fields, children) in enumerate(parser.rows):
                    source = attrs.get("source") or attrs.get("from") or fields.get("source", "")
                    kids = [(c["kind"], c.get("id") or c.get("expert_id") or c.get("source") or "", c["text"].strip()) for c in children]
                    out.append((key, i, kind, attrs.get("id", ""), fields.get("text") or fields.get("claim") or fields.get("description", ""), source, attrs.get("target") or attrs.get("to") or fields.get("target", ""), attrs.get("relation") or fields.get("relation", ""), kids))
            yield pd.DataFrame(out, columns=["reply_id", "ord", "kind", "id", "text", "source", "target", "relation", "children"])

    kind = replies.schema["reply_id"].dataType.simpleString()
    return replies.select("reply_id", "reply").mapInPandas(run, f"reply_id {kind}, ord int, kind string, id string, text string, source string, target string, relation string, children array<struct<kind:string,id:string,text:string>>")


def patched(claims: DataFrame, patch: DataFrame) -> DataFrame:
    """claims, and those that a patch adds, as divided ones without sources."""
    return claims.unionByName(patch.withColumn("agreement_level", F.lit("divided")), allowMissingColumns=True)


def evidence(nodes: DataFrame, texts: DataFrame, tiers: DataFrame) -> DataFrame:
    """For each source its verified quotes, tier, and up to three sections, cut to 3000 characters, that hold one of them."""
    quoted = nodes.filter((F.col("status") == "verified") & ~blank(F.col("quote"))).select(F.col("expert_id").alias("source_id"), "node_ord", "quote")
    parts = texts.select("source_id", F.posexplode(sections(F.col("text"))).alias("pos", "s")).select("source_id", "pos", "s.heading", "s.body")
    held = parts.join(quoted, "source_id").filter(F.contains("body", strip(F.col("quote")))).select("source_id", "pos", "heading", F.substring("body", 1, EVIDENCE_CHARS).alias("body")).distinct()
    held = held.withColumn("r", F.row_number().over(Window.partitionBy("source_id").orderBy("pos"))).filter(F.col("r") <= EVIDENCE_SECTIONS)
    held = held.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("pos", "heading", "body"))).alias("sections"))
    quotes = quoted.groupBy("source_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("node_ord", "quote"))), lambda x: x["quote"]).alias("quotes"))
    return quotes.join(held, "source_id", "left").join(tiers.filter("tier <> 'Unknown'"), "source_id", "left")


def heuristic_nodes(nodes: DataFrame, retrieved: DataFrame) -> DataFrame:
    """nodes (graph_id, node_id, claim, expert_id, status), and an unverified one for each item retrieved for their graph (graph_id, ord, source_id, content)."""
    n = F.row_number().over(Window.partitionBy("graph_id").orderBy("ord")) - 1
    added = retrieved.select("graph_id", F.concat(F.lit("heuristic_n"), n.cast("string")).alias("node_id"), F.substring("content", 1, HEURISTIC_CHARS).alias("claim"), F.col("source_id").alias("expert_id"), F.lit("unverified").alias("status"))
    return nodes.select("graph_id", "node_id", "claim", "expert_id", "status").unionByName(added)


def fallen_back(attempts: DataFrame, kind: str) -> DataFrame:
    """Which way of resolving each draft's gaps is taken: (draft_id, taken).

    attempts have the outcome of the ways that were tried (draft_id, way `patch` or `full`,
    outcome `parsed`, `unparsed` or `error`). The first one that is parsed is taken, a patch
    before a full regeneration, and else the heuristic. An error lets a graph fall through to
    the next way and ends a synthesis with `abort`, unless a way before it was parsed.
    """
    first = F.when(F.col("way") == "patch", 1).otherwise(2)
    by = attempts.groupBy("draft_id").agg(F.min(F.when(F.col("outcome") == "parsed", first)).alias("good"), F.min(F.when(F.col("outcome") == "error", first)).alias("bad"))
    aborts = (F.col("bad") < F.coalesce("good", F.lit(3))) if kind == "synthesis" else F.lit(False)
    return by.select("draft_id", F.when(aborts, "abort").when(F.col("good") == 1, "patch").when(F.col("good") == 2, "full").otherwise("heuristic").alias("taken"))


def unverified(nodes: DataFrame) -> DataFrame:
    """Nodes that a draft lists as not verified, with the start of their claim; absent quotes are not among them."""
    return nodes.filter(F.col("status").isin("failed", "unverified")).select("graph_id", "node_id", F.substring("claim", 1, UNVERIFIED_CHARS).alias("claim"))


def drafted(extractions: DataFrame) -> DataFrame:
    """Of each question's extractions (question_id, expert_id, ok): how many count, how many failed and are skipped, and whether references between graphs are to be resolved, which takes two."""
    counted = extractions.groupBy("question_id").agg(F.count_if("ok").alias("n_graphs"), F.count_if(~F.col("ok")).alias("n_failed"))
    return counted.withColumn("resolves", F.col("n_graphs") > 1)


def fan_in(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes by expert and edges by relation: (kind, name, n)."""
    experts = nodes.groupBy(F.col("expert_id").alias("name")).agg(F.count("*").alias("n")).select(F.lit("expert").alias("kind"), "name", "n")
    return experts.unionByName(edges.groupBy(F.col("relation").alias("name")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("kind"), "name", "n"))


def seeds(found: DataFrame, most: int = SEEDS) -> DataFrame:
    """The most cited papers of each question's search results (question_id, search, rank, paper_id, citation_count); equal ones as they came."""
    once = first_seen(found, ["question_id", "paper_id"], "search", "rank")
    order = Window.partitionBy("question_id").orderBy(F.desc("citation_count"), "search", "rank")
    return once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).drop("r")


def cached(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads that the cache has, keys to fetch)."""
    keys = wanted.select("cache_key").distinct()
    return keys.join(cache, "cache_key"), keys.join(cache.select("cache_key"), "cache_key", "left_anti")


def frontier(start: DataFrame, edges: DataFrame, papers: DataFrame, anchor: DataFrame, depth: int = 2, best: int = LEVEL_BEST, least: float = LEVEL_LEAST, per_edge: int = PER_EDGE) -> DataFrame:
    """Papers reached from seeds (seed, paper_id): (seed, paper_id, level, relevance).

    A level takes the neighbours of the last one, references before citations, at most per_edge
    of a paper and kind (edges: src, dst, kind, edge_ord); of those not visited it keeps the
    `best` with a cosine of `least` or more to the seed's anchor vector (seed, anchor). Each
    level is checkpointed, so lineage does not grow and lost executors lose nothing.
    """
    limited = edges.withColumn("_r", F.row_number().over(Window.partitionBy("src", "kind").orderBy("edge_ord"))).filter(F.col("_r") <= per_edge)
    visited = start.select("seed", "paper_id", F.lit(0).alias("level"), F.lit(1.0).alias("relevance"))
    last = visited
    for level in range(1, depth + 1):
        near = last.select("seed", F.col("paper_id").alias("src")).join(limited, "src").select("seed", F.col("dst").alias("paper_id")).filter(~blank(F.col("paper_id").cast("string"))).distinct()
        new = near.join(visited.select("seed", "paper_id"), ["seed", "paper_id"], "left_anti").join(papers.select("paper_id", "embedding"), "paper_id").join(anchor, "seed")
        scored = new.withColumn("relevance", cosine(F.col("embedding"), F.col("anchor"))).filter(F.col("relevance") >= least)
        order = Window.partitionBy("seed").orderBy(F.desc("relevance"), "paper_id")
        last = scored.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= best).select("seed", "paper_id", F.lit(level).alias("level"), "relevance")
        last = settled(last)
        visited = visited.unionByName(last)
    return visited
