"""Corpus tables: upserts, caches, deletes, backfills, credibility, panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, strip
from .retrieval import first_seen

PAPER_COLUMNS = ["source", "arxiv_id", "doi", "s2_paper_id", "title", "abstract", "url", "year", "authors", "citation_count", "fetched_at"]


def upserted(log: DataFrame) -> DataFrame:
    """The papers that a log of writes (paper_id, seq, PAPER_COLUMNS) leaves behind.

    Source and fetched_at are the last ones written; the other columns keep their last known
    value: what is not null, not blank (title, url, abstract), not an empty list (authors).
    The abstract is trimmed. A first write stands as it is.
    One aggregation: the last valid value is a maximum by sequence, merged on the map side.
    """
    known = {
        "arxiv_id": F.col("arxiv_id").isNotNull(), "doi": F.col("doi").isNotNull(), "s2_paper_id": F.col("s2_paper_id").isNotNull(),
        "title": F.trim("title") != "", "abstract": F.trim("abstract") != "", "url": F.trim("url") != "", "year": F.col("year").isNotNull(),
        "authors": F.col("authors").isNotNull() & ~F.trim("authors").isin("", "[]"), "citation_count": F.col("citation_count").isNotNull(),
    }

    def last(name: str) -> Column:
        if name not in known:
            return F.max_by(name, "seq").alias(name)
        found = F.max_by(F.when(known[name], F.col(name)), F.when(known[name], F.col("seq")))
        return F.coalesce(found, F.min_by(name, "seq")).alias(name)

    out = log.groupBy("paper_id").agg(F.max("seq").alias("seq"), F.min("seq").alias("_first"), *(last(c) for c in PAPER_COLUMNS if c in log.columns))
    return out.drop("_first")


def with_credibility(papers: DataFrame, signals: DataFrame) -> DataFrame:
    """papers with known signals (paper_id, new_citations, new_influential, new_venue) put in; an influential count of 0 is unknown."""
    joined = papers.join(signals, "paper_id", "left")
    return joined.withColumns({
        "citation_count": F.coalesce("new_citations", "citation_count"),
        "influential_count": F.coalesce(F.nullif(F.col("new_influential"), F.lit(0)), "influential_count"),
        "venue": F.coalesce(F.nullif(F.trim("new_venue"), F.lit("")), "venue"),
    }).drop("new_citations", "new_influential", "new_venue")


def with_status(papers: DataFrame, changes: DataFrame) -> DataFrame:
    """papers with the last status and the last URL that changes (paper_id, ord, status, url) set; nulls set nothing, and unknown papers stay unknown."""
    last = changes.groupBy("paper_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"_{c}") for c in ("status", "url")])
    out = papers.join(last, "paper_id", "left")
    return out.withColumns({"fulltext_status": F.coalesce("_status", "fulltext_status"), "open_access_pdf_url": F.coalesce("_url", "open_access_pdf_url")}).drop("_status", "_url")


#: Columns of papers that older tables lack: type and default.
ADDED = {"fulltext_status": ("string", "none"), "open_access_pdf_url": ("string", None), "influential_citation_count": ("int", None), "venue": ("string", None)}


def migrated(papers: DataFrame) -> DataFrame:
    """papers with the columns that they lack, at their defaults; as they are if they lack none."""
    return papers.withColumns({c: F.lit(default).cast(kind) for c, (kind, default) in ADDED.items() if c not in papers.columns})


def seeds_resolved(seeds: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(papers of the seeds (ord, seed), one for each source_id, the first; failures): found has a row (seed, source_id) or (seed, error) for each seed that was looked up."""
    asked = seeds.select("ord", strip(F.col("seed")).alias("seed")).filter("seed <> ''")
    looked = asked.join(found, "seed", "left")
    hits = looked.filter("source_id is not null").groupBy("source_id").agg(F.min_by("seed", "ord").alias("seed"), F.min("ord").alias("ord"))
    failed = looked.filter("source_id is null").select("ord", F.concat("seed", F.lit(": "), F.coalesce("error", F.lit("not found"))).alias("failure"))
    return hits, failed


def last_written(log: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Put: the last row of each key."""
    return first_seen(log, keys, *(F.desc(c) for c in order))


def without_sources(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """chunks of sources that are not deleted (source_type, source_id)."""
    return chunks.join(gone.select("source_type", "source_id").distinct(), ["source_type", "source_id"], "left_anti")


def not_ingested(candidates: DataFrame, papers: DataFrame) -> DataFrame:
    return candidates.join(papers.select("paper_id"), "paper_id", "left_anti")


def source_of(node_id: Column) -> Column:
    """An id cut before its first `_c`."""
    return F.substring_index(node_id, "_c", 1)


def quote_key(quote: Column) -> Column:
    """Trimmed, lower-cased, the first 200 characters."""
    return F.substring(F.lower(strip(quote)), 1, 200)


def bibliography(entries: DataFrame) -> DataFrame:
    """The first entry of each (run_id, source, expert, quote) by step and ordinal, ids and quotes normalised."""
    named = entries.withColumns({"source_id": source_of(F.col("source_id")), "expert_id": source_of(F.col("expert_id")), "quote_key": quote_key(F.coalesce("quote_raw", F.lit("")))})
    return first_seen(named, ["run_id", "source_id", "expert_id", "quote_key"], "step", "ord")


def vectors_replaced(log: DataFrame, dimensions: int) -> DataFrame:
    """The last vector of each (source_type, source_id, chunk_index); one of a wrong length fails the query."""
    right = F.when(F.size("embedding") == dimensions, F.col("embedding")).otherwise(F.raise_error(F.format_string(f"vector of %d, not {dimensions}, dimensions", F.size("embedding"))))
    return last_written(log.withColumn("embedding", right), ["source_type", "source_id", "chunk_index"], "seq")


def lookup_id() -> Column:
    """The id by which a paper's signals are looked up: the arXiv id of arXiv papers, else the S2 id."""
    return F.when(F.col("source") == "arxiv", F.col("arxiv_id")).otherwise(F.col("s2_paper_id"))


def backfill_targets(papers: DataFrame) -> DataFrame:
    """(paper_id, lookup_id) of papers without an influential count that can be looked up."""
    return papers.withColumn("lookup_id", lookup_id()).filter(F.col("influential_count").isNull() & ~blank(F.col("lookup_id"))).select("paper_id", "lookup_id")


def author_batches(papers: DataFrame, size: int = 50) -> DataFrame:
    """arXiv papers without authors, in numbered batches; batches are dealt by hash, so they hold about `size` papers and need no global sort."""
    missing = papers.filter((F.col("source") == "arxiv") & (F.col("authors").isNull() | F.trim("authors").isin("", "[]")))
    order = Window.partitionBy("shard").orderBy("paper_id")
    sharded = missing.withColumn("shard", F.pmod(F.crc32(F.col("paper_id").cast("string")), F.lit(64)).cast("int"))
    return sharded.withColumn("batch", ((F.row_number().over(order) - 1) / size).cast("int")).select("paper_id", "shard", "batch")


def signal_coverage(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNotNull()).alias(f"with_{c}") for c in ("citation_count", "influential_count", "venue")))


def tier(citations: Column, influential: Column, venue: Column) -> Column:
    """Credibility by citations, influential citations and venue."""
    has_venue = ~blank(venue)
    c, i = F.coalesce(citations, F.lit(0)), F.coalesce(influential, F.lit(0))
    return (
        F.when(citations.isNull() & influential.isNull() & ~has_venue, "Unknown")
        .when((i >= 5) | (c >= 50), "High").when(has_venue | (c >= 5) | (i >= 1), "Moderate").otherwise("Low")
    )


def tier_rank(name: Column) -> Column:
    """Unknown < Low < Moderate < High."""
    return F.array_position(F.array(*map(F.lit, ("Unknown", "Low", "Moderate", "High"))), name).cast("int") - 1


def panel(hits: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """A response for each source of hits (source_id, position, title, content): its chunks in order, else the hit's content; its paper's metadata and tier.

    Chunks (paper_id, chunk_index, section, content) get their section as a heading. An empty
    source_id fails the query. A document's chunks are gathered in one row, as its text is.
    """
    named = hits.withColumn("source_id", F.when(F.col("source_id") == "", F.raise_error(F.lit("hit without a source id"))).otherwise(F.col("source_id")))
    first = first_seen(named, ["source_id"], "position")
    heading = F.when(~blank(F.col("section")), F.concat(F.lit("## "), "section", F.lit("\n\n"))).otherwise("")
    piece = F.struct("chunk_index", F.concat(heading, F.coalesce("content", F.lit(""))).alias("text"))
    prose = chunks.filter(~blank(F.col("content"))).groupBy(F.col("paper_id").alias("source_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "\n\n").alias("prose"))
    meta = papers.select(F.col("paper_id").alias("source_id"), F.col("title").alias("paper_title"), "year", "authors", tier(F.col("citation_count"), F.col("influential_count"), F.col("venue")).alias("_tier"))
    out = first.join(prose, "source_id", "left").join(meta, "source_id", "left")
    return out.select("source_id", "position", F.when(blank(F.col("prose")), F.col("content")).otherwise(F.col("prose")).alias("prose"), F.coalesce("paper_title", "title").alias("title"), "year", "authors", F.coalesce("_tier", F.lit("Unknown")).alias("tier"))


def conservation(before: DataFrame, after: DataFrame, key: str = "source_id") -> DataFrame:
    """One row: distinct sources before and after, rows after, and the verdict: ok, lost or duplicated."""
    a = before.agg(F.count_distinct(key).alias("n_before"))
    b = after.agg(F.count_distinct(key).alias("n_after"), F.count("*").alias("n_rows"))
    verdict = F.when(F.col("n_after") < F.col("n_before"), "lost").when(F.col("n_rows") > F.col("n_after"), "duplicated").otherwise("ok")
    return a.crossJoin(b).withColumn("verdict", verdict)  # one row each


def refreshed(ids: DataFrame, most: int = 30) -> DataFrame:
    """The first `most` ids (source_id, position) that are not blank."""
    return ids.filter(~blank(F.col("source_id"))).orderBy("position").limit(most)


def seed_kind(seed: Column) -> Column:
    """arxiv, doi, s2 or corpus by prefix (in any case), then by shape; else s2."""
    s = strip(seed)
    low = F.lower(s)
    return (
        F.when(low.startswith("arxiv:"), "arxiv").when(low.startswith("doi:"), "doi").when(low.startswith("s2:"), "s2").when(low.startswith("corpusid:"), "corpus")
        .when(s.rlike(r"^10\.[^/]*/"), "doi").when(s.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$"), "arxiv").otherwise("s2")
    )


def bare_arxiv_id(text: Column) -> Column:
    """An arXiv id without the abstract page's URL and the version."""
    return F.regexp_replace(F.regexp_replace(text, r"^(https?://arxiv\.org/abs/)+", ""), r"v[0-9]+$", "")


def api_id(paper_id: Column) -> Column:
    """`S2:` stripped; `ARXIV:` ids as they are; numbers with a dot as `ARXIV:` without their version; others as they are."""
    base = F.regexp_replace(paper_id, r"v[0-9]+$", "")
    return F.when(paper_id.startswith("S2:"), F.substring(paper_id, 4, 1 << 30)).when(paper_id.startswith("ARXIV:"), paper_id).when(base.rlike(r"^[0-9.]*\.[0-9.]*$"), F.concat(F.lit("ARXIV:"), base)).otherwise(paper_id)


def fulltext_status(status: Column, chunks: Column, branch: Column) -> Column:
    """The next status: indexed stays; a PDF without chunks failed; all else is indexed."""
    return F.when(status == "indexed", "indexed").when((branch == "pdf") & (chunks == 0), "failed").otherwise("indexed")


def intake(rows: DataFrame) -> DataFrame:
    """arXiv or S2 rows (source, external_id, title, abstract, published) as papers and their embedding text."""
    return rows.select(
        F.concat_ws(":", F.when(F.col("source") == "arxiv", "arxiv").otherwise("s2"), "external_id").alias("paper_id"), "source", "title", "abstract",
        F.expr("try_cast(split_part(published, '-', 1) AS int)").alias("year"), F.substring("abstract", 1, 200).alias("preview"),
        F.concat_ws("\n", "title", F.lit("abstract"), "abstract").alias("embed_text"),
    )
