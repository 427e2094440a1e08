"""Queries over vectors, lanes, corpus tables and panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import corpus, retrieval, vector_index
from .base import query

DISTANCE = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE)) * (CAST(q.embedding[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE)))))"
COSINE = (
    "list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(e.embedding[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(range(1, 65), "
    "lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE)))) * sqrt(list_sum(list_transform(range(1, 65), "
    "lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(e.embedding[i] AS DOUBLE)))))"
)
MET = f"met AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.label, {DISTANCE} AS d FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)"


def vector_queries(t):
    return t("embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def vector_chunks(t):
    return t("embeddings").withColumnRenamed("vec_id", "chunk_id")


def knn_columns(df):
    return df.select("query_id", "chunk_id", "rank", "distance", "similarity")


@query("knn_l2_topk", (
    f"WITH {MET}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM met) SELECT query_id, chunk_id, rank, "
    f"round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity FROM r WHERE rank <= 10"
))
def knn_l2_topk(t):
    return knn_columns(retrieval.nearest(vector_queries(t), vector_chunks(t), 10))


@query("knn_pivot_index", (
    f"WITH {MET}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM met) SELECT query_id, chunk_id, rank, "
    f"round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity FROM r WHERE rank <= 10"
))
def knn_pivot_index(t):
    index = vector_index.build(vector_chunks(t), 64, pivots=64, rows=64)
    return vector_index.search(index, vector_queries(t), 10).select("query_id", F.col("id").alias("chunk_id"), "rank", "distance", "similarity")


@query("knn_filtered_exact", (
    f"WITH {MET}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM met WHERE label = 1) SELECT query_id, "
    f"chunk_id, rank, round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity FROM r WHERE rank <= 5"
))
def knn_filtered_exact(t):
    return knn_columns(retrieval.nearest(vector_queries(t), vector_chunks(t), 5, F.col("label") == 1))


@query("knn_filtered_overfetch", (
    f"WITH {MET}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS n FROM met), k AS (SELECT *, "
    f"row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM r WHERE n <= 15 AND label = 1) SELECT query_id, chunk_id, rank, "
    f"round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity FROM k WHERE rank <= 5"
))
def knn_filtered_overfetch(t):
    return knn_columns(retrieval.nearest(vector_queries(t), vector_chunks(t), 5, F.col("label") == 1, mode="overfetch"))


@query("cosine_rank", (
    f"WITH met AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {COSINE} AS c FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q "
    f"WHERE e.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM met WHERE c >= 0.3) "
    f"SELECT query_id, id, round(c, 6) AS relevance, rank FROM r WHERE rank <= 10"
))
def cosine_rank(t):
    chunks = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.nearest(vector_queries(t), chunks, 10, id_column="id", metric="cosine", least=0.3, apart=(("query_id", "id"),)).select("query_id", "id", "relevance", "rank")


FUSED = """, s AS (SELECT query_id, source_type, source_id, sum(1.0 / (60.0 + rank)) AS score, min(lane * 1000 + rank) AS f, arg_min(title, lane * 1000 + rank) AS title FROM lanes GROUP BY ALL),
fused AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, f) AS position FROM s)"""


def fused_lanes(t):
    return retrieval.fused(t("lanes"))


@query("rrf_three_lane", FUSED + " SELECT query_id, source_type, source_id, title, round(relevance, 6) AS relevance FROM fused", "lanes")
def rrf_three_lane(t):
    return fused_lanes(t).select("query_id", "source_type", "source_id", "title", "relevance")


@query("rrf_lane_repeats", (
    ", n AS (SELECT query_id, source_type, source_id, lane, count(*) AS n, sum(1.0 / (60.0 + rank)) AS score FROM lanes GROUP BY ALL) SELECT query_id, "
    "source_type, source_id, CAST(lane AS BIGINT) AS lane, n, round(score, 6) AS score FROM n WHERE n > 1"
), "lanes")
def rrf_lane_repeats(t):
    return t("lanes").groupBy("query_id", "source_type", "source_id", "lane").agg(F.count("*").alias("n"), F.sum(1.0 / (F.lit(60.0) + F.col("rank"))).alias("score")).filter("n > 1")


QUALITY = """, q AS (SELECT query_id, count(*) AS n_hits, min(CAST(relevance AS DOUBLE)) AS lo, avg(CAST(relevance AS DOUBLE)) AS me, count(DISTINCT source_id) AS u FROM {hits} GROUP BY query_id),
c AS (SELECT query_id, max(n) AS m FROM (SELECT query_id, source_id, count(*) AS n FROM {hits} GROUP BY ALL) GROUP BY query_id),
r AS (SELECT q.*, m / n_hits AS sh, CAST(lo AS FLOAT) < CAST(0.3 AS FLOAT) AS b1, CAST(me AS FLOAT) < CAST(0.48 AS FLOAT) AS b2, n_hits >= 3 AND CAST(m / n_hits AS FLOAT) > CAST(0.6 AS FLOAT) AS b3, n_hits >= 3 AND u < 3 AS b4 FROM q JOIN c USING (query_id))"""
REASON = (
    "CASE WHEN NOT (b1 OR b2 OR b3 OR b4) THEN NULL ELSE concat_ws('; ', CASE "
    "WHEN b1 THEN format('min relevance {:.2f} below 0.30', CAST(CAST(lo AS FLOAT) AS DOUBLE)) END, CASE "
    "WHEN b2 THEN format('mean relevance {:.2f} below 0.48', CAST(CAST(me AS FLOAT) AS DOUBLE)) END, CASE "
    "WHEN b3 THEN format('source concentration {:.2f} above 0.60', CAST(CAST(sh AS FLOAT) AS DOUBLE)) END, CASE "
    "WHEN b4 THEN format('only {} unique sources, need 3', u) END) END"
)


@query("quality_report", QUALITY.format(hits="hits") + (
    " SELECT query_id, n_hits, round(lo, 6) AS min_relevance, round(me, 6) AS mean_relevance, round(sh, 6) AS max_concentration, "
    "u AS unique_sources, NOT (b1 OR b2 OR b3 OR b4) AS passed FROM r"
), "hits")
def quality_report(t):
    return retrieval.quality(t("hits")).drop("reason")


@query("quality_reasons", QUALITY.format(hits="hits") + f" SELECT query_id, {REASON} AS reason FROM r", "hits")
def quality_reasons(t):
    return retrieval.quality(t("hits")).select("query_id", "reason")


@query("gate_floor", (
    ", k AS (SELECT * FROM hits WHERE CAST(relevance AS FLOAT) >= CAST(0.3 AS FLOAT)) SELECT query_id, count(*) AS n_before, (SELECT count(*) FROM k "
    "WHERE k.query_id = h.query_id) AS n_hits FROM hits h GROUP BY query_id"
), "hits")
def gate_floor(t):
    return retrieval.gated(t("hits"), t("hits").select("query_id").distinct())[1].select("query_id", "n_before", "n_hits")


@query("rerank_apply", FUSED + (
    ", x AS (SELECT *, CASE WHEN position % 4 <> 3 THEN ((position * 7) % 10) / 10.0 END AS rs FROM fused), k AS (SELECT *, "
    "row_number() OVER (PARTITION BY query_id ORDER BY rs DESC NULLS LAST, position) AS np FROM x WHERE rs >= 0.3 OR rs IS NULL) SELECT query_id, "
    "source_type, source_id, np AS new_position FROM k"
), "lanes")
def rerank_apply(t):
    hits = retrieval.fused(t("lanes")).withColumn("score", F.round("score", 12))
    hits = hits.withColumn("position", F.col("position").cast("int"))
    scores = hits.filter("position % 4 <> 3").select("query_id", "position", (((F.col("position") * 7) % 10) / 10.0).alias("rerank_score"))
    return retrieval.reranked(hits, scores, 0.3).select("query_id", "source_type", "source_id", "new_position")


@query("s2_lane_relevance", (
    " SELECT doc_id, lang AS query_id, round(coalesce(least(1.0, greatest(0.0, c / greatest(max(c) OVER (PARTITION BY lang), 1))), 0.3), 6) AS relevance, "
    "CASE WHEN a IS NOT NULL THEN concat('arxiv:', a) ELSE concat('s2:', doc_id) END AS canonical_id FROM (SELECT d.doc_id, d.lang, p.citation_count AS c, "
    "p.arxiv_id AS a FROM documents d JOIN papers p USING (doc_id))"
), "papers")
def s2_lane_relevance(t):
    hits = t("papers").join(t("documents").select("doc_id", F.col("lang").alias("query_id")), "doc_id").withColumn("s2_id", F.col("doc_id").cast("string"))
    return retrieval.citation_relevance(hits).select("doc_id", "query_id", "relevance", "canonical_id")


@query("topicality_keep", (
    ", h AS (SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, source_id) AS position, "
    "count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT DISTINCT * FROM hits)), k AS (SELECT *, query_id % 2 = 0 AND position IN (1, 3) AS keep "
    "FROM h), s AS (SELECT *, max(CAST(keep AS INT)) OVER (PARTITION BY query_id) AS any_kept FROM k) SELECT query_id, source_id, position FROM s "
    "WHERE n < 2 OR any_kept = 0 OR keep"
), "hits")
def topicality_keep(t):
    hits = t("hits").distinct().withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "source_id")).cast("long"))
    replies = hits.select("query_id").distinct().withColumn("reply", F.when(F.col("query_id") % 2 == 0, "keep 0 and 2, not more").otherwise("none of them"))
    return retrieval.topical(hits, replies).select("query_id", "source_id", "position")


@query("query_decomposition", (
    " SELECT c_custkey AS query_id, 1 AS n, lower(c_mktsegment) AS text FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 2, "
    "concat('about ', c_name) FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 1, c_name FROM customer WHERE c_custkey % 3 = 0"
))
def query_decomposition(t):
    reply = F.when(F.col("c_custkey") % 3 == 0, F.lit("- one two three four five six seven eight nine")).otherwise(F.concat(F.lit("1. "), F.lower("c_mktsegment"), F.lit("\n- \""), F.lit("about "), F.col("c_name"), F.lit('"\n* '), F.upper("c_mktsegment")))
    return retrieval.subqueries(t("customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("question"), reply.alias("reply")))


def known(column: str, good: str) -> str:
    return f"coalesce(arg_max({column}, seq) FILTER (WHERE {good}), arg_min_null({column}, seq)) AS {column}"


@query("upsert_fold_papers", ", f AS (SELECT paper_id, " + ", ".join(known(c, g) for c, g in (("arxiv_id", "arxiv_id IS NOT NULL"), ("doi", "doi IS NOT NULL"), ("s2_paper_id", "s2_paper_id IS NOT NULL"), ("title", "trim(title) <> ''"), ("abstract", "trim(abstract) <> ''"), ("url", "trim(url) <> ''"), ("year", "year IS NOT NULL"), ("authors", "authors IS NOT NULL AND trim(authors) NOT IN ('', '[]')"), ("citation_count", "citation_count IS NOT NULL"))) + ", arg_max(source, seq) AS source, arg_max(fetched_at, seq) AS fetched_at FROM log GROUP BY paper_id) SELECT * FROM f", "log")
def upsert_fold_papers(t):
    return corpus.upserted(t("log")).drop("seq")


@query("update_credibility", (
    " SELECT paper_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN doc_id % 77 END, citation_count) AS citation_count, coalesce(CASE "
    "WHEN doc_id % 5 <> 0 THEN nullif(doc_id % 3, 0) END, influential_count) AS influential_count, coalesce(CASE WHEN doc_id % 4 = 1 THEN 'V' END, "
    "venue) AS venue FROM papers"
), "papers")
def update_credibility(t):
    p = t("papers")
    signals = p.select("paper_id", F.expr("CASE WHEN doc_id % 2 = 0 THEN doc_id % 77 END").alias("new_citations"), F.expr("CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 END").alias("new_influential"), F.expr("CASE WHEN doc_id % 4 = 1 THEN ' V ' ELSE ' ' END").alias("new_venue"))
    return corpus.with_credibility(p, signals).select("paper_id", "citation_count", "influential_count", "venue")


@query("insert_or_ignore_bib", (
    " SELECT run_id, source_id, expert_id, quote_key FROM (SELECT o_custkey AS run_id, concat('n', o_orderkey % 4) AS source_id, concat('e', "
    "o_orderkey % 2) AS expert_id, lower(o_orderpriority) AS quote_key FROM orders) GROUP BY ALL"
))
def insert_or_ignore_bib(t):
    e = t("orders").select(F.col("o_custkey").alias("run_id"), F.expr("concat('n', o_orderkey % 4, '_c00', o_orderkey % 3)").alias("source_id"), F.expr("concat('e', o_orderkey % 2)").alias("expert_id"), F.expr("concat(' ', o_orderpriority, ' ')").alias("quote_raw"), F.lit(1).alias("step"), F.col("o_orderkey").alias("ord"))
    return corpus.bibliography(e).select("run_id", "source_id", "expert_id", "quote_key")


CACHE = " SELECT user_id AS cache_key, {f}(value, epoch_us(ts) * 100000 + event_id) AS value FROM events GROUP BY user_id"


@query("cache_put_if_absent", " SELECT user_id AS cache_key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def cache_put_if_absent(t):
    return retrieval.first_seen(t("events"), ["user_id"], "ts", "event_id").select(F.col("user_id").alias("cache_key"), "event_id")


@query("cache_replace", " SELECT user_id AS cache_key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def cache_replace(t):
    return corpus.last_written(t("events"), ["user_id"], "ts", "event_id").select(F.col("user_id").alias("cache_key"), "event_id")


@query("delete_by_source", " SELECT label, count(*) AS n FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = e.vec_id) GROUP BY label")
def delete_by_source(t):
    chunks = t("embeddings").select("label", F.lit("doc").alias("source_type"), F.col("vec_id").alias("source_id"))
    gone = t("labels").filter("toxic = 1").select(F.lit("doc").alias("source_type"), F.col("doc_id").alias("source_id"))
    return corpus.without_sources(chunks, gone).groupBy("label").agg(F.count("*").alias("n"))


@query("skip_if_ingested", " SELECT doc_id AS paper_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_if_ingested(t):
    return corpus.not_ingested(t("documents").select(F.col("doc_id").alias("paper_id")), t("labels").select(F.col("doc_id").alias("paper_id")).distinct())


@query("vector_upsert", (
    " SELECT concat('s', o_custkey) AS source_id, o_orderkey AS seq FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey "
    "ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1"
))
def vector_upsert(t):
    log = t("orders").select(F.lit("doc").alias("source_type"), F.expr("concat('s', o_custkey)").alias("source_id"), F.lit(0).alias("chunk_index"), F.col("o_orderkey").alias("seq"), F.array(F.col("o_totalprice").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    return corpus.vectors_replaced(log, 2).select("source_id", "seq")


@query("backfill_targets", (
    " SELECT paper_id, l AS lookup_id FROM (SELECT *, CASE WHEN source = 'arxiv' THEN arxiv_id ELSE s2_paper_id END AS l FROM papers) "
    "WHERE influential_count IS NULL AND l IS NOT NULL"
), "papers")
def backfill_targets(t):
    return corpus.backfill_targets(t("papers"))


@query("backfill_authors", " SELECT count(*) AS n FROM papers WHERE source = 'arxiv' AND (authors IS NULL OR trim(authors) IN ('', '[]'))", "papers")
def backfill_authors(t):
    return corpus.author_batches(t("papers")).agg(F.count("*").alias("n"))


@query("signal_coverage", " SELECT count(*) AS n, count(citation_count) AS with_citation_count, count(influential_count) AS with_influential_count, count(venue) AS with_venue FROM papers", "papers")
def signal_coverage(t):
    return corpus.signal_coverage(t("papers"))


TIER = (
    "CASE WHEN citation_count IS NULL AND influential_count IS NULL AND (venue IS NULL OR trim(venue) = '') THEN 'Unknown' WHEN "
    "coalesce(influential_count, 0) >= 5 OR coalesce(citation_count, 0) >= 50 THEN 'High' WHEN coalesce(trim(venue), '') <> '' OR "
    "coalesce(citation_count, 0) >= 5 OR coalesce(influential_count, 0) >= 1 THEN 'Moderate' ELSE 'Low' END"
)


@query("credibility_tier", f" SELECT paper_id, {TIER} AS tier FROM papers", "papers")
def credibility_tier(t):
    return t("papers").select("paper_id", corpus.tier(F.col("citation_count"), F.col("influential_count"), F.col("venue")).alias("tier"))


@query("tier_counts", f" SELECT tier, list_position(['Unknown', 'Low', 'Moderate', 'High'], tier) - 1 AS tier_rank, count(*) AS n FROM (SELECT {TIER} AS tier FROM papers) GROUP BY tier", "papers")
def tier_counts(t):
    return credibility_tier(t).groupBy("tier").agg(F.count("*").alias("n")).select("tier", corpus.tier_rank(F.col("tier")).alias("tier_rank"), "n")


PANEL = f""", h AS (SELECT doc AS conv, concat('d', doc) AS source_id, min(pos) AS position FROM drafts GROUP BY doc),
p AS (SELECT doc, string_agg(CASE WHEN trim(role) <> '' THEN '## ' || role || chr(10) || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY pos) AS prose FROM drafts WHERE doc % 5 <> 0 AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY doc),
m AS (SELECT doc_id AS conv, title, {TIER} AS tier FROM papers)
SELECT source_id, coalesce(prose, 'fallback ' || h.conv) AS prose, coalesce(title, 'T') AS title, coalesce(tier, 'Unknown') AS tier FROM h LEFT JOIN p ON h.conv = p.doc LEFT JOIN m ON m.conv = h.conv"""


@query("panel_assembly", PANEL, "drafts", "papers")
def panel_assembly(t):
    d = t("drafts")
    hits = d.select(F.expr("concat('d', doc)").alias("source_id"), F.col("pos").alias("position"), F.lit("T").alias("title"), F.expr("concat('fallback ', doc)").alias("content"))
    chunks = d.filter("doc % 5 <> 0").select(F.expr("concat('d', doc)").alias("paper_id"), F.col("pos").alias("chunk_index"), F.col("role").alias("section"), F.col("text").alias("content"))
    papers = t("papers").select(F.expr("concat('d', doc_id)").alias("paper_id"), "title", "year", "authors", "citation_count", "influential_count", "venue")
    return corpus.panel(hits, chunks, papers).select("source_id", "prose", "title", "tier")


@query("conservation_counts", (
    " SELECT count(DISTINCT doc) AS n_before, count(DISTINCT doc) FILTER (WHERE doc % 7 <> 0) AS n_after, "
    "count(DISTINCT doc) FILTER (WHERE doc % 7 <> 0) AS n_rows, 'lost' AS verdict FROM drafts"
), "drafts")
def conservation_counts(t):
    before = t("drafts").select(F.col("doc").alias("source_id"))
    return corpus.conservation(before, before.filter("source_id % 7 <> 0").distinct())


@query("fulltext_coverage", " SELECT count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS with_fulltext FROM documents")
def fulltext_coverage(t):
    have = t("labels").select("doc_id", F.lit(True).alias("have")).distinct()
    return t("documents").join(have, "doc_id", "left").agg(F.count("*").alias("n"), F.count_if("have").alias("with_fulltext"))


@query("seed_id_classify", " SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'doi' WHEN 2 THEN 'doi' WHEN 3 THEN 'arxiv' WHEN 4 THEN 'corpus' ELSE 's2' END AS kind FROM documents")
def seed_id_classify(t):
    # an arXiv id has four or five digits after its month, whatever the doc_id
    seed = F.expr((
        "CASE doc_id % 6 WHEN 0 THEN concat('ArXiv:', doc_id) WHEN 1 THEN concat('10.1000/x', doc_id) WHEN 2 THEN concat(' DOI:', doc_id) WHEN 3 THEN "
        "concat('2101.', 10000 + doc_id % 90000, 'v2') WHEN 4 THEN concat('CorpusID:', doc_id) ELSE concat('ab', doc_id) END"
    ))
    return t("documents").select("doc_id", corpus.seed_kind(seed).alias("kind"))


@query("id_resolution", (
    " SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('ARXIV:2101.', 10000 + doc_id) WHEN 1 THEN concat('x', doc_id) ELSE "
    "concat('ARXIV:2101.', 10000 + doc_id) END AS api_id, concat('2101.', 10000 + doc_id) AS bare FROM documents"
))
def id_resolution(t):
    paper = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('2101.', 10000 + doc_id, 'v3') WHEN 1 THEN concat('S2:x', doc_id) ELSE concat('ARXIV:2101.', 10000 + doc_id) END")
    return t("documents").select("doc_id", corpus.api_id(paper).alias("api_id"), corpus.bare_arxiv_id(F.expr("concat('http://arxiv.org/abs/2101.', 10000 + doc_id, 'v12')")).alias("bare"))


@query("fulltext_promotion", (
    " SELECT CASE WHEN doc_id % 4 = 0 THEN 'indexed' WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN 'failed' ELSE 'indexed' END AS status, count(*) AS n "
    "FROM documents GROUP BY 1"
))
def fulltext_promotion(t):
    d = t("documents").select(F.expr("CASE WHEN doc_id % 4 = 0 THEN 'indexed' ELSE 'pending' END").alias("status"), F.expr("doc_id % 3").alias("chunks"), F.expr("CASE WHEN doc_id % 2 = 1 THEN 'pdf' ELSE 'html' END").alias("branch"))
    return d.select(corpus.fulltext_status(F.col("status"), F.col("chunks"), F.col("branch")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("paper_intake", (
    " SELECT concat_ws(':', CASE WHEN source = 'arxiv' THEN 'arxiv' ELSE 's2' END, CAST(doc_id AS VARCHAR)) AS paper_id, 1990 + doc_id % 30 AS year, "
    "substr(text, 1, 200) AS preview FROM papers"
), "papers")
def paper_intake(t):
    p = t("papers").select("source", F.col("doc_id").cast("string").alias("external_id"), "title", F.col("text").alias("abstract"), F.expr("concat(1990 + doc_id % 30, '-01-02')").alias("published"))
    return corpus.intake(p).select("paper_id", "year", "preview")


@query("bibliography_count", " SELECT run_id, count(*) AS n FROM claims GROUP BY run_id", "claims")
def bibliography_count(t):
    return t("claims").groupBy("run_id").agg(F.count("*").alias("n"))


@query("retriever_dedup", " SELECT source_id, query_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY query_id, relevance DESC) AS r FROM hits) WHERE r = 1", "hits")
def retriever_dedup(t):
    return retrieval.first_seen(t("hits"), ["source_id"], "query_id", F.desc("relevance")).select("source_id", "query_id")


PIPELINE = f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, {DISTANCE} AS d FROM embeddings e, q WHERE e.vec_id <> q.vec_id),
c AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {COSINE} AS c FROM embeddings e, q WHERE e.vec_id <> q.vec_id AND e.label <> q.label),
l AS (SELECT * FROM (SELECT query_id, 0 AS lane, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank, id FROM d) WHERE rank <= 10
UNION ALL SELECT * FROM (SELECT query_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank, id FROM c) WHERE rank <= 10
UNION ALL SELECT * FROM (SELECT query_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank, id FROM d WHERE label = 1) WHERE rank <= 10),
s AS (SELECT query_id, id, sum(1.0 / (60.0 + rank)) AS score FROM l GROUP BY ALL), f AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS relevance FROM s)
SELECT query_id, id AS source_id, round(relevance, 6) AS relevance FROM f WHERE CAST(relevance AS FLOAT) >= CAST(0.3 AS FLOAT)"""


@query("retrieval_pipeline", PIPELINE)
def retrieval_pipeline(t):
    q = t("embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), F.col("embedding").alias("query_vector"))
    chunks = t("embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    other = ("query_id", "id")
    found = [
        retrieval.nearest(q, chunks, 10, id_column="id", apart=(other,)),
        retrieval.nearest(q, chunks, 10, id_column="id", metric="cosine", apart=(other, ("own", "label"))),
        retrieval.nearest(q, chunks, 10, F.col("label") == 1, id_column="id", apart=(other,)),
    ]
    lanes = [f.select("query_id", F.lit(n).alias("lane"), "rank", F.lit("vector").alias("source_type"), F.col("id").alias("source_id")) for n, f in enumerate(found)]
    return retrieval.gated(retrieval.fused(lanes[0].unionByName(lanes[1]).unionByName(lanes[2])), q.select("query_id"))[0].select("query_id", "source_id", "relevance")


@query("degraded_store", " SELECT vec_id AS query_id, 'degraded' AS status, 'vector store no_such_store is not available' AS reason FROM embeddings WHERE vec_id % 50 = 0")
def degraded_store(t):
    q = vector_queries(t)
    return retrieval.capability(q.sparkSession, "no_such_store", q)


@query("fulltext_status_set", """, c AS (SELECT concat(CASE doc_id % 3 WHEN 0 THEN 'arxiv:' WHEN 1 THEN 's2:' ELSE 'local:' END, doc_id) AS paper_id, quality, toxic FROM labels)
SELECT paper_id, coalesce(CASE WHEN quality = 1 THEN 'indexed' WHEN toxic = 1 THEN 'failed' END, 'none') AS fulltext_status, CASE WHEN toxic = 1 THEN concat('http://x/', paper_id) END AS open_access_pdf_url FROM papers LEFT JOIN c USING (paper_id)""", "papers")
def fulltext_status_set(t):
    labels = t("labels").select(F.expr("concat(CASE doc_id % 3 WHEN 0 THEN 'arxiv:' WHEN 1 THEN 's2:' ELSE 'local:' END, doc_id)").alias("paper_id"), "quality", "toxic")
    first = labels.select("paper_id", F.lit(1).alias("ord"), F.expr("IF(toxic = 1, 'failed', NULL)").alias("status"), F.expr("IF(toxic = 1, concat('http://x/', paper_id), NULL)").alias("url"))
    then = labels.filter("quality = 1").select("paper_id", F.lit(2).alias("ord"), F.lit("indexed").alias("status"), F.lit(None).cast("string").alias("url"))
    return corpus.with_status(corpus.migrated(t("papers").select("paper_id")), first.unionByName(then)).select("paper_id", "fulltext_status", "open_access_pdf_url")


@query("migrated_papers", " SELECT paper_id, venue, 'none' AS fulltext_status, CAST(NULL AS VARCHAR) AS open_access_pdf_url, CAST(NULL AS BIGINT) AS influential_citation_count FROM papers", "papers")
def migrated_papers(t):
    return corpus.migrated(t("papers").select("paper_id", "venue"))


SEEDS = """WITH s AS (SELECT o_orderkey AS ord, concat('seed', o_orderkey) AS seed, CASE WHEN o_orderkey % 7 > 1 THEN concat('arxiv:', o_orderkey % 1000) END AS f FROM orders)
SELECT f AS source_id, arg_min(seed, ord) AS seed, CAST(NULL AS VARCHAR) AS failure FROM s WHERE f IS NOT NULL GROUP BY f
UNION ALL SELECT NULL, NULL, concat(seed, CASE WHEN ord % 7 = 0 THEN ': not found' ELSE ': no answer' END) FROM s WHERE f IS NULL"""


@query("seed_resolve", SEEDS)
def seed_resolve(t):
    o = t("orders").select(F.col("o_orderkey").alias("ord"), F.expr("concat(' seed', o_orderkey, ' ')").alias("seed"), F.col("o_orderkey").alias("k"))
    found = o.filter("k % 7 <> 0").select(F.trim("seed").alias("seed"), F.expr("IF(k % 7 = 1, NULL, concat('arxiv:', k % 1000))").alias("source_id"), F.expr("IF(k % 7 = 1, 'no answer', NULL)").alias("error"))
    hits, failed = corpus.seeds_resolved(o.select("ord", "seed"), found)
    return hits.select("source_id", "seed", F.lit(None).cast("string").alias("failure")).unionByName(failed.select(F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("seed"), "failure"))
