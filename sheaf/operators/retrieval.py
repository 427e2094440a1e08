"""Vector search, fusion, quality gates and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..functions.vectors import cosine, similarity
from ..session import settled

RRF_K, FLOOR, MEAN_FLOOR, MAX_SHARE, MIN_SOURCES, OVERFETCH = 60, 0.3, 0.48, 0.6, 3, 3
#: Query vectors that are sent to the executors at once.
QUERY_BLOCK = 4096
#: What a task has in memory at once: chunks, pairs of a chunk and a query, vector components that are measured exactly, parts of its best rows.
ROWS, CELLS, VALUES, MOST_PARTS = 1 << 13, 1 << 20, 1 << 21, 1 << 10
#: Codes of null and of values that no query has.
NONE, OTHER = -2, -1
#: Types of ids that Arrow sorts as Spark does.
SORTED_ALIKE = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.StringType(), T.DateType(), T.TimestampType())


def nearest(queries: DataFrame, chunks: DataFrame, k: int, condition: Column | None = None, mode: str = "exact", id_column: str = "chunk_id", vector: str = "embedding", metric: str = "l2", least: float | None = None, apart: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """The k nearest chunks of every query (query_id, query_vector) with their rank: distance and similarity, or, of the metric `cosine`, relevance, of which `least` is the least.

    condition filters chunks. `exact` filters first; `overfetch` takes OVERFETCH * k first and
    filters these, as an index that filters afterwards does. apart are pairs of a query's and a
    chunk's columns that must differ, as ids where queries are chunks themselves.

    Queries are a stated set; they go to the executors in blocks of at most QUERY_BLOCK. With
    several blocks each is sent, used, settled and let go before the next, so the driver and a
    task hold one at a time. Each task keeps its k best for each query over all its chunks,
    found by matrix products of bounded size and measured exactly, so few rows are shuffled, and
    a task's memory depends on k and QUERY_BLOCK, not on how many chunks, or copies of one, it
    has. Vectors of another length than the query's, and of length zero by cosine, match nothing.
    """
    keep = F.lit(True) if condition is None else condition
    source = chunks.filter(keep) if mode == "exact" else chunks
    fetch = k * OVERFETCH if mode == "overfetch" and condition is not None else k
    score = "distance" if metric == "l2" else "relevance"
    order = Window.partitionBy("query_id").orderBy(F.col(score) if metric == "l2" else F.desc(score), id_column)
    place = source.columns.index(vector)
    schema = T.StructType([queries.schema["query_id"], *(f for i, f in enumerate(source.schema.fields) if i != place), T.StructField(score, T.DoubleType())])
    asked = queries.select("query_id", "query_vector", *[F.col(q).alias(f"_{i}") for i, (q, _) in enumerate(apart)])
    different = [source.columns.index(c) for _, c in apart]
    ids = source.columns.index(id_column) if source.schema[id_column].dataType in SORTED_ALIKE else None

    def ranked(block: pa.Table) -> DataFrame:
        part = source.mapInArrow(best_of_task(block, place, fetch, metric, least, different, ids), schema)
        return part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= fetch)

    first = asked.limit(QUERY_BLOCK + 1).toArrow()
    if first.num_rows <= QUERY_BLOCK:
        out = ranked(first)
    else:
        blocks = -(-asked.count() // QUERY_BLOCK)
        out = None
        for b in range(blocks):
            part = settled(ranked(asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()))
            out = part if out is None else out.unionByName(part)
    if fetch != k:
        out = out.filter(keep).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.withColumn("similarity", similarity(F.col("distance"))) if metric == "l2" else out


class Best:
    """The k least values of each query so far, equal ones in the order of their ids; where ids have no order that Arrow knows, ties with the last one stay."""

    def __init__(self, queries: int, k: int, ids: int | None, limit: float = np.inf):
        self.k, self.ids, self.limit = k, ids, np.full(queries, limit)
        self.which, self.value, self.rows = [], [], []
        self.n, self.most = 0, max(1 << 14, 4 * k * queries)

    def add(self, which: np.ndarray, value: np.ndarray, rows: pa.RecordBatch) -> None:
        self.which.append(which)
        self.value.append(value)
        self.rows.append(rows)
        self.n += len(which)
        if self.n > self.most or len(self.rows) > MOST_PARTS:
            self.prune()

    def prune(self) -> None:
        which, value, rows = np.concatenate(self.which), np.concatenate(self.value), pa.Table.from_batches(self.rows).combine_chunks()
        order, first = ordered(which, value, None if self.ids is None else rows.column(self.ids), len(self.limit))
        last = first[:-1] + self.k - 1
        full = last < first[1:]
        self.limit[full] = value[order[last[full]]]
        kept = np.sort(order[np.arange(len(order)) - first[which[order]] < self.k]) if self.ids is not None else np.flatnonzero(value <= self.limit[which])
        self.which, self.value, self.rows = [which[kept]], [value[kept]], rows.take(pa.array(kept)).combine_chunks().to_batches()
        self.n = len(kept)


def ordered(which: np.ndarray, value: np.ndarray, ids: pa.Array | pa.ChunkedArray | None, queries: int) -> tuple[np.ndarray, np.ndarray]:
    """(the order by query, value and id, each query's first place in it)."""
    place = np.zeros(len(which), np.int64)
    if ids is not None:
        place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(which))
    order = np.lexsort((place, value, which))
    return order, np.searchsorted(which[order], np.arange(queries + 1))


def coded(values: list, codes: dict) -> np.ndarray:
    """Each value's code; NONE for nulls, OTHER for values without one."""
    return np.array([NONE if v is None else codes.get(v, OTHER) for v in values], np.int64)


def measured(e: np.ndarray, q: np.ndarray, row: np.ndarray, which: np.ndarray, metric: str) -> np.ndarray:
    """The distance, or the negative cosine, of pairs of rows, some at a time."""
    out, step = np.empty(len(row)), max(1, VALUES // e.shape[1])
    for i in range(0, len(row), step):
        x, y = e[row[i : i + step]], q[which[i : i + step]]
        if metric == "l2":
            out[i : i + step] = np.sqrt(((x - y) ** 2).sum(axis=1))
        else:
            out[i : i + step] = -(x * y).sum(axis=1) / (np.sqrt((x**2).sum(axis=1)) * np.sqrt((y**2).sum(axis=1)))
    return out


def best_of_task(queries: pa.Table, place: int, k: int, metric: str, least: float | None, different: list[int], ids: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the task's k nearest rows of every query; ids is the place of the ids that part ties.

    All queries meet all rows, but only CELLS of these pairs at a time.
    """
    queries = queries.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(queries["query_vector"]), 0).to_numpy()
    names = queries.column("query_id").combine_chunks() if queries.num_rows else pa.array([], queries.schema.field("query_id").type)
    matrices = {}
    for n in sorted(set(lengths.tolist()) - {0}):
        at = np.flatnonzero(lengths == n)
        matrices[n] = at, pc.list_flatten(queries["query_vector"].take(pa.array(at))).to_numpy().reshape(-1, n).astype(np.float64)
    theirs = [queries[f"_{i}"].to_pylist() for i in range(len(different))]
    codes = [{v: i for i, v in enumerate({v for v in values if v is not None})} for values in theirs]
    not_these = [coded(values, c) for values, c in zip(theirs, codes, strict=True)]
    ids = None if ids is None else ids - (ids > place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(len(at), k, ids, np.inf if least is None else -least) for n, (at, _) in matrices.items()}
        rows = max(1, min(ROWS, VALUES // max(matrices, default=1)))
        schema = None
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                column = batch.column(place)
                lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
                rest = batch.select([i for i in range(batch.num_columns) if i != place])
                schema = rest.schema
                mine = [coded(batch.column(i).to_pylist(), c) for i, c in zip(different, codes, strict=True)]
                for n, (at, q) in matrices.items():
                    have = np.flatnonzero(lengths == n)
                    if not len(have):
                        continue
                    e = column.take(pa.array(have)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(np.float64)
                    step = max(1, CELLS // len(have))
                    for a in range(0, len(at), step):
                        some = slice(a, a + step)
                        pairs = nearest_pairs(e, q[some], k, metric, least, best[n].limit[some], [(m[have], t[at[some]]) for m, t in zip(mine, not_these, strict=True)])
                        row, which, value = pairs
                        if ids is not None and len(row) > k * len(q[some]):
                            # many at one distance
                            order, first = ordered(which, value, rest.column(ids).take(pa.array(have[row])), len(q[some]))
                            kept = order[np.arange(len(order)) - first[which[order]] < k]
                            row, which, value = row[kept], which[kept], value[kept]
                        if len(row):
                            best[n].add(which + a, value, rest.take(pa.array(have[row])))
        for n, (at, _) in matrices.items():
            if best[n].n:
                best[n].prune()
                for rows_ in pa.Table.from_batches(best[n].rows, schema).combine_chunks().to_batches():
                    value = best[n].value[0] if metric == "l2" else -best[n].value[0]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(at[best[n].which[0]])), *rows_.columns, pa.array(value)], ["query_id", *rows_.schema.names, "distance" if metric == "l2" else "relevance"])

    return run


def nearest_pairs(e: np.ndarray, q: np.ndarray, k: int, metric: str, least: float | None, limit: np.ndarray, apart: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, value) of pairs that may be among each query's k least: no worse than the k-th of these rows, and than its limit. apart: codes that must differ."""
    with np.errstate(divide="ignore", invalid="ignore"):
        rough = e @ q.T
        if metric == "l2":
            rough *= -2
            rough += (e * e).sum(axis=1)[:, None]
            rough += (q * q).sum(axis=1)[None]
        else:
            rough /= -np.sqrt((e * e).sum(axis=1))[:, None]
            rough /= np.sqrt((q * q).sum(axis=1))[None]
    rough[np.isnan(rough)] = np.inf
    for mine, theirs in apart:
        rough[mine[:, None] == theirs[None]] = np.inf
        rough[mine == NONE] = np.inf
        rough[:, theirs == NONE] = np.inf
    # these rows' last one that may count, and the task's so far
    last = np.partition(rough, min(k, len(e)) - 1, axis=0)[min(k, len(e)) - 1]
    last = np.minimum(last, limit**2 if metric == "l2" else limit)
    row, which = np.nonzero((rough <= last + 1e-9 * (1 + np.abs(last))) & np.isfinite(rough))
    value = measured(e, q, row, which, metric)
    if metric != "l2" and least is not None:
        row, which, value = (x[value <= -least] for x in (row, which, value))
    return row, which, value


def capability(spark: SparkSession, store: str, queries: DataFrame) -> DataFrame:
    """For each query whether the store, a table of the session's catalogue, is there: (query_id, status, reason)."""
    there = spark.catalog.tableExists(store)
    reason = None if there else f"vector store {store} is not available"
    return queries.select("query_id", F.lit("ok" if there else "degraded").alias("status"), F.lit(reason).cast("string").alias("reason"))


def ranked_by_cosine(candidates: DataFrame, anchor: Column, least: float, most: int, group: str = "query_id", id_column: str = "id", vector: str = "embedding") -> DataFrame:
    """Candidates of each group with a cosine of at least `least` to the anchor, the best `most`."""
    scored = candidates.withColumn("relevance", cosine(F.col(vector), anchor)).filter(F.col("relevance") >= least)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("relevance"), id_column))).filter(F.col("rank") <= most)


def fused(lanes: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of lanes (query_id, lane, rank, source_type, source_id, payload columns).

    A key that a lane names more than once gains each time. The payload is that of the first
    lane and rank. Scores are divided by the query's best one; position is the final order, in
    which ties keep the order of first appearance. Terms are added in the order of lanes and
    ranks, and scores are equal if they agree in twelve places, so positions don't depend on
    where the rows came from.
    """
    keys = ["query_id", "source_type", "source_id"]
    payload = [c for c in lanes.columns if c not in (*keys, "lane", "rank")]
    first = F.struct("lane", "rank")
    out = lanes.groupBy(*keys).agg(F.sort_array(F.collect_list(first)).alias("_terms"), F.min(first).alias("_first"), *(F.min_by(c, first).alias(c) for c in payload))
    best = Window.partitionBy("query_id")
    out = out.withColumn("score", F.aggregate("_terms", F.lit(0.0), lambda total, x: total + 1.0 / (F.lit(float(k)) + x["rank"]))).drop("_terms")
    out = out.withColumn("relevance", F.col("score") / F.max("score").over(best))
    return out.withColumn("position", F.row_number().over(best.orderBy(F.desc(F.round("score", 12)), "_first"))).drop("_first")


def quality(hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """A report for each query: n, min and mean relevance, largest share of one source, sources, passed, reason.

    Comparisons are made in single precision. Shares are counted in two steps, so that a query
    with a dominant source is aggregated before its shuffle. With `queries`, those without
    hits are reported too, as failed.
    """
    rel = F.col("relevance").cast("double")
    by_source = hits.groupBy("query_id", "source_id").agg(F.count("*").alias("n"), F.min(rel).alias("low"), F.sum(rel).alias("total"))
    out = by_source.groupBy("query_id").agg(
        F.sum("n").alias("n_hits"), F.min("low").alias("min_relevance"), (F.sum("total") / F.sum("n")).alias("mean_relevance"),
        (F.max("n") / F.sum("n")).alias("max_concentration"), F.count("*").alias("unique_sources"),
    )
    if queries is not None:
        out = queries.select("query_id").distinct().join(out, "query_id", "left").fillna(0).fillna(0.0)
    single = {c: F.col(c).cast("float") for c in ("min_relevance", "mean_relevance", "max_concentration")}
    floor, mean, share = (F.lit(x).cast("float") for x in (FLOOR, MEAN_FLOOR, MAX_SHARE))
    many = F.col("n_hits") >= 3
    shown = {c: F.bround(x.cast("double"), 2) for c, x in single.items()}  # two places of the single-precision value, ties to even
    bad = {
        "low": single["min_relevance"] < floor, "mean": single["mean_relevance"] < mean,
        "share": many & (single["max_concentration"] > share), "few": many & (F.col("unique_sources") < MIN_SOURCES),
    }
    reasons = F.concat_ws(
        "; ",
        F.when(bad["low"], F.format_string(f"min relevance %.2f below {FLOOR:.2f}", shown["min_relevance"])),
        F.when(bad["mean"], F.format_string(f"mean relevance %.2f below {MEAN_FLOOR:.2f}", shown["mean_relevance"])),
        F.when(bad["share"], F.format_string(f"source concentration %.2f above {MAX_SHARE:.2f}", shown["max_concentration"])),
        F.when(bad["few"], F.format_string(f"only %d unique sources, need {MIN_SOURCES}", "unique_sources")),
    )
    none = F.col("n_hits") == 0
    passed = ~none & ~(bad["low"] | bad["mean"] | bad["share"] | bad["few"])
    return out.withColumn("passed", passed).withColumn("reason", F.when(none, "no hits returned").when(~passed, reasons))


def folded(*reasons: Column) -> Column:
    """Reasons that are there, joined; null if there is none."""
    return F.nullif(F.concat_ws("; ", *reasons), F.lit(""))


def gated(hits: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits at or above the floor, a status for each query): queries may have a lane_reason.

    A query without any hit and without a lane's reason is healthy; one that had hits, all of
    them under the floor, is not.
    """
    kept = hits.filter(F.col("relevance").cast("float") >= F.lit(FLOOR).cast("float"))
    had = hits.groupBy("query_id").agg(F.count("*").alias("n_before"))
    lane = F.col("lane_reason") if "lane_reason" in queries.columns else F.lit(None).cast("string")
    report = quality(kept, queries).join(queries.select("query_id", lane.alias("lane_reason")), "query_id").join(had, "query_id", "left")
    before = F.coalesce("n_before", F.lit(0).cast("long"))
    own = F.when((before == 0) & F.col("lane_reason").isNull(), F.lit(None)).otherwise(F.col("reason"))
    return kept, report.select("query_id", before.alias("n_before"), "n_hits", "passed", folded(F.col("lane_reason"), own).alias("reason"))


def reranked(hits: DataFrame, scores: DataFrame, least: float) -> DataFrame:
    """hits (query_id, position) in the order of a cross-encoder's scores (query_id, position, rerank_score).

    Scored hits under `least` go; hits that were not scored follow the scored ones in their
    order. A query without scores stays as it is. Scores of positions that do not exist count for nothing.
    """
    out = hits.join(scores.select("query_id", "position", "rerank_score"), ["query_id", "position"], "left").filter((F.col("rerank_score") >= least) | F.col("rerank_score").isNull())
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "position")
    return out.withColumn("new_position", F.row_number().over(order))


def rerank_reason(dropped: Column, least: float) -> Column:
    return F.when(dropped > 0, F.format_string(f"cross-encoder reranker dropped %d off-topic hit(s) below floor {least:.2f}", dropped))


def citation_relevance(hits: DataFrame) -> DataFrame:
    """relevance of hits by citations over the query's most cited one, between 0 and 1; 0.3 where unknown; and canonical_id."""
    most = F.greatest("_most", F.lit(1))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("citation_count") / most))
    canonical = F.when(F.col("arxiv_id").isNotNull(), F.concat(F.lit("arxiv:"), "arxiv_id")).otherwise(F.concat(F.lit("s2:"), "s2_id"))
    # a maximum, aggregated before its shuffle, so a query may have any number of hits
    top = hits.groupBy(F.col("query_id").alias("_query")).agg(F.max("citation_count").alias("_most"))
    out = hits.join(top, F.col("query_id").eqNullSafe(F.col("_query")))
    return out.withColumn("relevance", F.coalesce(share, F.lit(0.3))).withColumn("canonical_id", canonical).drop("_query", "_most")


def topical(hits: DataFrame, replies: DataFrame) -> DataFrame:
    """hits (query_id, position from 1) that a reply's numbers (0-based) keep.

    Queries with fewer than two hits, without a reply, or whose reply keeps nothing, keep all.
    """
    n = F.count("*").over(Window.partitionBy("query_id"))
    kept = replies.select("query_id", F.explode(F.regexp_extract_all("reply", F.lit(r"(\d+)"), 1)).alias("d")).select("query_id", (F.expr("try_cast(d AS bigint)") + 1).alias("position"), F.lit(True).alias("keep")).distinct()
    joined = hits.join(kept, ["query_id", "position"], "left")
    some = F.max(F.coalesce("keep", F.lit(False))).over(Window.partitionBy("query_id"))
    return joined.withColumn("_n", n).withColumn("_some", some).filter((F.col("_n") < 2) | ~F.col("_some") | F.coalesce("keep", F.lit(False))).drop("_n", "_some", "keep")


def subqueries(replies: DataFrame, most: int = 8) -> DataFrame:
    """Search queries out of replies (query_id, question, reply), a line each.

    Bullets, numbers and quotes go; lines of more than 80 bytes or 8 words too; then equal ones
    but for case, and all after the eighth. A reply without any gives the question itself.
    """
    bare = F.regexp_replace(F.regexp_replace(strip(F.col("line")), r"^[-*•]+", ""), r"^[0-9.)]+", "")
    line = F.regexp_replace(strip(bare), '^"+|"+$', "")
    lines = replies.select("query_id", F.posexplode(F.split("reply", "\n")).alias("ord", "line")).withColumn("text", line)
    good = lines.filter((F.col("text") != "") & (F.octet_length("text") <= 80) & (F.size(F.split("text", r"\s+")) <= 8))
    once = good.withColumn("r", F.row_number().over(Window.partitionBy("query_id", F.lower("text")).orderBy("ord"))).filter("r = 1")
    once = once.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))).filter(F.col("n") <= most).select("query_id", "n", "text")
    rest = replies.join(once.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit(1).alias("n"), F.col("question").alias("text"))
    return once.unionByName(rest)


def first_seen(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
