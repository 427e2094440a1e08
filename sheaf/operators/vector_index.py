"""Exact nearest neighbours by pivots: blocks that cannot hold one of a query's k nearest are left out.

Building: at most PIVOTS vectors, those of least id hash, are pivots. Every vector goes to its
nearest pivot, vectors of a pivot are sorted by their distance to it and packed into blocks of
ROWS, each with its pivot, its least and greatest distance (near, far) and its vectors as one
matrix of their own precision. Range partitioning by pivot and distance splits a pivot with very many vectors.
The index is a table with a partition for each pivot.

Searching: with d the distance from a query to a block's pivot, no vector of the block is nearer
to the query than max(d - far, near - d), by the triangle inequality. A query's bound is the
distance within which k vectors lie for certain: at first d + far of the pivots' nearest rings,
then, where there are more than FEW_BLOCKS blocks, the k-th distance found in the blocks of its
nearest pivots, and in each task the k-th one found so far. Pivots that no query needs are not
read, blocks that no query needs don't leave the JVM, and a task measures the rest of them in
order of their least distances. `measured` counts the vectors that were measured for a query.

Defined results: those of the scan (`retrieval.nearest`): vectors that are null or of another
length than a query's match nothing, ties go to the lesser id, a query of fewer than k vectors has
all of them; repeated rows are vectors of their own; a query without a match has no row. Vectors
with components that are null or not finite are not indexed, and queries with such find nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import similarity
from ..session import shared_folder
from .retrieval import QUERY_BLOCK

PIVOTS, ROWS, FEW_BLOCKS, NEAREST_PIVOTS = 256, 512, 64, 2
#: Distances are rounded; bounds give way by this share of what went into them.
SLACK = 1e-6


def matrix_of(column: pa.Array, n: int, rows: np.ndarray) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def usable(column: pa.Array, n: int) -> np.ndarray:
    """Rows whose vector has n components, all of them finite."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == n)
    values = matrix_of(column, n, rows).astype(np.float64) if len(rows) else np.zeros((0, n))
    return rows[np.isfinite(values).all(axis=1)]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the rows of both, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def pivots_of(chunks: DataFrame, n: int, id_column: str, vector: str, most: int) -> np.ndarray:
    """At most `most` indexed vectors, those of least id hash; they come to the driver."""
    finite = F.expr(f"size(`{vector}`) = {n} AND NOT exists(`{vector}`, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    got = chunks.filter(finite).select(F.xxhash64(F.col(id_column)).alias("h"), F.col(vector).cast("array<double>").alias("v")).orderBy("h", "v").limit(most).toArrow()
    return got["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n) if got.num_rows else np.zeros((0, n))


@dataclass
class Index:
    """The blocks' table, its pivots, and of each pivot (pivot, near, far, n, blocks)."""

    spark: SparkSession
    path: str
    dimensions: int
    pivots: np.ndarray
    rings: np.ndarray
    #: Of the components: `<f4` or `<f8`.
    precision: str
    cached: DataFrame | None = None

    def blocks(self) -> DataFrame:
        return self.cached if self.cached is not None else self.spark.read.parquet(self.path)

    def cache(self) -> Index:
        """Keep the blocks in the executors' memory, for many searches of a small index."""
        self.cached = self.blocks().cache()
        self.cached.count()
        return self


def build(chunks: DataFrame, dimensions: int, id_column: str = "chunk_id", vector: str = "embedding", pivots: int = PIVOTS, rows: int = ROWS, folder: str | None = None) -> Index:
    """The index of the vectors of one length in chunks, written to a shared folder."""
    spark = chunks.sparkSession
    path = folder or f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    chosen = pivots_of(chunks, dimensions, id_column, vector, pivots)
    kind = chunks.schema[id_column].dataType
    precision = "<f4" if isinstance(chunks.schema[vector].dataType.elementType, T.FloatType) else "<f8"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = usable(batch.column(1), dimensions)
            if len(have) and len(chosen):
                x = matrix_of(batch.column(1), dimensions, have)
                d = distances(x, chosen)
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(d[np.arange(len(at)), at]), batch.column(0).take(pa.array(have)), pa.array([v.tobytes() for v in x.astype(precision)], pa.binary())], ["pivot", "d", "id", "v"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by pivot and distance to blocks; one never spans pivots."""
        for batch in batches:
            pivot = batch.column(0).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(pivot[1:] != pivot[:-1]) + 1, [len(pivot)])).tolist() if len(pivot) else [0]
            out = [(a, min(a + rows, e)) for s, e in zip(cuts[:-1], cuts[1:], strict=True) for a in range(s, e, rows)]
            d = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([
                pa.array([int(pivot[a]) for a, _ in out], pa.int32()), pa.array([float(d[a]) for a, _ in out], pa.float64()), pa.array([float(d[b - 1]) for _, b in out], pa.float64()), pa.array([b - a for a, b in out], pa.int32()),
                pa.array([batch.column(2).slice(a, b - a).to_pylist() for a, b in out], pa.list_(batch.column(2).type)), pa.array([b"".join(batch.column(3).slice(a, b - a).to_pylist()) for a, b in out], pa.binary()),
            ], ["pivot", "near", "far", "n", "ids", "vectors"])

    name = kind.simpleString()
    own = chunks.select(F.col(id_column), F.col(vector)).mapInArrow(placed, f"pivot int, d double, id {name}, v binary")
    spread = own.repartitionByRange("pivot", "d").sortWithinPartitions("pivot", "d")
    spread.mapInArrow(packed, f"pivot int, near double, far double, n int, ids array<{name}>, vectors binary").write.partitionBy("pivot").parquet(path)
    rings = np.zeros((len(chosen), 4))
    if len(chosen):
        # a row for each pivot
        for r in spark.read.parquet(path).groupBy("pivot").agg(F.min("near"), F.max("far"), F.sum("n"), F.count("*")).collect():
            rings[r[0]] = r[1:]
    return Index(spark, path, dimensions, chosen, rings, precision)


def certain(d: np.ndarray, rings: np.ndarray, k: int) -> np.ndarray:
    """For each query a distance within which k vectors lie for certain, or infinity: d are its distances to the pivots."""
    reach = np.where(rings[:, 2] > 0, d + rings[:, 1], np.inf)
    order = np.argsort(reach, axis=1)
    have = np.cumsum(rings[:, 2][order], axis=1) >= k
    first = have.argmax(axis=1)
    out = np.take_along_axis(reach, np.take_along_axis(order, first[:, None], 1), 1)[:, 0]
    return np.where(have.any(axis=1), out, np.inf)


def measuring(queries: np.ndarray, d: np.ndarray, bound: np.ndarray, k: int, precision: str):
    """For mapInArrow over blocks: the task's k nearest of each query, and how many vectors it measured for it."""
    n = queries.shape[1]
    squares = (queries * queries).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit, measured = bound.copy(), np.zeros(len(queries), np.int64)
        best: list[list[tuple[np.ndarray, list]]] = [[] for _ in queries]
        kind = None
        for batch in batches:
            kind = batch.column(4).type.value_type
            pivot, near, far = (batch.column(i).to_numpy() for i in range(3))
            least = np.maximum(d[:, pivot] - far, near - d[:, pivot])  # queries x blocks
            for b in np.argsort(least.min(axis=0), kind="stable"):
                need = np.flatnonzero(least[:, b] <= limit + SLACK * (1 + d[:, pivot[b]] + far[b]))
                if not len(need):
                    continue
                x = np.frombuffer(batch.column(5)[b].as_buffer(), precision).reshape(-1, n).astype(np.float64)
                own = batch.column(4)[b].values
                measured[need] += len(x)
                rough = (x * x).sum(axis=1)[:, None] + squares[need][None] - 2 * (x @ queries[need].T)
                for j, q in enumerate(need.tolist()):
                    close = np.flatnonzero(rough[:, j] <= limit[q] ** 2 + 1e-9 * (1 + squares[q] + limit[q] ** 2)) if np.isfinite(limit[q]) else np.arange(len(x))
                    if len(close):
                        exact = np.sqrt(((x[close] - queries[q]) ** 2).sum(axis=1))
                        best[q].append((exact, own.take(pa.array(close))))
                        if sum(len(e) for e, _ in best[q]) >= k:
                            trim(best[q], k)
                            limit[q] = min(limit[q], best[q][0][0].max())
        rows = [(q, e, i) for q in range(len(queries)) for e, i in best[q]]
        counts = [len(e) for _, e, _ in rows]
        some = np.flatnonzero(measured)
        if kind is None:
            return
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate((np.repeat([q for q, _, _ in rows], counts), some)).astype(np.int32)), pa.concat_arrays([*(i.cast(kind) for _, _, i in rows), pa.nulls(len(some), kind)]),
            pa.array(np.concatenate([*(e for _, e, _ in rows), np.full(len(some), np.inf)])), pa.array(np.concatenate((np.zeros(sum(counts), np.int64), measured[some]))),
        ], ["query", "id", "distance", "measured"])

    return run


def trim(found: list[tuple[np.ndarray, pa.Array]], k: int) -> None:
    """Only the k least distances stay, and what ties with the last."""
    value, ids = np.concatenate([e for e, _ in found]), pa.concat_arrays([i for _, i in found])
    if len(value) > k:
        keep = np.flatnonzero(value <= np.partition(value, k - 1)[k - 1])
        value, ids = value[keep], ids.take(pa.array(keep))
    found[:] = [(value, ids)]


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance, similarity, rank and measured of the k nearest vectors of each query (query_id, query_vector).

    Queries are a stated set; they go out in blocks of at most QUERY_BLOCK, one after the other.
    """
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    out, blocks = None, 1
    first = asked.limit(QUERY_BLOCK + 1).toArrow()
    if first.num_rows > QUERY_BLOCK:
        blocks = -(-asked.count() // QUERY_BLOCK)
    for b in range(blocks):
        part = first if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        found = searched(index, part, k)
        out = found if out is None else out.unionByName(found)
    return out


def searched(index: Index, asked: pa.Table, k: int) -> DataFrame:
    spark = index.spark
    rows = usable(asked["query_vector"].combine_chunks(), index.dimensions) if asked.num_rows else np.zeros(0, np.int64)
    names = asked["query_id"].take(pa.array(rows))
    kind = T.StructType([f for f in spark.createDataFrame(asked.slice(0, 0)).schema if f.name == "query_id"])[0].dataType
    ids = index.blocks().schema["ids"].dataType.elementType if len(index.pivots) else T.LongType()
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", ids), T.StructField("distance", T.DoubleType()), T.StructField("similarity", T.DoubleType()), T.StructField("rank", T.IntegerType()), T.StructField("measured", T.LongType())])
    if not len(rows) or not len(index.pivots):
        return spark.createDataFrame([], schema)
    q = matrix_of(asked["query_vector"].combine_chunks(), index.dimensions, rows).astype(np.float64)
    d = distances(q, index.pivots)
    bound = certain(d, index.rings, k)
    results, some = [], np.zeros(len(index.pivots), np.bool_)
    if index.rings[:, 3].sum() > FEW_BLOCKS:
        # the nearest pivots first: the k-th distance there bounds what is needed of the others
        some[np.unique(np.argsort(np.where(index.rings[:, 2] > 0, d, np.inf), axis=1)[:, :NEAREST_PIVOTS])] = True
        near = looked_up(index, q, d, bound, k, some, ids).toArrow()  # some k rows of each query and task
        results.append(spark.createDataFrame(near, f"query int, id {ids.simpleString()}, distance double, measured long"))
        at, value = near["query"].to_numpy(), near["distance"].to_numpy()
        for i in range(len(q)):
            mine = np.sort(value[at == i])
            if len(mine) >= k and np.isfinite(mine[k - 1]):
                bound[i] = min(bound[i], mine[k - 1])
    low = np.maximum(d - index.rings[:, 1], index.rings[:, 0] - d)
    wanted = (low <= bound[:, None] + SLACK * (1 + d + index.rings[:, 1])).any(axis=0) & (index.rings[:, 2] > 0) & ~some
    results.append(looked_up(index, q, d, bound, k, wanted, ids))
    whole = results[0] if len(results) == 1 else results[0].unionByName(results[1])
    of = spark.createDataFrame(pa.table({"query": pa.array(range(len(rows)), pa.int32()), "query_id": names}))
    by = Window.partitionBy("query")
    ranked = whole.withColumn("measured", F.sum("measured").over(by)).filter(F.col("distance") < float("inf")).withColumn("rank", F.row_number().over(by.orderBy("distance", "id"))).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(of), "query").select("query_id", "id", "distance", similarity(F.col("distance")).alias("similarity"), "rank", "measured")  # of: QUERY_BLOCK rows at most


def looked_up(index: Index, q: np.ndarray, d: np.ndarray, bound: np.ndarray, k: int, wanted: np.ndarray, ids: T.DataType) -> DataFrame:
    """The nearest of each query in the blocks of the wanted pivots, as far as they are needed."""
    chosen = np.flatnonzero(wanted)
    blocks = index.blocks().select("pivot", "near", "far", "n", "ids", "vectors").filter(F.col("pivot").isin(chosen.tolist()))
    if np.isfinite(bound).all() and len(chosen):
        # a block that no query needs stays in the JVM: its ring meets none of the rings that queries need of its pivot
        slack = SLACK * (1 + d + index.rings[:, 1])
        reach = bound[:, None] + slack
        spans = F.create_map(*[x for p in chosen.tolist() for x in (F.lit(p), F.array(F.lit(float((d - reach)[:, p].min())), F.lit(float((d + reach)[:, p].max()))))])
        blocks = blocks.filter((F.col("far") >= spans[F.col("pivot")][0]) & (F.col("near") <= spans[F.col("pivot")][1]))
    return blocks.mapInArrow(measuring(q, d, bound, k, index.precision), f"query int, id {ids.simpleString()}, distance double, measured long")
