"""Operator 12: exact integer k-means with annulus search.

Each component x of a vector becomes the integer floor(SCALE * x). A round assigns every vector
to its nearest centroid (squared Euclidean distance, ties to the smaller number) and moves every
centroid that has vectors to the componentwise floor of their mean.

The nearest centroid is found by norms: centroids are sorted by theirs; the distance to the one of
the two neighbours in that order that is closer is an upper bound u, and by the triangle
inequality any centroid within u of a vector of norm m has a norm from m - u to m + u. That
annulus is a range of the sorted norms, found by binary search, and its centroids are compared by
exact integer distances. Norms are rounded, so the annulus is a little wider than needed, and ties
on its boundary are inside.

A round is one pass without a shuffle of vectors: tasks add up their own vectors of each centroid,
Spark adds up these sums, and only the centroids come to the driver and go out again. Vectors are
read again in each round, so an input that is dear to compute should be written first.

Defined results: vectors that are null, have another number of components or one that is null, not
finite or not under 2**27 / SCALE in magnitude are not kept (larger ones could pass 64 bits);
repeated rows are vectors of their own, whatever their ids; rows of equal ids start as centroids
in the order of their components, and such with a null id last; with fewer vectors than centroids
each of them is one; an empty table gives an empty result; sums that pass 64 bits are null; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import tidied
from .columns import named

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components are under this, so that squared distances are whole numbers of 63 bits.
LIMIT = 1 << 27
#: Vectors that are compared at a time.
ROWS = 4096


@dataclass
class Centroids:
    """Integer centroids by number, and their order by norm."""

    values: np.ndarray

    def __post_init__(self) -> None:
        norms = np.sqrt((self.values * self.values).sum(axis=1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def annulus(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of places in the order of norms, for each vector, that has every centroid as near as its nearest."""
        norms = np.sqrt((vectors * vectors).sum(axis=1).astype(np.float64))
        at = np.searchsorted(self.norms, norms)
        bound = np.full(len(vectors), np.iinfo(np.int64).max)
        for guess in (np.maximum(at - 1, 0), np.minimum(at, len(self.norms) - 1)):
            gap = vectors - self.values[self.order[guess]]
            bound = np.minimum(bound, (gap * gap).sum(axis=1))
        u = np.sqrt(bound.astype(np.float64))
        u += 1e-9 * (u + norms) + 1e-6  # roots are rounded
        return np.searchsorted(self.norms, norms - u, side="left"), np.searchsorted(self.norms, norms + u, side="right")

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(numbers of the nearest centroids, squared distances, distances that were computed for it)."""
        low, high = self.annulus(vectors)
        number = np.full(len(vectors), -1)
        least = np.full(len(vectors), np.iinfo(np.int64).max)
        for place in range(int(low.min(initial=0)), int(high.max(initial=0))):
            rows = np.flatnonzero((low <= place) & (place < high))
            gap = vectors[rows] - self.values[self.order[place]]
            distance, c = (gap * gap).sum(axis=1), self.order[place]
            closer = rows[(distance < least[rows]) | (distance == least[rows]) & (c < number[rows])]
            least[closer] = distance[np.searchsorted(rows, closer)]
            number[closer] = c
        return number, least, int((high - low).sum())


def integers(column: pa.Array, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their integer components)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dimensions)
    flat = column.take(pa.array(rows)).flatten()
    values = pc.fill_null(flat.cast(pa.float64(), safe=False), float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), dimensions)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values * scale)
        good = (np.abs(scaled) < LIMIT).all(axis=1)  # false for what is not a number
    return rows[good], scaled[good].astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], dimensions: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integer vectors) of (id, vector) batches, some rows at a time."""
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            batch = whole.slice(i, ROWS)
            rows, vectors = integers(batch.column(1), dimensions, scale)
            yield batch.column(0).take(pa.array(rows)), vectors


def summed(vectors: DataFrame, centroids: Centroids, dimensions: int, scale: int) -> dict[int, tuple[int, list[int], int]]:
    """(vectors, componentwise sum, sum of squared distances) of each centroid that has vectors; added up by Spark."""
    k = len(centroids.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64), [0] * k
        for _, block in blocks(batches, dimensions, scale):
            number, distance, _ = centroids.nearest(block)
            n += np.bincount(number, minlength=k)
            for c in np.unique(number):
                mine = number == c
                sums[c] += block[mine].sum(axis=0)
                # of halves, whose sums stay under 64 bits
                d = distance[mine]
                inertia[c] += (int((d >> 32).sum()) << 32) + int((d & 0xFFFFFFFF).sum())
        some = np.flatnonzero(n)
        # a row for each component, and two for the count and the inertia, in halves of 62 bits
        cluster, place, low, high = [], [], [], []
        for c in some.tolist():
            for p, value in enumerate([*sums[c].tolist(), int(n[c]), inertia[c]]):
                cluster.append(c)
                place.append(p)
                low.append(value & ((1 << 62) - 1))
                high.append(value >> 62)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["cluster", "place", "low", "high"])

    parts = vectors.mapInArrow(tidied(run), "cluster int, place int, low long, high long")
    whole = parts.groupBy("cluster", "place").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high"))).collect()  # rows of centroids
    found: dict[int, list[int]] = {}
    for r in whole:
        found.setdefault(r["cluster"], [0] * (dimensions + 2))[r["place"]] = int(r["low"]) + (int(r["high"]) << 62)
    return {c: (v[-2], v[:-2], v[-1]) for c, v in found.items()}


def start(vectors: DataFrame, clusters: int, dimensions: int, scale: int, seed: int) -> np.ndarray:
    """The first centroids: the kept vectors of least sha256 of `seed:id`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        bound = "~"  # after all digits
        for ids, block in blocks(batches, dimensions, scale):
            for row, i in enumerate(ids.to_pylist()):
                digest = "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
                if digest <= bound:
                    best.append((digest, block[row].tolist()))
            best = sorted(best)[:clusters]
            bound = best[-1][0] if len(best) == clusters else "~"
        yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.list_(pa.int64()))], ["digest", "vector"])

    first = vectors.mapInArrow(tidied(run), "digest string, vector array<long>").orderBy("digest", "vector").limit(clusters).collect()
    return np.array([r["vector"] for r in first], np.int64).reshape(-1, dimensions)


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> Centroids | None:
    """The centroids of (id, vector) rows after the rounds; None if no vector is kept."""
    values = start(vectors, clusters, dimensions, scale, seed)
    if not len(values):
        return None
    for _ in range(rounds):
        moved = values.copy()
        for c, (n, sums, _) in summed(vectors, Centroids(values), dimensions, scale).items():
            moved[c] = [s // n for s in sums]
        if (moved == values).all():
            break  # further rounds would change nothing
        values = moved
    return Centroids(values)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid and centroid_sha256 of every kept vector."""
    source = named(vectors, vec_id=id_column, vector=vector_column)
    kind = source.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    centroids = fit(source, clusters, rounds, dimensions, scale, seed)
    if centroids is None:
        return source.sparkSession.createDataFrame([], schema)
    k = len(centroids.values)
    found = summed(source, centroids, dimensions, scale)
    whole = [found[c][2] if c in found else 0 for c in range(k)]
    inertia, *of = (x if x < 1 << 63 else None for x in (sum(whole), *whole))
    made = pa.table({
        "cluster": pa.array(range(k), pa.int32()), "cluster_inertia": pa.array(of, pa.int64()), "inertia": pa.array([inertia] * k, pa.int64()),
        "centroid": pa.array(centroids.values.tolist(), pa.list_(pa.int64())), "centroid_sha256": pa.array([digest(c) for c in centroids.values], pa.string()),
    })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in blocks(batches, dimensions, scale):
            number, distance, _ = centroids.nearest(block)
            own = made.take(pa.array(number)).combine_chunks()
            columns = [own[c].chunk(0) if own.num_rows else pa.array([], own[c].type) for c in made.column_names]
            yield pa.RecordBatch.from_arrays([ids, columns[0], pa.array(distance), *columns[1:]], ["vec_id", "cluster", "distance", *made.column_names[1:]])

    return source.mapInArrow(tidied(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12 over all embeddings."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("centroid")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """The contract as SQL, a pair of expressions for each round."""
    kept = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INTEGER) AS k, v AS c FROM v QUALIFY k < {clusters})"""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT vec_id, v, k, list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM v, c{r}),
a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {dimensions + 1})) AS i) GROUP BY k, i),
m{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))""")
    return kept + ",\n" + ",\n".join(steps) + f"""
SELECT vec_id, k AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


ORACLE = oracle()
