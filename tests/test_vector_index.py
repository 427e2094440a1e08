"""The pivot index against the scan: equal results, and far fewer vectors measured where they lie in groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.operators import retrieval, vector_index


def frame(spark, x, kind="float", first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], f"chunk_id long, embedding array<{kind}>").repartition(4)


def asked(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "query_id int, query_vector array<float>")


def same(index, queries, chunks, k):
    got = [tuple(r) for r in vector_index.search(index, queries, k).select("query_id", "rank", "id", F.round("distance", 5), F.round("similarity", 5)).orderBy("query_id", "rank").collect()]
    want = [tuple(r) for r in retrieval.nearest(queries, chunks, k).select("query_id", "rank", "chunk_id", F.round("distance", 5), F.round("similarity", 5)).orderBy("query_id", "rank").collect()]
    assert got == want
    return got


@pytest.mark.parametrize("few", [0, 1000])
def test_equal_to_the_scan(spark, monkeypatch, few):
    monkeypatch.setattr(vector_index, "FEW_BLOCKS", few)
    r = np.random.default_rng(few)
    x = np.round(r.standard_normal((900, 6)) * 2).astype("float32") / 2  # ties
    x[:300] = x[0]  # a pivot with a third of all
    chunks = frame(spark, x)
    index = vector_index.build(chunks, 6, pivots=20, rows=16)
    queries = asked(spark, np.concatenate((x[:5], r.standard_normal((20, 6)), np.full((1, 6), 50.0))))
    for k in (1, 7, 320, 2000):
        same(index, queries, chunks, k)


def test_groups_are_left_out(spark, monkeypatch):
    """Of 40 groups far apart a query measures little more than its own."""
    monkeypatch.setattr(vector_index, "FEW_BLOCKS", 4)
    r = np.random.default_rng(2)
    centres = r.standard_normal((40, 16)) * 30
    x = (centres[np.arange(4000) % 40] + r.standard_normal((4000, 16))).astype("float32")
    chunks = frame(spark, x)
    index = vector_index.build(chunks, 16, pivots=128, rows=32)
    queries = asked(spark, centres[:10] + 0.1)
    same(index, queries, chunks, 10)
    measured = [row["measured"] for row in vector_index.search(index, queries, 10).filter("rank = 1").collect()]
    assert len(measured) == 10 and max(measured) <= 400
    # a block that no query needs does not leave the JVM
    plan = vector_index.looked_up(index, np.zeros((1, 16)), np.ones((1, len(index.pivots))), np.array([0.5]), 3, np.ones(len(index.pivots), bool), index.blocks().schema["ids"].dataType.elementType)._jdf.queryExecution().executedPlan().toString()
    assert "FilterExec" in plan or "Filter (" in plan or "Filter ((" in plan
    assert "PartitionFilters: []" not in plan and "PushedFilters: [IsNotNull(far)" in plan


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [0.0, None]), (7, [1.0, 2.0]), (7, [1.0, 2.0])]
    chunks = spark.createDataFrame(rows, "chunk_id int, embedding array<double>")
    index = vector_index.build(chunks, 2)
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [float("nan"), 1.0])], "query_id int, query_vector array<float>")
    got = vector_index.search(index, queries, 5)
    assert sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in got.collect()) == [(1, 1, 1, 0.0), (1, 2, 7, 0.0), (1, 3, 7, 0.0)]
    assert vector_index.search(vector_index.build(chunks.limit(0), 2), queries, 5).collect() == []
    assert vector_index.search(index, queries.limit(0), 5).collect() == []
    assert vector_index.search(index.cache(), queries, 2).count() == 2
    index.cached.unpersist()


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 3)
    r = np.random.default_rng(4)
    chunks, queries = frame(spark, r.standard_normal((60, 3)), "double"), asked(spark, r.standard_normal((10, 3)))
    same(vector_index.build(chunks, 3, pivots=5, rows=8), queries, chunks, 4)
