"""Changes of stored tables: the same as of the whole log, and no file of an untouched partition is written."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from sheaf.operators import corpus
from sheaf.plans.base import rows
from sheaf.sources import store as stores

DATA = "/root/testdata/sf0.001"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def parts_of(paths):
    return {int(p.split("_part=")[1].split("/")[0]) for p in paths}


def plain(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def log(spark):
    return rows(spark, DATA, "log").cache()


def test_upserts(spark, log, tmp_path):
    """A log in three stretches, folded in one after the other, gives what it gives at once; later ones touch few papers."""
    cut = [r["s"] for r in log.select(F.expr("percentile_disc(0.6) WITHIN GROUP (ORDER BY seq)").alias("s")).collect()][0]
    store = stores.Store(spark, str(tmp_path / "papers"), ["paper_id"], 16)
    store.create(corpus.upserted(log.filter(F.col("seq") <= cut)))
    assert plain(store.rows()) == plain(corpus.upserted(log.filter(F.col("seq") <= cut)))
    for writes in (log.filter(F.col("seq") > cut + 3), log.filter(f"seq > {cut} AND seq <= {cut + 3}").limit(0)):
        before = files(store.path)
        counts = stores.upsert(store, writes)
        touched = {r[0] for r in store.placed(writes).select("_part").distinct().collect()}
        same = {p for p, t in files(store.path).items() if before.get(p) == t}
        assert counts["n_parts"] == len(touched) and parts_of(same) == parts_of(before) - touched
    assert plain(store.rows()) == plain(corpus.upserted(log.filter(F.col("seq") <= cut).unionByName(log.filter(F.col("seq") > cut + 3))))


def test_credibility_and_status(spark, tmp_path):
    papers = rows(spark, DATA, "papers").select("paper_id", "citation_count", "influential_count", "venue").withColumns({"fulltext_status": F.lit("none"), "open_access_pdf_url": F.lit(None).cast("string")})
    store = stores.Store(spark, str(tmp_path / "papers"), ["paper_id"], 32)
    store.create(papers)
    some = papers.orderBy("paper_id").limit(3)
    signals = some.select("paper_id", F.lit(7).alias("new_citations"), F.lit(0).alias("new_influential"), F.lit(" v ").alias("new_venue"))
    changes = some.select("paper_id", F.lit(1).alias("ord"), F.lit("full").alias("status"), F.lit(None).cast("string").alias("url"))
    before = files(store.path)
    stores.set_credibility(store, signals)
    stores.set_status(store, changes)
    assert plain(store.rows()) == plain(corpus.with_status(corpus.with_credibility(papers, signals), changes))
    changed = parts_of({p for p, t in before.items() if files(store.path).get(p) != t})
    assert 0 < len(changed) <= 3
    unknown = spark.createDataFrame([("nobody", 1, 1, "v")], "paper_id string, new_citations int, new_influential int, new_venue string")
    stores.set_credibility(store, unknown)
    assert store.rows().count() == papers.count()


def test_put_and_delete(spark, tmp_path):
    """Deletion of all of a partition's rows, of none, of keys that are not there; and the same change again."""
    df = spark.range(200).select(F.col("id").alias("k"), F.lit(0).alias("seq"), F.concat(F.lit("v"), "id").alias("v"))
    store = stores.Store(spark, str(tmp_path / "t"), ["k"], 8)
    store.create(df)
    whole = store.placed(df).filter("_part = 3").select("k")
    n = whole.count()
    assert 0 < n and stores.delete(store, whole) == {"n_before": n, "n_after": 0, "n_parts": 1}
    assert store.rows().count() == 200 - n and not os.path.exists(f"{store.path}/_part=3")
    assert stores.delete(store, whole) == {"n_before": 0, "n_after": 0, "n_parts": 1}
    new = spark.createDataFrame([(1, 5, "old"), (1, 6, "new"), (999, 1, "added")], "k long, seq int, v string")
    for _ in range(2):
        stores.put(store, new, "seq")
        assert {r["k"]: r["v"] for r in store.rows().filter("k IN (1, 999)").collect()} == {1: "new", 999: "added"}
    assert stores.delete(store, spark.createDataFrame([(-5,)], "k long"))["n_parts"] == 1 and store.rows().count() == 200 - n + 1
    empty = stores.Store(spark, str(tmp_path / "e"), ["k"], 8)
    empty.create(df.limit(0))
    assert empty.rows().collect() == [] and stores.put(empty, new, "seq")["n_after"] == 2
    assert empty.rows().count() == 2
