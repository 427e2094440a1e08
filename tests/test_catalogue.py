"""Every registered query of the catalogue against its DuckDB oracle."""

from __future__ import annotations

import math

import duckdb
import pytest

from sheaf.plans import base, catalogue
from sheaf.plans.base import TABLES, UPPER, all_quotes

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns and mine
    theirs = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    assert df.count() > 0


def test_flagship(spark):
    assert catalogue.flagship(spark, DATA).count() > 0


def test_all_quotes(spark, duck):
    pairs = sorted(duck.execute("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)").fetchall())
    items, docs = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("benchmark", "documents"))
    assert pairs and sorted((r["quote_id"], r["source_id"]) for r in all_quotes(items, docs).collect()) == pairs
    found = catalogue.QUERIES["snap_verified"](spark, DATA).select("quote_id", "source_id").collect()
    assert sorted(map(tuple, found)) == pairs
    assert {r["source_id"] for r in catalogue.QUERIES["graph_evidence"](spark, DATA).filter("n_quotes > 0").collect()} == {d for _, d in pairs}


def test_all_quotes_at_word_borders(spark):
    items = spark.createDataFrame([(1, "ne two three four five six sev"), (2, "short"), (3, "one two three four five six  seven"), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(7, "one two three four five six seven"), (8, "a shorter text"), (9, None)], "doc_id long, text string")
    assert sorted((r["quote_id"], r["source_id"]) for r in all_quotes(items, docs).collect()) == [(1, 7), (2, 8)]


def same_as_sql(spark, duck, name, folder, **tables):
    """Whether a query over changed tables, the others of the fixture, gives what its SQL gives over them."""
    for t in TABLES:
        (folder / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    for t, sql in tables.items():
        (folder / f"{t}.parquet").unlink()
        duck.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    return sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect()) == sorted(repr([plain(v) for v in r]) for r in theirs)


def test_seed_kinds_of_large_ids(spark, duck, tmp_path):
    assert same_as_sql(spark, duck, "seed_id_classify", tmp_path, documents="SELECT * REPLACE (doc_id + 89999 AS doc_id) FROM documents")


def test_quotes_in_capitals_of_letters_without_a_single_one(spark, duck, tmp_path):
    """An item with a sharp s and too few words to snap, in two documents."""
    item = "SELECT * REPLACE (3 AS item_id, 'daß Maß' AS text) FROM (SELECT * FROM benchmark LIMIT 1)"
    docs = "SELECT * REPLACE (CASE WHEN doc_id % 50 = 0 THEN 'So, daß Maß voll ist. ' || text ELSE text END AS text) FROM documents"
    assert same_as_sql(spark, duck, "snap_verified", tmp_path, benchmark=item, documents=docs)


def test_upper_of_each_character(spark, duck):
    texts = ["Straße ŉ ﬁn ΐ é ÿ ǆ 😀x", "", "a\nb", None]
    mine = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").selectExpr("i", f"{UPPER.format('t')} AS u").orderBy("i").collect()
    assert [r["u"] for r in mine] == [duck.execute("SELECT upper(?)", [t]).fetchall()[0][0] for t in texts]


@pytest.mark.parametrize("name", ["score_telemetry", "feedback_doc", "weighted_sum", "validity_rank", "candidate_selection", "minority_only"])
def test_partitions_grow_with_rows(spark, monkeypatch, name):
    """Tables of 7,500 rows at 500 a partition: whatever joins, windows or groups them does so in 15 or more tasks."""
    monkeypatch.setattr(base, "ROWS_OF_PART", 500)
    parts = []
    monkeypatch.setattr(base, "dealt", lambda *f, dealt=base.dealt: [parts.append(d.rdd.getNumPartitions()) or d for d in dealt(*f)])
    monkeypatch.setattr("sheaf.plans.evidence_queries.dealt", base.dealt)
    df = catalogue.QUERIES[name](spark, DATA)
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").count() + spark.read.parquet(f"{DATA}/orders.parquet").count()
    assert parts and min(parts) >= rows / 500 > 4
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    heavy = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "ENSURE_REQUIREMENTS" in x and ("orderkey" in x or "claim_id" in x or "dim#" in x or "candidate" in x and name != "validity_rank")]  # it joins a row for each candidate
    assert not heavy
