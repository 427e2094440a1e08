"""Payloads of all kinds: what is passed over, what fails and why."""

from __future__ import annotations

import json

import pytest

from sheaf.operators import graph
from sheaf.sources import payloads


def table(spark, *rows):
    return spark.createDataFrame([(i, f"s2:of{i}", k, p if p is None or isinstance(p, str) else json.dumps(p)) for i, (k, p) in enumerate(rows)], "cache_key int, paper_id string, kind string, payload string")


def test_kinds(spark):
    a, b = {"paperId": "a", "year": 2001, "externalIds": {"ArXiv": "1.2", "DOI": "d"}, "authors": [{"name": "N"}, {}, {"name": None}]}, {"paperId": "b", "title": None, "openAccessPdf": {"url": " "}, "citationCount": None}
    df = table(spark, ("paper", a), ("search", {"data": [b, None, {"title": "t"}, a]}), ("batch", [None, a, b]), ("citations", {"data": [{"citingPaper": a}, {}, {"citingPaper": b}]}), ("references", {"data": [{"citedPaper": b}, {"citingPaper": a}]}))
    got = [(r["cache_key"], r["ord"], r["paper_id"]) for r in payloads.papers(df).orderBy("cache_key", "ord").collect()]
    assert got == [(0, 0, "arxiv:1.2"), (1, 0, "s2:b"), (1, 3, "arxiv:1.2"), (2, 1, "arxiv:1.2"), (2, 2, "s2:b"), (3, 0, "arxiv:1.2"), (3, 2, "s2:b"), (4, 0, "s2:b")]
    assert payloads.failures(df).collect() == []
    rows = {r["paper_id"]: r for r in payloads.papers(df).collect()}
    assert (rows["arxiv:1.2"]["authors"], rows["arxiv:1.2"]["year"], rows["arxiv:1.2"]["doi"]) == (["N"], 2001, "d")
    assert (rows["s2:b"]["title"], rows["s2:b"]["citation_count"], rows["s2:b"]["open_access_pdf_url"]) == ("", 0, None)
    assert sorted(tuple(r) for r in payloads.edges(df).collect()) == [("s2:of3", "arxiv:1.2", 1, 0), ("s2:of3", "s2:b", 1, 2), ("s2:of4", "s2:b", 0, 0)]


@pytest.mark.parametrize(("kind", "payload", "reason"), [
    ("paper", None, "empty payload"), ("paper", "  ", "empty payload"), ("search", "{", "not JSON"), ("paper", "[1]", "not a paper payload"), ("batch", "{}", "not a batch payload"), ("search", "[]", "not a search payload"),
    ("search", '{"data": 7}', "not a search payload"), ("search", "{}", None), ("citations", '{"data": null}', None), ("other", "{}", "unknown kind"), ("paper", '{"paperId": 5}', None), ("batch", "[7, [], {}]", None), ("batch", "null", "not a batch payload"),
])
def test_failures(spark, kind, payload, reason):
    df = table(spark, (kind, payload))
    assert [r["reason"] for r in payloads.failures(df).collect()] == ([reason] if reason else [])
    assert payloads.papers(df).count() == (kind == "paper" and payload == '{"paperId": 5}')


def test_edges_feed_the_frontier(spark):
    df = table(spark, ("references", {"data": [{"citedPaper": {"paperId": "x"}}, {"citedPaper": {"paperId": "y"}}]}), ("citations", {"data": [{"citingPaper": {"paperId": "z"}}]}))
    papers = spark.createDataFrame([(f"s2:{k}", [1.0, float(i)]) for i, k in enumerate(["x", "y", "z"])], "paper_id string, embedding array<float>")
    start = spark.createDataFrame([("s", "s2:of0")], "seed string, paper_id string")
    got = graph.frontier(start, payloads.edges(df), papers, spark.createDataFrame([("s", [1.0, 0.0])], "seed string, anchor array<float>"), depth=1)
    assert sorted((r["paper_id"], r["level"]) for r in got.collect()) == [("s2:of0", 0), ("s2:x", 1), ("s2:y", 1)]
