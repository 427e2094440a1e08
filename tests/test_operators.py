"""Small cases of the operators: boundaries, empty inputs, ties."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sheaf.functions import text as tx
from sheaf.functions.vectors import cosine, l2
from sheaf.operators import citations, corpus, fitness, graph, provenance, retrieval, scans
from sheaf.operators.joins import as_of
from sheaf.plans import review
from sheaf.sources import corpora
from sheaf.streaming import pacing


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def hits(spark, *rels, sources=None):
    return spark.createDataFrame([(1, (sources or [f"s{i}" for i in range(len(rels))])[i], float(r)) for i, r in enumerate(rels)], "query_id int, source_id string, relevance double")


@pytest.mark.parametrize(("rels", "passed"), [((0.2999, 0.9, 0.9), False), ((0.3, 0.9, 0.9), True), ((0.3001, 0.9, 0.9), True), ((0.4799,), False), ((0.48,), True), ((0.4801,), True)])
def test_quality_boundaries(spark, rels, passed):
    assert retrieval.quality(hits(spark, *rels)).first()["passed"] is passed


def test_quality_concentration(spark):
    exact = retrieval.quality(hits(spark, *[0.9] * 5, sources=["a", "a", "a", "b", "c"])).first()
    assert exact["max_concentration"] == 0.6 and exact["passed"]
    two = retrieval.quality(hits(spark, *[0.9] * 4, sources=["a", "a", "a", "b"])).first()
    assert two["reason"] == "source concentration 0.75 above 0.60; only 2 unique sources, need 3"
    empty = retrieval.quality(hits(spark).limit(0), hits(spark, 1.0)).first()
    assert not empty["passed"] and empty["reason"] == "no hits returned"


def test_gate_reasons(spark):
    queries = spark.createDataFrame([(1, None), (2, None), (3, "lane down")], "query_id int, lane_reason string")
    found = hits(spark, 0.1)
    status = {r["query_id"]: r["reason"] for r in retrieval.gated(found, queries)[1].collect()}
    assert status == {1: "no hits returned", 2: None, 3: "lane down; no hits returned"}


def test_fusion_three_by_three(spark):
    lanes = spark.createDataFrame([(1, l, r, f"t{l}", f"{l}-{r}", "x") for l in range(3) for r in (1, 2, 3)], "query_id int, lane int, rank int, source_type string, source_id string, title string")
    out = retrieval.fused(lanes).orderBy("position").collect()
    assert len(out) == 9 and out[0]["relevance"] == 1.0 and [r["source_id"] for r in out[:3]] == ["0-1", "1-1", "2-1"]


def test_fusion_same_id_of_two_types(spark):
    lanes = spark.createDataFrame([(1, 0, 1, "a", "x", ""), (1, 1, 1, "b", "x", ""), (1, 0, 2, "a", "x", "")], "query_id int, lane int, rank int, source_type string, source_id string, title string")
    out = {r["source_type"]: r["score"] for r in retrieval.fused(lanes).collect()}
    assert out["a"] == pytest.approx(1 / 61 + 1 / 62) and out["b"] == pytest.approx(1 / 61)


def test_rerank(spark):
    rows = spark.createDataFrame([(1, i, f"h{i}") for i in range(4)], "query_id int, position int, name string")
    scores = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.5), (1, 2, 0.9), (1, 9, 1.0)], "query_id int, position int, rerank_score double")
    assert [r["name"] for r in retrieval.reranked(rows, scores, 0.3).orderBy("new_position").collect()] == ["h2", "h1", "h3"]
    assert retrieval.reranked(rows, scores.limit(0), 0.3).count() == 4


def test_nearest_blocks(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "chunk_id int, embedding array<float>")
    queries = chunks.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    whole = sorted(map(tuple, retrieval.nearest(queries, chunks, 3).select("query_id", "chunk_id").collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, retrieval.nearest(queries, chunks, 3).select("query_id", "chunk_id").collect())) == whole and len(whole) == 30


def test_nearest_in_blocks_by_cosine_with_exclusions(spark, monkeypatch):
    """Tasks that prune, blocks, ties, nulls, other lengths, null vectors and zero ones: as by brute force."""
    r = np.random.default_rng(3)
    vectors = [(i, i % 3 if i % 7 else None, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(300)] + [(300, 1, None), (301, 1, [1.0]), (302, 1, [0.0] * 4)]
    chunks = spark.createDataFrame(vectors, "chunk_id int, label int, embedding array<double>").repartition(3)
    queries = [(i, lab, v) for i, lab, v in vectors if v and len(v) == 4 and any(v)][:40]
    asked = spark.createDataFrame(queries, "query_id int, own int, query_vector array<double>")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 16)

    class Small(retrieval.Best):
        def __init__(self, *args):
            super().__init__(*args)
            self.most = 20

    monkeypatch.setattr(retrieval, "Best", Small)
    got = retrieval.nearest(asked, chunks, 5, metric="cosine", least=0.2, apart=(("query_id", "chunk_id"), ("own", "label")))
    want = []
    for q, own, v in queries:
        found = []
        for c, lab, e in vectors:
            if e and len(e) == 4 and any(e) and c != q and lab is not None and own is not None and lab != own:
                cosine = sum(a * b for a, b in zip(v, e, strict=True)) / (sum(a * a for a in v) ** 0.5 * sum(b * b for b in e) ** 0.5)
                if cosine >= 0.2 + 1e-12:
                    found.append((-round(cosine, 9), c))
        want += [(q, -s) for s, _ in sorted(found)[:5]]
    assert sorted((x["query_id"], round(x["relevance"], 9)) for x in got.collect()) == sorted(want)


def test_lanes_to_search(spark):
    engine = review.Engine(spark)
    chunks = spark.createDataFrame([(i, f"p{i // 2}", i % 2, "paper", f"t{i // 2}", [float(i), 1.0]) for i in range(12)], "chunk_id int, paper_id string, chunk_index int, source_type string, title string, embedding array<double>")
    queries = spark.createDataFrame([(1, [4.0, 1.0]), (2, [11.0, 1.0])], "query_id int, query_vector array<double>")
    live = spark.createDataFrame([(1, 1, "paper", "p9", "t9")], "query_id int, rank int, source_type string, source_id string, title string")
    lanes = engine.lanes(queries, chunks, [live])
    first = {(r["query_id"], r["lane"]): r["source_id"] for r in lanes.filter("rank = 1").collect()}
    assert first == {(1, 0): "p2", (2, 0): "p5", (1, 1): "p9"}
    hits, status = engine.search(lanes, queries.select("query_id"))
    assert {r["query_id"] for r in hits.collect()} == {1, 2} and status.count() == 2


def test_headings_by_class(spark):
    html = "<h1 class='ltx_title_document'>Paper</h1><h2>no</h2><section class='ltx_section' id='S1'><h2 class='other'>not this</h2><h2 class='ltx_title_section'>One</h2><div class='ltx_para'>a</div></section>"
    loose = "<title>tab</title><h1 class='x ltx_title_document'>Paper</h1><div class='ltx_para'>a</div>"
    pages = spark.createDataFrame([(1, html), (2, loose), (3, "<title>tab</title><div class='ltx_para'>b</div>")], "paper_id int, html string")
    assert {(r["paper_id"], r["section"], r["content"]) for r in corpora.html_chunks(pages).collect()} == {(1, "One", "a"), (2, "Paper", "a"), (3, "document", "b")}


def test_scans_of_a_hot_group(spark):
    rows = [(("a" if i % 10 else None), i, float(i % 13)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, v double").repartition(8)
    placed = scans.placed(df, ["g"], ["o"])
    got = {r["o"]: (r["n"], r["top"]) for r in scans.running(scans.running(placed, ["g"], "n", "sum", F.lit(1), before=True), ["g"], "top", "max", F.col("v")).collect()}
    seen = {}
    for g, o, v in rows:
        n, top = seen.get(g, (0, float("-inf")))
        assert got[o] == (n, max(top, v))
        seen[g] = n + 1, max(top, v)


def test_sampling_draws():
    a = fitness.sampling(5, True)
    assert a == fitness.sampling(5, True) and len({x[1] for x in a}) == 5 and all(0.5 <= x[1] <= 1 and 0.85 <= x[2] <= 0.95 for x in a)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, l2(a, b)) == 5.0 and one(spark, cosine(a, b)) == 0.0 and one(spark, cosine(a, a)) == pytest.approx(1.0)
    assert one(spark, l2(a, F.array(F.lit(1.0)))) is None


def test_upsert_keeps_known(spark):
    cols = "paper_id string, seq int, source string, arxiv_id string, doi string, s2_paper_id string, title string, abstract string, url string, year int, authors string, citation_count int, fetched_at string"
    log = spark.createDataFrame([("p", 1, "arxiv", "1", None, None, "T", " A ", "u", 2000, '["x"]', 5, "t1"), ("p", 2, "s2", None, "d", None, " ", "  ", "", None, "[]", None, "t2")], cols)
    r = corpus.upserted(log).first()
    assert (r["source"], r["arxiv_id"], r["doi"], r["title"], r["abstract"], r["url"], r["year"], r["authors"], r["citation_count"], r["fetched_at"]) == ("s2", "1", "d", "T", " A ", "u", 2000, '["x"]', 5, "t2")


@pytest.mark.parametrize(("c", "i", "v", "tier"), [(8, 5, None, "High"), (50, 0, None, "High"), (0, 0, "NeurIPS", "Moderate"), (3, 1, None, "Moderate"), (0, 0, None, "Low"), (None, None, " ", "Unknown")])
def test_tier(spark, c, i, v, tier):
    assert one(spark, corpus.tier(F.lit(c).cast("long"), F.lit(i).cast("long"), F.lit(v).cast("string"))) == tier


@pytest.mark.parametrize(
    ("reply", "score"),
    [("<fitness_evaluation><score>4</score></fitness_evaluation>", 4), ("<score>6</score>", 5), ("<score>0</score>", 1), ("", None), ("  \n", None), ("x" * 201 + " 3", None), ("rated 3 of ten", 3), ("<score>three</score> 2", 2), (None, None), ("v2x 77", None)],
)
def test_scores(spark, reply, score):
    assert one(spark, fitness.parsed_score(F.lit(reply).cast("string"))) == score


def test_weighted_redistributes(spark):
    scores = spark.createDataFrame([(1, "a", 4), (1, "b", None), (2, "a", None)], "c int, dim string, score int")
    weights = spark.createDataFrame([("a", 0.4), ("b", 0.6)], "dim string, weight double")
    assert {r["c"]: r["weighted"] for r in fitness.weighted(scores, weights, ["c"]).collect()} == {1: 4.0, 2: 0.0}


def test_longest_panel_id(spark):
    panel = spark.createDataFrame([("expert_01",), ("expert_010",), ("arxiv:1",)], "source_id string")
    sources = spark.createDataFrame([(1, 1, "expert_010_n2"), (1, 2, "new_expert_01_x:evidence_1"), (1, 3, "arxiv:1_c2"), (1, 4, "expert_01"), (1, 5, "other")], "claim_id int, source_ord int, source_id string")
    out = [r["source_id"] for r in provenance.normalised_sources(sources, panel).orderBy("source_ord").collect()]
    assert out == ["expert_010", "expert_01", "arxiv:1", "other"]


@pytest.mark.parametrize(("quote", "text", "status"), [("b c", "a b c", "verified"), (" b ", "a b c", "verified"), ("B C", "a b c", "paraphrased"), ("z", "a", "absent"), ("", "a", "unverified"), ("a", "", "unverified"), ("  ", "abc", "verified"), (None, "a", "unverified")])
def test_quote_status(spark, quote, text, status):
    assert one(spark, provenance.quote_status(F.lit(quote).cast("string"), F.lit(text))) == status


def test_snap(spark):
    text = "Some first words. The quick brown fox jumps over dogs! Unrelated end."
    quotes = spark.createDataFrame([(1, "quick brown fox jumps high", text), (2, "too short", text), (3, "nothing matches anything here whatsoever", text)], "quote_id int, quote string, text string")
    assert [(r["quote_id"], r["sentence"]) for r in provenance.snapped(quotes).collect()] == [(1, "The quick brown fox jumps over dogs!")]


def test_agreement_thresholds(spark):
    panel = spark.createDataFrame([(f"p{i}",) for i in range(20)], "source_id string")
    claims = spark.createDataFrame([(n, "kept") for n in (0, 2, 3, 10, 15)], "claim_id int, agreement_level string")
    sources = spark.createDataFrame([(n, f"p{i}") for n in (2, 3, 10, 15) for i in range(n)] + [(0, "system")], "claim_id int, source_id string")
    assert {r["claim_id"]: r["agreement_level"] for r in provenance.agreement(claims, sources, panel).collect()} == {0: "kept", 2: "minority", 3: "divided", 10: "majority", 15: "consensus"}


def test_merge_edges_ignores_relation(spark):
    edges = spark.createDataFrame([("a", "b", "supports", 0, 0), ("a", "b", "attacks", 1, 0)], "source string, target string, relation string, graph_ord int, edge_ord int")
    assert [r["relation"] for r in graph.merged_edges(edges).collect()] == ["supports"]


def test_cut_reply_keeps_what_came(spark):
    reply = spark.createDataFrame([("r", '<claims><claim id="C1"><text>a &amp; b</text><source id="s"/></claim><claim id="C2"><text>cut')], "reply_id string, reply string")
    assert [(r["id"], r["text"]) for r in graph.parsed_replies(reply).orderBy("ord").collect()] == [("C1", "a & b"), ("C2", "cut")]


def test_frontier(spark):
    vec = lambda *x: [float(v) for v in x]
    papers = spark.createDataFrame([(i, vec(1, i / 10)) for i in range(6)], "paper_id int, embedding array<float>")
    edges = spark.createDataFrame([(0, 1, 0, 1), (1, 2, 0, 1), (2, 3, 0, 1), (0, 0, 1, 1)], "src int, dst int, kind int, edge_ord int")
    start = spark.createDataFrame([(0, 0)], "seed int, paper_id int")
    anchor = spark.createDataFrame([(0, vec(1, 0))], "seed int, anchor array<float>")
    assert sorted((r["paper_id"], r["level"]) for r in graph.frontier(start, edges, papers, anchor).collect()) == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize(("authors", "shown"), [(["Smith, J"], "Smith, 2020"), (["Jo Smith"], "Smith, 2020"), (["A B", "C D"], "B & D, 2020"), (["A B", "C D", "E F"], "B et al., 2020"), ([], None)])
def test_author_year(spark, authors, shown):
    df = spark.createDataFrame([(authors, 2020)], "authors array<string>, year int")
    assert df.select(citations.author_year(F.col("authors"), F.col("year")).alias("x")).first()["x"] == shown


def test_packing(spark):
    parts = F.array(*map(F.lit, ("aaaa", "bbb", "é" * 8, "cc")))
    out = one(spark, tx.packed(parts, 10))
    assert out == ["aaaa\n\nbbb", "é" * 5, "é" * 3, "cc"] and one(spark, tx.packed(F.array().cast("array<string>"), 10)) == []


def test_plain_chunks_stop_at_references(spark):
    texts = spark.createDataFrame([("p", "one\n\ntwo\f three \n \nbibliography matters\n\n7. References\n\nlost\fgone"), ("q", None), ("r", "")], "paper_id string, text string")
    out = [tuple(r) for r in corpora.plain_chunks(texts).orderBy("chunk_index").collect()]
    assert out == [("p", "PDF page 1", 0, "one\n\ntwo"), ("p", "PDF page 2", 1, "three\n\nbibliography matters")]


def test_html_sections(spark):
    html = '<title>T</title><section class="ltx_section" id="S1"><h2>One</h2><div class="ltx_para">a<br>b</div><section class="ltx_section" id="S2"><div class="ltx_para">c</div></section></section>'
    pages = spark.createDataFrame([(1, html), (2, '<div class="ltx_para">flat</div>'), (3, None)], "paper_id int, html string")
    assert [tuple(r) for r in corpora.html_chunks(pages, headings=("h1", "h2", "h3"), title="title").orderBy("paper_id", "chunk_index").collect()] == [(1, "One", 0, "a b\n\nc"), (1, "S2", 1, "c"), (2, "document", 0, "flat")]


def test_atom(spark):
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2101.1v2</id><title>A</title><title>B</title><summary>x</summary><summary>y</summary><author><name>N M</name></author></entry><entry><title>no id</title></entry></feed>'
    out = corpora.atom_entries(spark.createDataFrame([("f", xml), ("g", "broken")], "feed_id string, xml string")).collect()
    assert [(r["paper_id"], r["title"], r["summary"], r["authors"]) for r in out] == [("2101.1v2", "A", "y", ["N M"])]


def test_local_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_text("one")
    (tmp_path / "sub" / "b.md").write_text("two")
    (tmp_path / "c.bin").write_text("no")
    (tmp_path / "d.pdf").write_bytes(b"%PDF broken")
    texts = {r["paper_id"]: (r["text"], r["failure"]) for r in corpora.file_texts(corpora.local_corpus(spark, str(tmp_path))).collect()}
    assert texts["local:a.TXT"] == ("one", None) and texts["local:sub/b.md"] == ("two", None) and texts["local:d.pdf"][1] and len(texts) == 3


def test_pacing_equals_simulation(spark):
    arrivals = [0.0, 0.2, 0.2, 5.0, 5.1, 9.9, 10.0, 10.1]
    calls = spark.createDataFrame([("e", i, a) for i, a in enumerate(arrivals)], "endpoint string, call_id int, arrival double")
    want, last = [], None
    for a in arrivals:
        last = a if last is None else max(a, last + 1.1)
        want.append(last)
    assert [r["granted"] for r in pacing.paced(calls, 1.1).orderBy("call_id").collect()] == pytest.approx(want)


def test_paced_stream(spark, tmp_path):
    spark.createDataFrame([("e", i, float(a)) for i, a in enumerate((0, 0, 3))], "endpoint string, call_id long, arrival double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("endpoint string, call_id long, arrival double").parquet(str(tmp_path / "in"))
    run = pacing.paced_stream(stream, 2.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r["call_id"], r["granted"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0.0), (1, 2.0), (2, 4.0)]


def test_keep_first_sink(spark, tmp_path):
    sink = pacing.keep_first_batch(str(tmp_path / "t"), ["k"], "v")
    df = spark.createDataFrame([(1, 2), (1, 1), (2, 5)], "k int, v int")
    sink(df, 0)
    sink(df.withColumn("v", F.col("v") - 9), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, 1), (2, 5)]


@pytest.mark.parametrize(("created", "ok"), [("2024-01-01T00:00:00Z", True), ("2023-12-31T00:00:01Z", True), ("2023-12-30T23:59:59Z", False), ("rubbish", False)])
def test_ttl(spark, created, ok):
    assert one(spark, pacing.alive(F.lit(created), F.lit("2024-03-31T00:00:00Z"))) is ok


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "k string, t int, v string")
    assert sorted(map(tuple, as_of(left, right, ["k"], "t", ["v"]).collect()), key=str) == [("a", 1, None), ("a", 5, "y"), ("b", 9, None)]


def test_embedding_seam(spark):
    rows = spark.createDataFrame(pd.DataFrame({"embed_text": ["a", "bb"]}))
    out = corpora.embedded(rows, lambda ts: [[float(len(t))] for t in ts], 1)
    assert sorted(r["embedding"][0] for r in out.collect()) == [1.0, 2.0]


def test_fusion_and_ranks_do_not_depend_on_the_order_of_rows(spark):
    """Keys whose ranks are permutations of each other tie whatever order their terms come in; so do equally weighted candidates."""
    r = np.random.default_rng(3)
    rows = [(q, lane, int(rank), "t", f"k{i}") for q in range(200) for i in range(6) for lane, rank in enumerate(r.permutation([1, 7, 49, 343]))]
    lanes = spark.createDataFrame(rows, "query_id int, lane int, rank int, source_type string, source_id string")
    scores = spark.createDataFrame([(q, i, f"d{d}", float(s)) for q in range(50) for i in range(6) for d, s in enumerate(r.permutation([1, 3, 4]))], "run_id int, candidate int, dim string, score double")
    weights = spark.createDataFrame([(f"d{d}", 0.1 + 0.7 * d) for d in range(3)], "dim string, weight double")
    seen = set()
    for parts in (1, 7, 1000):
        spread = lanes.orderBy(F.rand(parts)).repartition(parts)
        positions = tuple(sorted(tuple(x) for x in retrieval.fused(spread).select("query_id", "source_id", "position", "score").collect()))
        judged = fitness.weighted(scores.orderBy(F.rand(parts)).repartition(parts), weights, ["run_id", "candidate"]).withColumns({"valid": F.lit(True), "ord": F.col("candidate")})
        ranks = tuple(sorted(tuple(x) for x in fitness.best_first(judged, ["run_id"]).select("run_id", "candidate", "rank", "weighted").collect()))
        seen.add((positions, ranks))
    assert len(seen) == 1
    order = {}
    for q, source, position, _ in next(iter(seen))[0]:
        order.setdefault(q, []).append((position, source))
    first = {}
    for q, lane, rank, _, source in rows:
        first[q, source] = min(first.get((q, source), (9, 0)), (lane, rank))
    assert all([s for _, s in sorted(v)] == sorted((s for _, s in v), key=lambda s: first[q, s]) for q, v in order.items())


@pytest.mark.parametrize(("most", "winner", "calls"), [(32, 3, 12), (11, 2, 9), (6, 1, 6), (5, 1, 6)])
def test_tournament_keeps_its_ceiling(spark, most, winner, calls):
    """Two drafts, then redrafts that get better but not valid but for the last; each costs three calls."""
    candidates = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 2, 1), (0, 3, 2)], "run_id int, candidate int, redraft int")
    scores = spark.createDataFrame([(0, c, d, float(s)) for c, pair in enumerate([(1, 1), (2, 2), (3, 3), (4, 4)]) for d, s in zip(("corpus_fit", "x"), pair, strict=True)], "run_id int, candidate int, dim string, score double")
    weights = spark.createDataFrame([("corpus_fit", 0.5), ("x", 0.5)], "dim string, weight double")
    vetoes = spark.createDataFrame([], "run_id int, candidate int, reason string")
    got = fitness.plan_tournament(candidates, scores, weights, vetoes, most_calls=most).first()
    assert (got["candidate"], got["n_calls"]) == (winner, calls)


def test_counters_are_observed(spark):
    """Counters of stripped sources and resolved quotes are those of a recount, without a job of their own."""
    panel = spark.createDataFrame([("e1",)], "source_id string")
    rows = spark.createDataFrame([(1, "e1"), (2, "bogus"), (3, "arxiv:7"), (4, None)], "claim_id int, source_id string")
    seen = Observation()
    kept = provenance.without_invalid(rows, panel, counters=seen).collect()
    assert {r["claim_id"] for r in kept} == {1, 3} and seen.get == {"n": 4, "stripped": 2}
    quotes = spark.createDataFrame([("a", "e1", "exact words here"), ("b", "e1", "one two three four five"), ("c", "none", "x"), ("d", "e1", "nothing like it at all")], "quote_id string, source_id string, quote string")
    texts = spark.createDataFrame([("e1", "The exact words here. One two three four six seven.")], "source_id string, text string")
    seen = Observation()
    got = provenance.quotes_resolved(quotes, texts, seen).collect()
    assert seen.get["n"] == len(got) == 4
    assert (seen.get["verified"], seen.get["snapped"], seen.get["absent"]) == (sum(r["status"] == "verified" for r in got), sum(r["snapped"] for r in got), sum(r["status"] == "absent" for r in got)) == (2, 1, 2)


def test_a_quote_of_several_sources_snaps_in_each_by_itself(spark):
    quotes = spark.createDataFrame([(1, "a", "one two three four five"), (1, "b", "one two three four five")], "quote_id int, source_id string, quote string")
    texts = spark.createDataFrame([("a", "Other words. One two three four six."), ("b", "Nothing like it at all.")], "source_id string, text string")
    got = provenance.quotes_resolved(quotes, texts).select("source_id", "quote", "status", "snapped").collect()
    assert sorted(map(tuple, got)) == [("a", "One two three four six.", "verified", True), ("b", "one two three four five", "absent", False)]


def vectors_of(x):
    return pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))


@pytest.mark.parametrize(("metric", "different"), [("l2", []), ("cosine", [0, 1])])
def test_nearest_has_few_pairs_in_memory(metric, different):
    """3,000 queries against 9,000 vectors in one batch: all pairs would take 216 MB."""
    x = np.random.default_rng(3).normal(size=(9000, 8))
    asked = pa.table({"query_id": pa.array(range(3000)), "query_vector": vectors_of(x[:3000]), "_0": pa.array(range(3000)), "_1": pa.array([i % 3 for i in range(3000)])})
    batch = pa.RecordBatch.from_arrays([pa.array(range(9000)), pa.array([i % 3 for i in range(9000)]), vectors_of(x)], ["id", "label", "embedding"])
    tracemalloc.start()
    found = pa.Table.from_batches(list(retrieval.best_of_task(asked, 2, 4, metric, None, different, 0)(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6 and found.num_rows == 12000
    rows = found.filter(pa.compute.equal(found["query_id"], 17)).sort_by([("distance" if metric == "l2" else "relevance", "ascending" if metric == "l2" else "descending")])
    x = x.astype(np.float32).astype(float)
    value = ((x - x[17]) ** 2).sum(axis=1) if metric == "l2" else -(x @ x[17]) / np.linalg.norm(x, axis=1)
    if different:
        value[[i for i in range(9000) if i % 3 == 17 % 3]] = np.inf
    assert rows["id"].to_pylist() == np.argsort(value)[:4].tolist()


def test_nearest_keeps_k_of_many_copies():
    """Of any number of copies a task keeps k for each query, those of the least ids in Spark's order."""
    asked = pa.table({"query_id": pa.array([1, 2]), "query_vector": vectors_of(np.array([[1.0, 0.0], [0.0, 1.0]]))})
    names = [f"v{i}" for i in range(30000)]
    batches = [pa.RecordBatch.from_arrays([vectors_of(np.ones((10000, 2))), pa.array(names[i : i + 10000])], ["embedding", "id"]) for i in (20000, 0, 10000)]
    found = pa.Table.from_batches(list(retrieval.best_of_task(asked, 0, 3, "l2", None, [], 1)(iter(batches)))).to_pylist()
    assert sorted((r["query_id"], r["id"]) for r in found) == [(q, i) for q in (1, 2) for i in sorted(names)[:3]]


def test_nearest_apart_of_nulls_and_ids_without_order(spark):
    q = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, None, [1.0, 0.0])], "query_id int, own string, query_vector array<float>")
    c = spark.createDataFrame([(1.5, "a", [1.0, 0.0]), (2.5, "b", [1.0, 0.0]), (3.5, None, [1.0, 0.0]), (0.5, "c", [1.0, 0.1])], "id double, tag string, embedding array<float>")
    got = retrieval.nearest(q, c, 2, id_column="id", apart=(("own", "tag"),)).select("query_id", "id", "rank").collect()
    assert sorted(map(tuple, got)) == [(1, 0.5, 2), (1, 2.5, 1)]


def test_html_is_parsed_in_pieces(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * 40, "b" * 40, None, "c" * 300, ""])], ["id", "html"])
    monkeypatch.setattr(corpora, "HTML_BYTES", 100)
    assert [p.column(0).to_pylist() for p in corpora.some_rows(batch, 1)] == [[0, 1, 2], [3], [4]]
