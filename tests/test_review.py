from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sheaf.plans.review import Engine, Options, Tables


def test_options():
    assert Options(top_k=99).checked().top_k == 50 and Options(top_k=0).checked().top_k == 1
    with pytest.raises(ValueError, match="unknown"):
        Options(profile="v9").checked()


def test_search(spark):
    lanes = spark.createDataFrame([(1, lane, r, f"t{lane}", f"{lane}-{r}", "x") for lane in range(3) for r in range(1, 5)], "query_id int, lane int, rank int, source_type string, source_id string, title string")
    queries = spark.createDataFrame([(1, None), (2, None)], "query_id int, lane_reason string")
    scores = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.9)], "query_id int, position int, rerank_score double")
    hits, status = Engine(spark, Options(top_k=4)).search(lanes, queries, scores)
    assert [r["source_id"] for r in hits.orderBy("position").collect()] == ["1-1", "2-1", "0-2", "1-2"]
    reasons = {r["query_id"]: r["reason"] for r in status.collect()}
    assert "dropped 1 off-topic" in reasons[1] and reasons[2] is None
    assert {r["source_type"] for r in Engine(spark, Options(local_only=True)).search(lanes, queries)[0].collect()} == {"t0"}


def test_ingest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    papers, chunks, failures = Engine(spark).ingest(str(tmp_path))
    assert papers.count() == 1 and chunks.first()["content"] == "one\n\ntwo" and failures.count() == 0


def test_evolve(spark):
    drafts = spark.createDataFrame([("r", 0, "old"), ("r", 1, "old")], "run_id string, trajectory int, draft string")
    rows = [("r", "judge", t, 0, "d", "<score>4</score>") for t in (0, 1)] + [("r", "gaps", 0, 0, "", "<gap><description>q</description></gap>"), ("r", "resolve", 0, 0, "", "new"), ("r", "resolve", 1, 0, "", "lost")]
    completions = spark.createDataFrame(rows, "run_id string, stage string, trajectory int, step int, task string, reply string")
    weights = spark.createDataFrame([("d", 1.0)], "dim string, weight double")
    retrieved = spark.createDataFrame([("q", "s1", 0)], "query string, source_id string, ord int")
    out, records = Engine(spark, Options(steps=2)).evolved(drafts, completions, weights, retrieved)
    assert {r["trajectory"]: r["draft"] for r in out.collect()} == {0: "new", 1: "old"} and records.count() == 4
    stopped, _ = Engine(spark, Options(steps=1, plateau=3.0)).evolved(drafts, completions, weights, retrieved)
    assert {r["draft"] for r in stopped.collect()} == {"old"}


def test_ranked(spark):
    rows = [("r", t, dim, f"<score>{s}</score>") for t, scores in enumerate(((5, 3), (4, 4), (4, 5))) for dim, s in zip(("faithfulness", "x"), scores, strict=True)]
    completions = spark.createDataFrame(rows, "run_id string, trajectory int, task string, reply string")
    weights = spark.createDataFrame([("faithfulness", 0.5), ("x", 0.5)], "dim string, weight double")
    assert [r["trajectory"] for r in Engine(spark).ranked(completions, weights, "synthesis").orderBy("rank").collect()] == [2, 0, 1]


def test_post_process_and_render(spark):
    panel = spark.createDataFrame([("e1",), ("e2",)], "source_id string")
    claims = spark.createDataFrame([(1, "alpha beta gamma delta epsilon", "x"), (2, "other", "x")], "claim_id int, text string, agreement_level string")
    sources = spark.createDataFrame([(1, 1, "e1_n3"), (1, 2, "bogus"), (2, 1, "arxiv:9")], "claim_id int, source_ord int, source_id string")
    quotes = spark.createDataFrame([("q1", 2, "e1:evidence", "one two three four five", None)], "quote_id string, claim_id int, source_id string, quote string, node_id string")
    nodes = spark.createDataFrame([("n1", 0, "e1", "alpha beta gamma delta", "exact words", "verified")], "node_id string, node_ord int, expert_id string, claim string, quote string, status string")
    texts = spark.createDataFrame([("e1", "Here are the exact words. One two three four six seven.")], "source_id string, text string")
    refs = spark.createDataFrame([], "claim_id int, ref_ord int, node_id string")
    out, missing = Engine(spark).post_processed(Tables(claims, sources, quotes, refs), nodes, texts, panel)
    assert sorted((r["claim_id"], r["source_id"]) for r in out.sources.collect()) == [(1, "e1"), (2, "arxiv:9")]
    assert sorted((r["claim_id"], r["quote"], r["status"], r["inherited"]) for r in out.quotes.collect()) == [(1, "exact words", "verified", True), (2, "One two three four six seven.", "verified", False)]
    assert [r["source_id"] for r in missing.collect()] == ["e2"]
    papers = spark.createDataFrame([("e1", ["A Bee"], 2001, "T", "")], "source_id string, authors array<string>, year int, title string, url string")
    docs = spark.createDataFrame([("d", "x [C1, C7] y")], "doc string, text string")
    shown = Engine(spark).rendered(docs, spark.createDataFrame([("d", 1, 1)], "doc string, claim_no long, claim_id int"), out.sources, papers).first()["text"]
    assert shown == "x (Bee, 2001) y\n\n## References\n\n- Bee, 2001. T"


def test_panel_is_conserved(spark):
    hits = spark.createDataFrame([("p", 1, "T", "fallback"), ("p", 2, "T", "again"), ("q", 3, "U", "only")], "source_id string, position int, title string, content string")
    chunks = spark.createDataFrame([("p", 1, "S", "b"), ("p", 0, None, "a")], "paper_id string, chunk_index int, section string, content string")
    papers = spark.createDataFrame([("p", "Real", 2000, "[]", 60, 0, None)], "paper_id string, title string, year int, authors string, citation_count long, influential_count long, venue string")
    made, check = Engine(spark).panel(hits, chunks, papers)
    rows = {r["source_id"]: r for r in made.collect()}
    assert rows["p"]["prose"] == "a\n\n## S\n\nb" and rows["p"]["tier"] == "High" and rows["q"]["prose"] == "only" and rows["q"]["tier"] == "Unknown" and check.first()["verdict"] == "ok"


def synthesis(spark):
    """A synthesis that cites one of two panel members."""
    claims = spark.createDataFrame([(1, "alpha beta", None)], "claim_id int, text string, agreement_level string")
    sources = spark.createDataFrame([(1, 1, "e1_n3")], "claim_id int, source_ord int, source_id string")
    quotes = spark.createDataFrame([], "quote_id string, claim_id int, source_id string, quote string, node_id string")
    return Tables(claims, sources, quotes, spark.createDataFrame([], "claim_id int, ref_ord int, node_id string"))


@pytest.mark.parametrize(("reply", "texts", "missing"), [
    (None, ["alpha beta"], ["e2"]),
    ("no synthesis at all", ["alpha beta"], ["e2"]),
    ("<synthesis><claim><text>lost</text></claim></synthesis>", ["alpha beta"], ["e2"]),
    ('<synthesis><claim><text>one</text><source id="e1"/></claim><claim><text>two</text><source id="e2:evidence"/><quote source="e2">exact words</quote></claim></synthesis>', ["one", "two"], []),
    ('<synthesis><claim><text>one</text><source id="e1"/></claim></synthesis>', ["one"], ["e2"]),
])
def test_revision(spark, reply, texts, missing):
    """A revision replaces the synthesis, through all steps again, unless it can't be read or has lost its sources."""
    panel = spark.createDataFrame([("e1",), ("e2",)], "source_id string")
    nodes = spark.createDataFrame([], "node_id string, node_ord int, expert_id string, claim string, quote string, status string")
    known = spark.createDataFrame([("e2", "The exact words here.")], "source_id string, text string")
    revision = None if reply is None else spark.createDataFrame([(reply,)], "reply string")
    out, left, reports = Engine(spark).finished(synthesis(spark), nodes, known, panel, revision)
    assert sorted(r["text"] for r in out.claims.collect()) == texts and sorted(r["source_id"] for r in left.collect()) == missing and reports.count() == 0
    if len(texts) == 2:
        assert [(r["source_id"], r["status"]) for r in out.quotes.collect()] == [("e2", "verified")]
        assert sorted((r["claim_id"], r["source_id"]) for r in out.sources.collect()) == [(0, "e1"), (1, "e2")]


def test_revision_of_the_first_profile(spark):
    """v1 computes levels anew and reports members that only minority claims cite."""
    panel = spark.createDataFrame([(f"e{i}",) for i in range(1, 11)], "source_id string")
    nodes = spark.createDataFrame([], "node_id string, node_ord int, expert_id string, claim string, quote string, status string")
    texts = spark.createDataFrame([], "source_id string, text string")
    many = "".join(f'<source id="e{i}"/>' for i in range(1, 9))
    reply = f'<synthesis><claim><text>all</text>{many}</claim><claim><text>few</text><source id="e9"/></claim><claim><text>few too</text><source id="e10"/></claim></synthesis>'
    out, missing, reports = Engine(spark, Options(profile="v1")).finished(synthesis(spark), nodes, texts, panel, spark.createDataFrame([(reply,)], "reply string"), spark.createDataFrame([("e10",)], "source_id string"))
    assert {r["text"]: r["agreement_level"] for r in out.claims.collect()} == {"all": "consensus", "few": "minority", "few too": "minority"}
    assert missing.count() == 0 and [r["source_id"] for r in reports.collect()] == ["e9"]


def test_live_lane(spark):
    """What was found is ingested, but for what the store has, and searched with the whole store."""
    columns = "paper_id string, seq int, source string, title string, abstract string, fetched_at string"
    log = spark.createDataFrame([("a", 1, "s2", "A", "x", "1")], columns)
    found = spark.createDataFrame([("a", 2, "arxiv", "A2", " ", "2"), ("b", 2, "arxiv", "B", "y", "2")], columns)
    stored = spark.createDataFrame([("a#0", "a", [0.0, 0.0])], "chunk_id string, paper_id string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, query_vector array<float>")
    made = lambda papers: papers.select(F.concat("paper_id", F.lit("#0")).alias("chunk_id"), "paper_id", F.array(F.lit(1.0), F.lit(1.0)).cast("array<float>").alias("embedding"))
    papers, hits = Engine(spark).live(log, found, queries, made, stored, 5)
    assert {r["paper_id"]: (r["title"], r["abstract"]) for r in papers.collect()} == {"a": ("A2", "x"), "b": ("B", "y")}
    assert [r["chunk_id"] for r in hits.orderBy("rank").collect()] == ["b#0", "a#0"]
