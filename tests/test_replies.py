"""The reply parser: every kind's verdicts, what counts and what doesn't, and the fallbacks that it feeds."""

from __future__ import annotations

import pytest

from sheaf.operators import replies

CLAIM = '<claim><text>kept</text><source id="a"/></claim>'


@pytest.mark.parametrize(("kind", "reply", "status"), [
    ("synthesis", f"<synthesis>{CLAIM}</synthesis>", "ok"), ("synthesis", f"<synthesis>{CLAIM}", "failed"), ("synthesis", f"<synthesis>{CLAIM}<claim></synthesis>", "cut"),
    ("synthesis", f"<synthesis>{CLAIM}<claim a=\"</synthesis>", "cut"), ("synthesis", None, "failed"), ("synthesis", "", "failed"),
    ("synthesis_patch", "<patch></patch>", "empty"), ("synthesis_patch", "x <patch>\n </patch> y", "empty"), ("synthesis_patch", "<patch/>", "failed"), ("synthesis_patch", "<patch><remove/></patch>", "ok"),
    ("graph_patch", "<patch></patch>", "ok"), ("graph_patch", "<patch><add></patch>", "failed"), ("graph_patch", "<add/>", "failed"),
    ("full_graph", "<graph></graph>", "ok"), ("full_graph", "<graph><node id='a'></graph>", "failed"), ("full_graph", "<node id='a'></node>", "failed"),
    ("extraction", "<node id='a'></node>", "ok"), ("extraction", "<graph><node id='a'><text>x", "cut"), ("extraction", "a < b", "cut"), ("resolution", "nothing", "ok"),
])
def test_verdicts(kind, reply, status):
    found, synthesis, graph = replies.verdict(kind, reply)
    assert found == status and (synthesis is None and graph is None) == (status == "failed")


def test_what_was_closed_is_kept():
    for tail in ("<claim><text>rest</claim></text>", "<claim", "</areas>", "<claim><text>never ends"):
        _, found, _ = replies.verdict("synthesis", f"<synthesis><claims>{CLAIM}{tail}</synthesis>")
        assert [c["text"] for c in found["claims"]] == ["kept"]


def test_quotes_need_text_and_source_and_gaps_text():
    quotes = '<quote source="s">q</quote><quote>q</quote><quote source="s"> </quote><quote source="">q</quote><quote source="s" node=" ">r</quote><quote source="s"/>'
    gaps = '<gaps><gap type="t">one</gap><gap type="u"/><gap> </gap><gap>two</gap></gaps><gap>outside</gap>'
    found = replies.verdict("synthesis", f"<synthesis><claim><text>t</text>{quotes}<ref>r</ref><ref> </ref></claim><claim><text> </text></claim>{gaps}</synthesis>")[1]
    assert [(q["source"], q["text"], q["node_id"]) for q in found["claims"][0]["quotes"]] == [("s", "q", None), ("s", "r", None)]
    assert found["claims"][0]["node_refs"] == ["r"] and len(found["claims"]) == 1
    assert found["gaps"] == [{"description": "one", "type": "t"}, {"description": "two", "type": None}]


@pytest.mark.parametrize(("markup", "v1", "v2"), [
    ("", "divided", None), (' agreement="majority"', "majority", "majority"), (' agreement="total"', "divided", None),
])
def test_agreement_by_profile(markup, v1, v2):
    reply = f"<synthesis><claim{markup}><text>t</text></claim></synthesis>"
    assert [replies.verdict("synthesis", reply, p)[1]["claims"][0]["agreement_level"] for p in ("v1", "v2")] == [v1, v2]
    child = reply.replace("</text>", "</text><agreement_level> minority </agreement_level>")
    assert replies.verdict("synthesis", child, "v2")[1]["claims"][0]["agreement_level"] == "minority"


def test_later_fields():
    inner = "<support_level> CONVERGING</support_level><evidence_grade>A</evidence_grade><method>m</method><year>1999</year><lineage>l</lineage><counterargument>but</counterargument>"
    claim = replies.verdict("synthesis", f"<synthesis><claim><text>a &lt;b&gt; &#65;&#x42;</text>{inner}</claim><year>7</year></synthesis>")[1]["claims"][0]
    assert claim["text"] == "a <b> AB" and [claim[k] for k in ("support_level", "evidence_grade", "method", "year", "lineage", "counterarguments")] == ["converging", "A", "m", "1999", "l", ["but"]]
    areas = "<areas_of_agreement><area>x</area><item>y</item></areas_of_agreement><areas_of_disagreement><area>z</area></areas_of_disagreement><uncertainties><item>u</item></uncertainties><uncertainty>v</uncertainty><area>none</area>"
    found = replies.verdict("synthesis", f"<synthesis>{areas}<narrative>a</narrative><narrative>b</narrative></synthesis>")[1]
    assert (found["agreement"], found["disagreement"], found["uncertainties"], found["narrative"]) == (["x", "y"], ["z"], ["u", "v"], "b")


@pytest.mark.parametrize(("text", "want"), [("a &amp; b", "a & b"), ("a &nope; b", ""), ("a & b", ""), ("&#xZZ;", ""), ("&#99999999;", ""), ("plain", "plain"), ("&apos;&quot;", "'\"")])
def test_entities(text, want):
    assert replies.resolved(text) == want


def test_nodes_are_namespaced_only_when_extracted():
    node = "<node id=' n1 '><text>one</text><text>two</text><quote>q</quote></node><node id='e1_x'></node><node id='e1'></node><node id='single'/><node><text>t</text></node>"
    nodes = replies.verdict("extraction", f"<graph>{node}</graph>", expert="e1")[2]["nodes"]
    assert [(n["id"], n["claim"], n["quote"]) for n in nodes] == [("e1_n1", "two", "q"), ("e1_x", "", None), ("e1", "", None)]
    assert [n["id"] for n in replies.verdict("full_graph", f"<graph>{node}</graph>", expert="e1")[2]["nodes"]] == [" n1 ", "e1_x", "e1"]
    assert [n["id"] for n in replies.verdict("graph_patch", f"<patch>{node}<add>{node}</add></patch>")[2]["nodes"]] == [" n1 ", "e1_x", "e1"]


def test_very_long_and_deep_replies():
    text = "word " * 200_000
    assert replies.verdict("synthesis", f"<synthesis><claim><text>{text}</text></claim></synthesis>")[1]["claims"][0]["text"] == text.strip()
    assert replies.verdict("synthesis", "<synthesis>" + "<" * 50_000 + "</synthesis>")[0] == "cut"
    deep = "<synthesis><claim><text>" + "<b>" * 20_000 + "x" + "</b>" * 20_000 + "</text></claim></synthesis>"
    assert [c["text"] for c in replies.verdict("synthesis", deep)[1]["claims"]] == ["x"]
    many = "<synthesis>" + CLAIM * 5000 + "</synthesis>"
    assert len(replies.verdict("synthesis", many)[1]["claims"]) == 5000


def test_frames(spark):
    """Null and repeated rows, other columns, an empty table; profile and expert where the columns are missing."""
    rows = [(1, "synthesis", f"<synthesis>{CLAIM}</synthesis>", 0), (1, "synthesis", f"<synthesis>{CLAIM}</synthesis>", 1), (None, "synthesis", None, 2)]
    df = spark.createDataFrame(rows, "reply_id int, kind string, reply string, status int")
    got = replies.parsed(df)
    assert sorted((r["reply_id"] or 0, r["status"]) for r in got.collect()) == [(0, "failed"), (1, "ok"), (1, "ok")]
    assert replies.parsed(df.limit(0)).collect() == []
    assert [r[0] for r in got.filter("status = 'ok'").select(replies.lost_sources(got)).collect()] == [False, False]
    bare = spark.createDataFrame([(1, "synthesis", "<synthesis><claim><text>t</text></claim></synthesis>")], "reply_id int, kind string, reply string")
    got = replies.parsed(bare)
    assert got.select(replies.lost_sources(got)).first()[0] is True


def test_drafts_without_replies_stay(spark):
    drafts = spark.createDataFrame([(1, [("c",)])], "draft_id int, claims array<struct<text:string>>").select("draft_id", replies.F.expr(
        "transform(claims, c -> named_struct('text', c.text, 'agreement_level', NULL, 'sources', array(), 'counterarguments', array(), 'support_level', NULL, 'evidence_grade', NULL, 'method', NULL, 'year', NULL, 'lineage', NULL, 'quotes', array(), 'node_refs', array()))"
    ).cast(replies.CLAIMS).alias("claims"))
    tried = spark.createDataFrame([], "draft_id int, way string, reply string, error boolean")
    got = replies.resolved_syntheses(drafts, tried).first()
    assert (got["taken"], [c["text"] for c in got["claims"]]) == ("heuristic", ["c"])
    nodes = spark.createDataFrame([(1, "n", "c", "e", "verified")], "graph_id int, node_id string, claim string, expert_id string, status string")
    retrieved = spark.createDataFrame([(1, 0, "s", "x")], "graph_id int, ord int, source_id string, content string")
    assert [(r["node_id"], r["taken"]) for r in replies.resolved_graphs(nodes, tried, retrieved).collect()] == [("n", None)]
