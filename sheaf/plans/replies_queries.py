"""Queries over models' marked-up replies and paper APIs' payloads, made of the documents' own texts: whole, cut, malformed and missing ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replies
from ..sources import payloads
from .base import query

#: The start of a text in brackets, so that trimming can't touch it; and the same as markup.
BODY = "concat('(', substr(coalesce(text, ''), 1, 80), ')')"
MARKED = f"replace(replace(replace({BODY}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
FIRST = f"""concat('<claim agreement="consensus"><text>', {MARKED}, '</text><source id="d', doc_id, '"/><source expert_id="x"></source><quotes><quote source=" d', doc_id, '" node="n1">', {MARKED}, '</quote><quote>lost</quote><quote source="d"> </quote></quotes>',
    '<node_refs><ref>n1</ref><ref></ref></node_refs><support_level> Contested</support_level><year>', 1990 + doc_id % 30, '</year></claim>')"""
SYNTHESIS = f"""CASE doc_id % 8 WHEN 0 THEN concat('Here it is: <synthesis><claims>', {FIRST}, '<claim><text>second</text></claim></claims><gaps><gap type="data">', {MARKED}, '</gap><gap type="none"/></gaps><narrative>told</narrative></synthesis> bye')
    WHEN 1 THEN concat('<synthesis><claims>', {FIRST}, '</claims>') WHEN 2 THEN concat('<synthesis><claims>', {FIRST}, '<claim><text>rest</claim></text></claims></synthesis>')
    WHEN 3 THEN concat('<synthesis><claim><text>', {MARKED}, '&nope;</text></claim><claim><text>second</text></claim></synthesis>')
    WHEN 4 THEN concat('<synthesis><!-- <claim> --><claim><text>a <b>', {MARKED}, '</b> c</text><counterargument>but</counterargument></claim></synthesis>')
    WHEN 5 THEN concat('<synthesis><claim agreement="total"><text>', {MARKED}, '</text><agreement_level>minority</agreement_level><support_level>strong</support_level></claim></synthesis>')
    WHEN 7 THEN '<synthesis></synthesis>' END"""

SYNTHESES = f""" WITH d AS (SELECT doc_id, doc_id % 8 AS shape, doc_id % 3 = 0 AS v1, {BODY} AS body FROM documents),
c AS (SELECT doc_id, 0 AS claim_no, body AS text, 'consensus' AS agreement_level, 'contested' AS support_level, CAST(1990 + doc_id % 30 AS VARCHAR) AS year, concat('d', doc_id, ',x') AS sources, concat('d', doc_id, '=', body, '@n1') AS quotes, 'n1' AS refs FROM d WHERE shape IN (0, 2)
  UNION ALL SELECT doc_id, CASE shape WHEN 0 THEN 1 ELSE 0 END, 'second', CASE WHEN v1 THEN 'divided' END, NULL, NULL, '', '', '' FROM d WHERE shape IN (0, 3)
  UNION ALL SELECT doc_id, 0, concat('a', body, 'c'), CASE WHEN v1 THEN 'divided' END, NULL, NULL, '', '', '' FROM d WHERE shape = 4
  UNION ALL SELECT doc_id, 0, body, 'minority', NULL, NULL, '', '', '' FROM d WHERE shape = 5)
SELECT d.doc_id AS reply_id, CASE WHEN shape IN (1, 6) THEN 'failed' WHEN shape = 2 THEN 'cut' ELSE 'ok' END AS status, claim_no, text, agreement_level, support_level, year, sources, quotes, refs,
       CASE WHEN shape IN (1, 6) THEN NULL WHEN shape = 0 THEN body ELSE '' END AS gaps, CASE WHEN shape IN (1, 6) THEN NULL WHEN shape = 0 THEN 'told' ELSE '' END AS narrative FROM d LEFT JOIN c ON c.doc_id = d.doc_id"""


@query("synthesis_replies", SYNTHESES)
def synthesis_replies(t):
    asked = t("documents").select(F.col("doc_id").alias("reply_id"), F.lit("synthesis").alias("kind"), F.expr(SYNTHESIS).alias("reply"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'v1' WHEN doc_id % 3 = 1 THEN 'v2' END").alias("profile"))
    got = replies.parsed(asked).select("reply_id", "status", F.expr("array_join(transform(synthesis.gaps, g -> g.description), ',')").alias("gaps"), "synthesis.narrative", F.posexplode_outer("synthesis.claims").alias("claim_no", "c"))
    quotes = F.expr("array_join(transform(c.quotes, q -> concat(q.source, '=', q.text, '@', q.node_id)), ',')")
    return got.select("reply_id", "status", "claim_no", "c.text", "c.agreement_level", "c.support_level", "c.year", F.array_join("c.sources", ",").alias("sources"), quotes.alias("quotes"), F.array_join("c.node_refs", ",").alias("refs"), "gaps", "narrative")


GRAPH = f"""CASE doc_id % 4
    WHEN 0 THEN CASE doc_id % 3 WHEN 0 THEN concat('<graph><node id=" n1"><text>', {MARKED}, '</text><quote>q</quote></node><node id="e', doc_id % 5, '_n2"><text>t2</text></node><node><text>nameless</text></node></graph>')
        WHEN 1 THEN concat('<graph><node id="n1"><text>', {MARKED}, '</text></node><node id="n2"><text>rest') ELSE 'prose only' END
    WHEN 1 THEN CASE doc_id % 3 WHEN 0 THEN '<resolution><edge from="a" to="b" type="supports"/><edge from="a" to="c"/><edge from="b" to="c" type="attacks"></edge></resolution>'
        WHEN 1 THEN '<resolution><edge from="a" to="b" type="supports"/><edge from="x' ELSE 'prose only' END
    WHEN 2 THEN CASE doc_id % 3 WHEN 0 THEN concat('<patch><add><node id="p1"><text>', {MARKED}, '</text><source>s1</source></node></add><node id="outside"><text>t</text></node></patch>')
        WHEN 1 THEN '<patch><add><node id="p1"><text>t</text></node></add></node></patch>' ELSE 'prose only' END
    ELSE CASE doc_id % 3 WHEN 0 THEN concat('so: <graph><node id="g1"><text>', {MARKED}, '</text><source>s2</source><quote>q2</quote></node></graph>')
        WHEN 1 THEN '<graph><node id="g1"><text>t</node></text></graph>' ELSE 'prose only' END END"""

GRAPHS = f""" WITH d AS (SELECT doc_id, doc_id % 4 AS k, doc_id % 3 AS shape, concat('e', doc_id % 5) AS e, {BODY} AS body FROM documents)
SELECT doc_id AS reply_id, CASE WHEN k > 1 AND shape > 0 THEN 'failed' WHEN shape = 1 THEN 'cut' ELSE 'ok' END AS status,
       CASE WHEN k > 1 AND shape > 0 THEN NULL WHEN k = 0 AND shape = 0 THEN concat(e, '_n1|', body, '|', e, '|q;', e, '_n2|t2|', e, '|') WHEN k = 0 AND shape = 1 THEN concat(e, '_n1|', body, '|', e, '|')
            WHEN k = 2 AND shape = 0 THEN concat('p1|', body, '|s1|') WHEN k = 3 AND shape = 0 THEN concat('g1|', body, '|s2|q2') ELSE '' END AS nodes,
       CASE WHEN k > 1 AND shape > 0 THEN NULL WHEN k = 1 AND shape = 0 THEN 'a>b:supports;b>c:attacks' WHEN k = 1 AND shape = 1 THEN 'a>b:supports' ELSE '' END AS edges FROM d"""


@query("graph_replies", GRAPHS)
def graph_replies(t):
    kind = F.expr("CASE doc_id % 4 WHEN 0 THEN 'extraction' WHEN 1 THEN 'resolution' WHEN 2 THEN 'graph_patch' ELSE 'full_graph' END")
    got = replies.parsed(t("documents").select(F.col("doc_id").alias("reply_id"), kind.alias("kind"), F.expr(GRAPH).alias("reply"), F.expr("concat('e', doc_id % 5)").alias("expert_id")))
    nodes = F.expr("array_join(transform(graph.nodes, n -> concat(n.id, '|', n.claim, '|', n.expert_id, '|', coalesce(n.quote, ''))), ';')")
    return got.select("reply_id", "status", nodes.alias("nodes"), F.expr("array_join(transform(graph.edges, e -> concat(e.source, '>', e.target, ':', e.relation)), ';')").alias("edges"))


PATCH = f"""CASE doc_id % 4 WHEN 0 THEN concat('<patch><add><claim><text>', {MARKED}, '</text></claim><claim><text> </text></claim></add></patch>') WHEN 1 THEN 'as it was: <patch> </patch>' WHEN 2 THEN 'no patch' END"""
FULL = f"""CASE doc_id % 3 WHEN 0 THEN concat('<synthesis><claim agreement="majority"><text>', {MARKED}, '</text></claim><claim><text>new</text></claim></synthesis>') WHEN 1 THEN '<synthesis><claim>' END"""
RESOLVED = f""" WITH d AS (SELECT doc_id, doc_id % 4 AS p, doc_id % 3 AS f, {BODY} AS body FROM documents), t AS (SELECT *, CASE WHEN p < 2 THEN 'patch' WHEN p = 3 THEN 'abort' WHEN f = 0 THEN 'full' WHEN f = 1 THEN 'heuristic' ELSE 'abort' END AS taken FROM d)
SELECT doc_id AS draft_id, taken, CASE WHEN taken = 'full' THEN concat(body, ':majority|new:') WHEN p = 0 THEN concat('old:consensus|', body, ':divided') ELSE 'old:consensus' END AS claims FROM t"""


def tried(t, patch: str, full: str, patch_fails: str, full_fails: str):
    """The patch and the full reply of each document as a draft."""
    d = t("documents")
    ways = [d.select(F.col("doc_id").alias("draft_id"), F.lit(way).alias("way"), F.expr(reply).alias("reply"), F.expr(fails).alias("error")) for way, reply, fails in (("patch", patch, patch_fails), ("full", full, full_fails))]
    return ways[0].unionByName(ways[1])


@query("resolved_syntheses", RESOLVED)
def resolved_syntheses(t):
    old = "array(named_struct('text', 'old', 'agreement_level', 'consensus', 'sources', array('s'), 'counterarguments', array(), 'support_level', NULL, 'evidence_grade', NULL, 'method', NULL, 'year', NULL, 'lineage', NULL, 'quotes', array(), 'node_refs', array()))"
    drafts = t("documents").select(F.col("doc_id").alias("draft_id"), F.expr(old).cast(replies.CLAIMS).alias("claims"))
    got = replies.resolved_syntheses(drafts, tried(t, PATCH, FULL, "doc_id % 4 = 3", "doc_id % 3 = 2"))
    return got.select("draft_id", "taken", F.expr("array_join(transform(claims, c -> concat(c.text, ':', coalesce(c.agreement_level, ''))), '|')").alias("claims"))


NODES = f""" WITH d AS (SELECT doc_id, doc_id % 4 AS p, doc_id % 3 AS f, {BODY} AS body FROM documents), t AS (SELECT *, CASE WHEN p = 0 THEN 'patch' WHEN f = 0 THEN 'full' ELSE 'heuristic' END AS taken FROM d)
SELECT doc_id AS graph_id, 'old' AS node_id, body AS claim, 'e1' AS expert_id, 'verified' AS status, taken FROM t WHERE taken <> 'full'
UNION ALL SELECT doc_id, 'p1', body, 's1', NULL, taken FROM t WHERE taken = 'patch' UNION ALL SELECT doc_id, 'g1', body, 's2', NULL, taken FROM t WHERE taken = 'full'
UNION ALL SELECT t.doc_id, concat('heuristic_n', row_number() OVER (PARTITION BY t.doc_id ORDER BY i) - 1), substr(body, 1, 200), concat('r', i), 'unverified', taken FROM t, (VALUES (3), (8)) AS x(i) WHERE taken = 'heuristic'"""


@query("resolved_graphs", NODES)
def resolved_graphs(t):
    d = t("documents").withColumn("body", F.expr(BODY))
    nodes = d.select(F.col("doc_id").alias("graph_id"), F.lit("old").alias("node_id"), F.col("body").alias("claim"), F.lit("e1").alias("expert_id"), F.lit("verified").alias("status"))
    retrieved = d.select(F.col("doc_id").alias("graph_id"), F.col("body").alias("content"), F.explode(F.array(F.lit(3), F.lit(8))).alias("ord")).withColumn("source_id", F.concat(F.lit("r"), F.col("ord").cast("string")))
    patch = f"""CASE doc_id % 4 WHEN 0 THEN concat('<patch><add><node id="p1"><text>', {MARKED}, '</text><source>s1</source></node></add></patch>') WHEN 1 THEN '<patch><add></patch>' WHEN 2 THEN '' END"""
    full = f"""CASE doc_id % 3 WHEN 0 THEN concat('<graph><node id="g1"><text>', {MARKED}, '</text><source>s2</source></node></graph>') WHEN 1 THEN '<graph><node></graph>' END"""
    return replies.resolved_graphs(nodes, tried(t, patch, full, "doc_id % 4 = 3", "doc_id % 3 = 2"), retrieved)


def payload_table(t):
    """A payload for each document: of all kinds by its id, every eleventh cut short, every thirteenth of another shape; its paper is named by the id and titled by the text's start."""
    d = t("documents").withColumn("paper", F.expr("named_struct('paperId', concat('p', doc_id), 'title', substr(text, 1, 30), 'year', 1990 + doc_id % 30, 'citationCount', doc_id % 50, 'externalIds', IF(doc_id % 4 = 0, named_struct('ArXiv', concat('a', doc_id)), IF(doc_id % 4 = 1, named_struct('ArXiv', ' '), NULL)), 'authors', array(named_struct('name', source), named_struct('name', CAST(NULL AS STRING))))"))
    body = F.to_json("paper")
    wrapped = F.expr("""CASE doc_id % 5 WHEN 0 THEN body WHEN 1 THEN concat('{"total":2,"data":[', body, ',{"title":"no id"},null]}') WHEN 2 THEN concat('[null,', body, ',{"paperId":null}]')
        WHEN 3 THEN concat('{"data":[{"citingPaper":', body, '},{"citingPaper":null},{"citingPaper":{"paperId":"q', doc_id % 9, '","year":"soon","citationCount":7}}]}') ELSE concat('{"data":[{"citedPaper":{"paperId":"r', doc_id % 9, '"},"contexts":[]},{},{"citedPaper":', body, '}]}') END""")
    payload = F.expr("CASE WHEN doc_id % 11 = 0 THEN substr(whole, 1, 12) WHEN doc_id % 13 = 0 THEN '7' WHEN doc_id % 17 = 0 THEN ' ' WHEN doc_id % 19 = 0 THEN NULL ELSE whole END")
    kind = F.expr("CASE doc_id % 5 WHEN 0 THEN 'paper' WHEN 1 THEN 'search' WHEN 2 THEN 'batch' WHEN 3 THEN 'citations' ELSE 'references' END")
    return d.withColumn("body", body).withColumn("whole", wrapped).select(F.col("doc_id").alias("cache_key"), F.expr("concat('s2:of', doc_id)").alias("paper_id"), kind.alias("kind"), payload.alias("payload"))


PAYLOADS = """ WITH d AS (SELECT doc_id, doc_id % 5 AS k, substr(text, 1, 30) AS title, source, NOT (doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0 OR doc_id % 19 = 0) AS good FROM documents),
own AS (SELECT doc_id, CASE k WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS ord, CASE WHEN doc_id % 4 = 0 THEN concat('arxiv:a', doc_id) ELSE concat('s2:p', doc_id) END AS paper_id, coalesce(title, '') AS title, 1990 + doc_id % 30 AS year, doc_id % 50 AS citation_count, coalesce(source, '') AS authors, k FROM d WHERE good),
others AS (SELECT doc_id, CASE k WHEN 3 THEN 2 ELSE 0 END AS ord, concat(CASE k WHEN 3 THEN 's2:q' ELSE 's2:r' END, doc_id % 9) AS paper_id, '' AS title, CAST(NULL AS BIGINT) AS year, CASE k WHEN 3 THEN 7 ELSE 0 END AS citation_count, '' AS authors, k FROM d WHERE good AND k IN (3, 4)),
every AS (SELECT * FROM own UNION ALL SELECT * FROM others)"""


@query("payload_papers", PAYLOADS + """ SELECT doc_id AS cache_key, ord, paper_id, title, year, citation_count, authors, CAST(NULL AS VARCHAR) AS reason FROM every
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN doc_id % 11 = 0 THEN 'not JSON' WHEN doc_id % 13 = 0 THEN concat('not a ', CASE k WHEN 0 THEN 'paper' WHEN 1 THEN 'search' WHEN 2 THEN 'batch' WHEN 3 THEN 'citations' ELSE 'references' END, ' payload') ELSE 'empty payload' END FROM d WHERE NOT good""")
def payload_papers(t):
    p = payload_table(t)
    good = payloads.papers(p).select("cache_key", "ord", "paper_id", "title", "year", "citation_count", F.array_join("authors", ",").alias("authors"))
    return good.unionByName(payloads.failures(p).select("cache_key", "reason"), allowMissingColumns=True)


@query("payload_edges", PAYLOADS + " SELECT concat('s2:of', doc_id) AS src, paper_id AS dst, CASE k WHEN 3 THEN 1 ELSE 0 END AS kind, ord AS edge_ord FROM every WHERE k IN (3, 4)")
def payload_edges(t):
    return payloads.edges(payload_table(t))
