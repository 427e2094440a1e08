"""Replies of models: marked-up syntheses, graphs and patches, parsed with a verdict, and drafts that they change.

A reply's markup is read into a tree of elements, as far as it goes. What is wanted of it is
taken from the closed elements. A verdict (`status`) tells how it ended:

- `ok`: to its end;
- `empty`: a synthesis patch without anything in it, which leaves the draft as it is;
- `cut`: it broke off, or its tags don't match; what was closed before that is kept;
- `failed`: there is nothing to use. Which replies fail and which are only cut depends on the kind.

Defined results: a null reply fails; names of tags and attributes are case-sensitive; attributes
are taken as they are written, texts with their entities resolved and each run of text trimmed; a
run with an unknown entity counts as none; comments, CDATA and instructions are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .graph import fallen_back, heuristic_nodes
from .provenance import AGREEMENT_LEVELS, SUPPORT_LEVELS

#: Of each kind: the block that is looked for, whether there must be one, and whether broken markup fails it.
KINDS = {
    "extraction": ("graph", False, False), "resolution": ("resolution", False, False), "graph_patch": ("patch", True, True),
    "full_graph": ("graph", True, True), "synthesis": ("synthesis", True, False), "synthesis_patch": ("patch", True, False),
}
#: The label of a claim in the first profile if it has none, and of one that a patch adds.
DEFAULT_AGREEMENT = "divided"
FREE_FIELDS = ("evidence_grade", "method", "year", "lineage")

CLAIM = "text string, agreement_level string, sources array<string>, counterarguments array<string>, support_level string, evidence_grade string, method string, year string, lineage string, quotes array<struct<source:string,text:string,node_id:string>>, node_refs array<string>"
CLAIMS = f"array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in re.split(r', (?=[a-z_]+ )', CLAIM))}>>"
SYNTHESIS = f"struct<claims:{CLAIMS},agreement:array<string>,disagreement:array<string>,uncertainties:array<string>,gaps:array<struct<description:string,type:string>>,narrative:string>"
GRAPH = "struct<nodes:array<struct<id:string,claim:string,expert_id:string,quote:string>>,edges:array<struct<source:string,target:string,relation:string>>>"
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|<(/?)([^\s/<>!?]+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
ENTITY = re.compile(r"&([^;&\s]*);?")


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parts: list[Element | str] = field(default_factory=list)
    closed: bool = False
    #: Written as one tag.
    single: bool = False

    def below(self) -> Iterator[Element | str]:
        """Elements and runs of text below this one, in order of their starts; however deep, for replies may nest as they like."""
        left = self.parts[::-1]
        while left:
            yield (p := left.pop())
            if isinstance(p, Element):
                left += p.parts[::-1]

    def all(self, *tags: str) -> Iterator[Element]:
        """Elements of these tags below this one; not only closed ones."""
        return (p for p in self.below() if isinstance(p, Element) and p.tag in tags)

    def filled(self, *tags: str) -> Iterator[Element]:
        """Those that have a start and an end."""
        return (e for e in self.all(*tags) if e.closed and not e.single)

    def runs(self) -> list[str]:
        """The runs of text in it."""
        return [p for p in self.below() if isinstance(p, str)]

    def text(self) -> str:
        return "".join(self.runs()).strip()


def resolved(text: str) -> str:
    """text with its entities resolved; nothing if one is unknown."""
    out, at = [], 0
    for m in ENTITY.finditer(text):
        name = m[1]
        if not m[0].endswith(";"):
            return ""
        if name.startswith("#"):
            digits, base = (name[2:], 16) if name[1:2] == "x" else (name[1:], 10)
            try:
                found = chr(int(digits, base))
            except (ValueError, OverflowError):
                return ""
        elif name in NAMED:
            found = NAMED[name]
        else:
            return ""
        out += [text[at : m.start()], found]
        at = m.end()
    return "".join([*out, text[at:]])


def tree(markup: str) -> tuple[Element, bool]:
    """(the elements as far as they go, whether that is to the end)."""
    root = Element("", {})
    stack, at = [root], 0

    def put(text: str) -> None:
        if text := text.strip(" \t\r\n"):
            stack[-1].parts.append(resolved(text))

    while (start := markup.find("<", at)) >= 0:
        put(markup[at:start])
        m = MARKUP.match(markup, start)
        if m is None:
            return root, False
        at = m.end()
        if m[2] is None:
            continue
        if m[1]:
            if len(stack) == 1 or stack[-1].tag != m[2]:
                return root, False
            stack.pop().closed = True
            continue
        made = Element(m[2], {k: a or b for k, a, b in ATTRIBUTE.findall(m[3])})
        stack[-1].parts.append(made)
        if m[4]:
            made.closed = made.single = True
        else:
            stack.append(made)
    put(markup[at:])
    return root, len(stack) == 1


def block(reply: str, tag: str) -> str | None:
    """From the first `<tag` to the first `</tag>` after it."""
    start = reply.find(f"<{tag}")
    end = reply.find(f"</{tag}>", start) if start >= 0 else -1
    return reply[start : end + len(tag) + 3] if end >= 0 else None


def last(elements: Iterator[Element], default: str | None = None) -> str | None:
    """The text of the last one that has some."""
    return ([x for e in elements if (x := e.text())] or [default])[-1]


def claim_of(e: Element, profile: str) -> dict | None:
    """A claim; none if it has no text."""
    text = [*e.filled("text")][-1:]
    if not text or not text[0].text():
        return None
    found = e.attributes["agreement"].strip() if "agreement" in e.attributes else None
    found = last(e.filled("agreement_level"), found)
    fallback = DEFAULT_AGREEMENT if profile == "v1" else None
    support = (last(e.filled("support_level")) or "").lower()
    quotes = [{"source": q.attributes.get("source", "").strip(), "text": q.text(), "node_id": q.attributes.get("node", "").strip() or None} for q in e.filled("quote")]
    return {
        "text": text[0].text(),
        "agreement_level": found if found in AGREEMENT_LEVELS else fallback,
        "sources": [v for s in e.all("source") for k, v in s.attributes.items() if k in ("id", "expert_id")],
        "counterarguments": [t for c in e.filled("counterargument") if (t := c.text())],
        "support_level": support if support in SUPPORT_LEVELS else None,
        **{name: last(e.filled(name)) for name in FREE_FIELDS},
        "quotes": [q for q in quotes if q["source"] and q["text"]],
        "node_refs": [t for r in e.filled("ref") if (t := r.text())],
    }


def synthesis_of(root: Element, profile: str) -> dict:
    def items(section: str, *tags: str) -> list[str]:
        return [t for s in root.all(section) for e in s.filled(*tags) if (t := e.text())]

    loose = [t for e in root.filled("uncertainty") if (t := e.text())]
    return {
        "claims": [c for e in root.filled("claim") if (c := claim_of(e, profile))],
        "agreement": items("areas_of_agreement", "area", "item"), "disagreement": items("areas_of_disagreement", "area", "item"),
        "uncertainties": items("uncertainties", "area", "item") + loose,
        "gaps": [{"description": t, "type": g.attributes.get("type", "").strip() or None} for s in root.all("gaps") for g in s.filled("gap") if (t := g.text())],
        "narrative": ([e.text() for e in root.filled("narrative")] or [""])[-1],
    }


def additions_of(root: Element) -> dict:
    """The claims that a patch adds, divided ones without sources."""
    empty = {"agreement": [], "disagreement": [], "uncertainties": [], "gaps": [], "narrative": ""}
    bare = {"sources": [], "counterarguments": [], "support_level": None, **dict.fromkeys(FREE_FIELDS), "quotes": [], "node_refs": []}
    texts = ("".join(r for t in c.all("text") for r in t.runs()).strip() for a in root.all("add") for c in a.filled("claim"))
    return {"claims": [{"text": t, "agreement_level": DEFAULT_AGREEMENT, **bare} for t in texts if t], **empty}


def graph_of(root: Element, kind: str, expert: str) -> dict:
    def run(e: Element, tag: str) -> str | None:
        found = [r for t in e.all(tag) for r in t.runs()]
        return found[-1] if found else None

    nodes, edges = [], []
    if kind != "resolution":
        within = [*root.all("add")] if kind == "graph_patch" else [root]
        for e in (e for w in within for e in w.filled("node") if "id" in e.attributes):
            name, whose = e.attributes["id"], run(e, "source") or ""
            if kind == "extraction":
                name, whose = name.strip(), expert
                name = name if name == expert or name.startswith(f"{expert}_") else f"{expert}_{name}"
            nodes.append({"id": name, "claim": run(e, "text") or "", "expert_id": whose, "quote": run(e, "quote") if kind != "graph_patch" else None})
    else:
        for e in root.all("edge"):
            ends = [e.attributes.get(k) for k in ("from", "to", "type")]
            if e.closed and None not in ends:
                edges.append(dict(zip(("source", "target", "relation"), ends, strict=True)))
    return {"nodes": nodes, "edges": edges}


def verdict(kind: str, reply: str | None, profile: str = "v2", expert: str = "") -> tuple[str, dict | None, dict | None]:
    """(status, synthesis, graph) of one reply."""
    tag, needed, strict = KINDS[kind]
    found = block(reply or "", tag)
    if reply is None or (found is None and needed):
        return "failed", None, None
    markup = reply if found is None else found
    if kind == "synthesis_patch" and re.sub(r"\s", "", markup) == "<patch></patch>":
        return "empty", additions_of(Element("", {})), None
    root, whole = tree(markup)
    if not whole and strict:
        return "failed", None, None
    status = "ok" if whole else "cut"
    if kind.startswith("synthesis"):
        return status, additions_of(root) if kind == "synthesis_patch" else synthesis_of(root, profile), None
    return status, None, graph_of(root, kind, expert)


def parsed(replies: DataFrame) -> DataFrame:
    """Each of replies (reply_id, kind, reply; profile `v1` or `v2`; expert_id) with its status, synthesis and graph.

    kind is one of KINDS; `profile`, which decides on a claim's agreement, is v2 where the column
    is missing or null; `expert_id`, of extractions, is empty. Other columns are left out.
    """
    given = [F.col(c) if c in replies.columns else F.lit(None).cast("string").alias(c) for c in ("profile", "expert_id")]
    source = replies.select("reply_id", "kind", "reply", *given)
    schema = T.StructType([source.schema["reply_id"], *T._parse_datatype_string(f"status string, synthesis {SYNTHESIS}, graph {GRAPH}").fields])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [verdict(kind, reply, profile or "v2", expert or "") for kind, reply, profile, expert in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)]
            columns = [pa.array([r[i] for r in rows], types.field(i + 1).type) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["reply_id", "status", "synthesis", "graph"])

    return source.mapInArrow(run, schema)


def outcomes(tried: DataFrame, kind: str) -> DataFrame:
    """The replies (draft_id, way `patch` or `full`, reply, error) that were tried for drafts, parsed, with their outcome.

    An outcome is `error` where the call failed, `unparsed` where the reply did, and else `parsed`.
    """
    of = F.when(F.col("way") == "patch", f"{kind}_patch").otherwise("full_graph" if kind == "graph" else "synthesis")
    key = F.struct("draft_id", "way", F.coalesce("error", F.lit(False)).alias("error"))
    got = parsed(tried.select(key.alias("reply_id"), of.alias("kind"), "reply"))
    outcome = F.when(F.col("reply_id.error"), "error").when(F.col("status") == "failed", "unparsed").otherwise("parsed")
    return got.select("reply_id.draft_id", "reply_id.way", "status", outcome.alias("outcome"), "synthesis", "graph")


def resolved_syntheses(drafts: DataFrame, tried: DataFrame) -> DataFrame:
    """(draft_id, taken, claims) of drafts (draft_id, claims) whose gaps the replies in tried (see `outcomes`) close.

    A patch that was parsed adds its claims, or nothing if it is empty; a full synthesis takes the
    draft's place; where neither was parsed (`heuristic`) the draft stays as it is, for the caller's
    heuristic, and so it does where a call's error ended it (`abort`). Drafts without a reply are
    heuristic ones.
    """
    got = outcomes(tried, "synthesis").withColumn("claims", F.col("synthesis.claims"))
    way = fallen_back(got.select("draft_id", "way", "outcome"), "synthesis")
    chosen = got.filter("outcome = 'parsed'").join(way, "draft_id").filter("way = taken").select("draft_id", F.col("claims").alias("made"))
    kind = next(f.dataType for f in drafts.schema if f.name == "claims")
    out = drafts.join(way, "draft_id", "left").join(chosen, "draft_id", "left")
    claims = F.when(F.col("taken") == "patch", F.concat("claims", F.col("made").cast(kind))).when(F.col("taken") == "full", F.col("made").cast(kind)).otherwise(F.col("claims"))
    return out.select("draft_id", F.coalesce("taken", F.lit("heuristic")).alias("taken"), claims.alias("claims"))


def resolved_graphs(nodes: DataFrame, tried: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Nodes (graph_id, node_id, claim, expert_id, status) of graphs whose gaps the replies in tried close, with the way taken.

    draft_id in tried is the graph_id. A patch adds its nodes, a full graph replaces them, and
    where neither was parsed each item retrieved for the graph (graph_id, ord, source_id, content)
    becomes a node; graphs without a reply stay.
    """
    got = outcomes(tried, "graph")
    way = fallen_back(got.select("draft_id", "way", "outcome"), "graph").withColumnRenamed("draft_id", "graph_id")
    fields = ("node_id", "claim", "expert_id", "status")
    chosen = got.filter("outcome = 'parsed'").withColumnRenamed("draft_id", "graph_id").join(way, "graph_id").filter("way = taken")
    made = chosen.select("graph_id", F.inline("graph.nodes")).select("graph_id", F.col("id").alias("node_id"), "claim", "expert_id", F.lit(None).cast("string").alias("status"))
    kept = nodes.join(way, "graph_id", "left").filter("taken IS NULL OR taken <> 'full'").select("graph_id", *fields)
    asked = retrieved.join(way.filter("taken = 'heuristic'").select("graph_id"), "graph_id", "left_semi")
    added = heuristic_nodes(nodes.limit(0), asked)
    return kept.unionByName(made).unionByName(added).join(way, "graph_id", "left").select("graph_id", *fields, "taken")


def lost_sources(replies: DataFrame) -> Column:
    """Whether a parsed synthesis has claims and none of them a source: the reply's shape has drifted."""
    claims = F.col("synthesis.claims") if "synthesis" in replies.columns else F.col("claims")
    return (F.size(claims) > 0) & ~F.exists(claims, lambda c: F.size(c["sources"]) > 0)
