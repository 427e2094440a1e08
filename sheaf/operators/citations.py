"""Author-year citations, markers, reference lists; lints of plans and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, occurrences, sections, statements, strip, tag_bodies, tag_body
from .retrieval import first_seen

#: Phrases that a review must not have.
BANNED_PHRASES = ("it is important to note", "plays a crucial role", "in conclusion", "a growing body of literature", "further research is needed")
MIN_COVERAGE, MOST_SECTIONS = 0.6, 2


def surname(author: Column) -> Column:
    """What stands before a comma, or the last word."""
    name = strip(author)
    head = strip(F.split(name, ",")[0])
    return F.when(F.contains(name, F.lit(",")) & (head != ""), head).otherwise(F.element_at(F.split(name, r"\s+"), -1))


def author_year(authors: Column, year: Column) -> Column:
    """`A, 2020`, `A & B, 2020`, `A et al., n.d.`; null without authors."""
    n = F.size(authors)
    when = F.coalesce(year.cast("string"), F.lit("n.d."))
    first, second = surname(F.try_element_at(authors, F.lit(1))), surname(F.try_element_at(authors, F.lit(2)))
    names = F.when(n == 1, first).when(n == 2, F.concat_ws(" & ", first, second)).when(n > 2, F.concat(first, F.lit(" et al.")))
    return F.when(n > 0, F.concat_ws(", ", names, when))


def cited(sources: DataFrame, papers: DataFrame, key: str = "claim_id") -> DataFrame:
    """(key, citation): a claim's sources rendered in order, equal renderings once; ids of unknown papers as they are."""
    meta = papers.select("source_id", author_year(F.col("authors"), F.col("year")).alias("_shown"))
    shown = sources.join(meta, "source_id", "left").withColumn("shown", F.coalesce("_shown", "source_id"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("source_ord", "shown"))), lambda s: s["shown"])
    return shown.groupBy(key).agg(F.concat(F.lit("("), F.array_join(F.array_distinct(ordered), "; "), F.lit(")")).alias("citation"))


def references(sources: DataFrame, papers: DataFrame) -> DataFrame:
    """(ord, line): a line for each source in first-seen order: head, title and URL, without blank ones."""
    once = first_seen(sources, ["source_id"], "claim_id", "source_ord")
    known = once.join(papers.select("source_id", author_year(F.col("authors"), F.col("year")).alias("head"), "title", "url"), "source_id", "left")
    line = F.concat(F.lit("- "), F.concat_ws(". ", F.coalesce("head", "source_id"), *(F.when(~blank(F.col(c)), strip(F.col(c))) for c in ("title", "url"))))
    return known.select("source_id", "claim_id", "source_ord", line.alias("line"))


CITED_MARKER, ANY_BRACKET = r"\[[^\[\]]*\]|[^\[]+|\[", r"\[[^\]]*\]|[^\[]+|\["


def marker_ids(token: Column) -> Column:
    """The claim numbers in `[C1, C3]`; null for other tokens."""
    inner = F.regexp_extract(token, r"^\[\s*(C\d+(?:\s*,\s*C\d+)*)\s*\]$", 1)
    return F.when(inner != "", F.transform(F.split(inner, r"\s*,\s*"), lambda c: F.substring(c, 2, 20).cast("long")))


def sanitised(documents: DataFrame, claims: DataFrame) -> DataFrame:
    """documents (doc, text) whose markers name claims (doc, claim_no) that exist only; markers without any go."""
    tokens = documents.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(ANY_BRACKET), 0)).alias("pos", "token")).withColumn("ids", marker_ids(F.col("token")))
    valid = tokens.filter("ids is not null").select("doc", "pos", F.posexplode("ids").alias("i", "claim_no")).join(claims.select("doc", "claim_no").distinct(), ["doc", "claim_no"])
    valid = valid.groupBy("doc", "pos").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "claim_no"))), lambda x: F.concat(F.lit("C"), x["claim_no"].cast("string"))), ", "), F.lit("]")).alias("kept"))
    shown = F.when(F.col("ids").isNull(), F.col("token")).otherwise(F.coalesce("kept", F.lit("")))
    out = tokens.join(valid, ["doc", "pos"], "left").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("t")))), lambda x: x["t"]), "").alias("text"))
    return documents.select("doc").join(out, "doc", "left").withColumn("text", F.coalesce("text", F.lit("")))


def with_citations(documents: DataFrame, claims: DataFrame, sources: DataFrame, papers: DataFrame) -> DataFrame:
    """documents (doc, text) with markers, all of whose claims (doc, claim_no, claim_id) exist, as one citation of their sources; others stay."""
    tokens = documents.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(CITED_MARKER), 0)).alias("pos", "token")).withColumn("ids", marker_ids(F.col("token")))
    named = tokens.filter("ids is not null").select("doc", "pos", F.size("ids").alias("n"), F.posexplode("ids").alias("i", "claim_no")).join(claims, ["doc", "claim_no"], "left")
    whole = named.groupBy("doc", "pos").agg(F.count("claim_id").alias("have"), F.first("n").alias("n")).filter("have = n").select("doc", "pos")
    used = named.join(whole, ["doc", "pos"]).join(sources, "claim_id").select(F.struct("doc", "pos").alias("at"), (F.col("i") * 1_000_000 + F.col("source_ord")).alias("source_ord"), "source_id")
    used = first_seen(used, ["at", "source_id"], "source_ord")
    shown = cited(used, papers, "at").select("at.doc", "at.pos", "citation")
    out = tokens.join(shown, ["doc", "pos"], "left").withColumn("t", F.coalesce("citation", "token"))
    out = out.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "").alias("text"))
    return documents.select("doc").join(out, "doc", "left").withColumn("text", F.coalesce("text", F.lit("")))


def statement_refs(documents: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc, pos, statement, claim_refs): statements that refer to a claim that exists, with the claims in order."""
    each = documents.select("doc", F.posexplode(statements(F.col("text"))).alias("pos", "statement"))
    refs = each.select("doc", "pos", "statement", F.posexplode(F.flatten(F.transform(F.regexp_extract_all("statement", F.lit(r"\[[^\]]*\]"), 0), lambda m: F.regexp_extract_all(m, F.lit(r"C(\d+)"), 1)))).alias("i", "claim_no"))
    known = refs.withColumn("claim_no", F.col("claim_no").cast("long")).join(claims.select("doc", "claim_no").distinct(), ["doc", "claim_no"])
    return known.groupBy("doc", "pos", "statement").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", "claim_no"))), lambda x: x["claim_no"])).alias("claim_refs"))


def plan_of(reply: Column) -> Column:
    """A struct of a review plan's fields out of a reply; null without plan, archetype or focal question."""
    plan = tag_body(reply, "plan")
    archetype, question = strip(tag_body(plan, "archetype")), strip(tag_body(plan, "focal_question"))
    parts = F.transform(tag_bodies(plan, "section"), lambda s: F.struct(strip(tag_body(s, "heading")).alias("heading"), strip(tag_body(s, "budget")).try_cast("int").alias("budget_words"), F.filter(F.transform(F.split(F.coalesce(tag_body(s, "claims"), F.lit("")), ","), strip), lambda c: c != "").alias("claim_ids")))
    return F.when(~blank(archetype) & ~blank(question), F.struct(archetype.alias("archetype"), question.alias("focal_question"), parts.alias("sections")))


def plan_vetoes(plan_sections: DataFrame, claims: DataFrame) -> DataFrame:
    """(plan_id, reason, detail) of each plan's first fault: an id that does not exist, one given more than two times, coverage of the claims under 0.6.

    plan_sections (plan_id, section_ord, claim_ids); claims (plan_id, claim_no) has claims
    (`C1`) and tensions (`T1`). A plan without sections passes.
    """
    ids = plan_sections.select("plan_id", "section_ord", F.posexplode("claim_ids").alias("i", "claim_no"))
    real = claims.select("plan_id", "claim_no").distinct()
    unknown = ids.join(real, ["plan_id", "claim_no"], "left_anti").groupBy("plan_id").agg(F.min_by("claim_no", F.struct("section_ord", "i")).alias("detail")).select("plan_id", F.lit(1).alias("n"), F.lit("unknown_id").alias("reason"), "detail")
    often = ids.groupBy("plan_id", "claim_no").agg(F.count("*").alias("k")).filter(F.col("k") > MOST_SECTIONS).groupBy("plan_id").agg(F.min("claim_no").alias("detail")).select("plan_id", F.lit(2).alias("n"), F.lit("too_many_sections").alias("reason"), "detail")
    counted = real.filter(F.col("claim_no").startswith("C"))
    used = ids.join(counted, ["plan_id", "claim_no"]).groupBy("plan_id").agg(F.count_distinct("claim_no").alias("m"))
    share = F.coalesce("m", F.lit(0)) / F.col("k")
    low = plan_sections.select("plan_id").distinct().join(counted.groupBy("plan_id").agg(F.count("*").alias("k")), "plan_id").join(used, "plan_id", "left").filter(share < MIN_COVERAGE).select("plan_id", F.lit(3).alias("n"), F.lit("low_coverage").alias("reason"), F.format_string("%.2f", share).alias("detail"))
    return unknown.unionByName(often).unionByName(low).groupBy("plan_id").agg(F.min_by(F.struct("reason", "detail"), "n").alias("f")).select("plan_id", "f.reason", "f.detail")


def plan_core_fault(terms: Column, threads: Column) -> Column:
    """What a plan must have and has not: a term registry, then planted threads (counts of them)."""
    return F.when(terms == 0, "term_registry is empty").when(threads == 0, "planted_threads is empty")


def phrase_hits(documents: DataFrame, phrases: tuple[str, ...] = BANNED_PHRASES) -> DataFrame:
    """(doc, phrase) of phrases in documents, whatever the case; the list is fixed and small."""
    low = F.lower("text")
    found = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, F.lower(p)))
    return documents.select("doc", F.explode(found).alias("phrase"))


def drifting_terms(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc, term, banned) of a plan's banned synonyms (doc, term, banned array) in its document."""
    each = registry.select("doc", "term", F.explode("banned").alias("banned")).filter(~blank(F.col("banned")))
    return documents.join(each, "doc").filter(F.contains(F.lower("text"), F.lower(strip(F.col("banned"))))).select("doc", "term", "banned")


def first_sections(documents: DataFrame) -> DataFrame:
    """(doc, key, body) of the first section of each heading, whatever its case."""
    parts = documents.select("doc", F.posexplode(sections(F.col("text"))).alias("pos", "s"))
    return parts.groupBy("doc", F.lower("s.heading").alias("key")).agg(F.min_by("s.body", "pos").alias("body"))


def budget_hits(documents: DataFrame, plan_sections: DataFrame) -> DataFrame:
    """(doc, heading, words, ratio, problem): planned sections that are missing, or whose words are under half or over twice a budget that they have."""
    have = first_sections(documents).select("doc", "key", F.size(F.filter(F.split("body", r"\s+"), lambda w: w != "")).alias("words"))
    ratio = F.col("words") / F.nullif(F.col("budget_words"), F.lit(0))
    out = plan_sections.withColumn("key", F.lower("heading")).join(have, ["doc", "key"], "left").withColumn("ratio", ratio)
    return out.withColumn("problem", F.when(F.col("words").isNull(), "missing").when((ratio < 0.5) | (ratio > 2.0), "budget")).filter("problem is not null").select("doc", "heading", "words", "ratio", "problem")


def thread_hits(documents: DataFrame, threads: DataFrame) -> DataFrame:
    """(doc, marker, times, problem) of threads (doc, marker, payoff) that do not come back: fewer than two times, or, in a document with sections, not in their payoff section. Case counts for nothing."""
    mark = F.lower(strip(F.col("marker")))
    parts = documents.select("doc", F.explode(sections(F.col("text"))).alias("s"))
    bodies = parts.groupBy("doc", F.lower("s.heading").alias("key")).agg(F.array_join(F.collect_list(F.lower("s.body")), "\n").alias("body"))
    sectioned = parts.select("doc", F.lit(True).alias("sectioned")).distinct()
    met = threads.filter(~blank(F.col("marker"))).join(documents, "doc").withColumn("key", F.lower("payoff")).join(bodies, ["doc", "key"], "left").join(sectioned, "doc", "left")
    met = met.withColumn("times", occurrences(F.lower("text"), mark))
    unpaid = F.col("sectioned") & (F.coalesce("payoff", F.lit("")) != "") & ~F.coalesce(F.contains("body", mark), F.lit(False))
    return met.withColumn("problem", F.when(F.col("times") < 2, "needs setup and payoff").when(unpaid, "not in its payoff section")).filter("problem is not null").select("doc", "marker", "times", "problem")


def digest(claims: DataFrame, tensions: DataFrame) -> DataFrame:
    """(doc, digest): each document's claims (claim_no, support_level, evidence_grade, text) and tensions (tension_no, text), in order."""

    def listed(df: DataFrame, order: str, line: Column, name: str) -> DataFrame:
        return df.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda x: F.concat(x["l"], F.lit("\n"))), "").alias(name))

    claim = F.concat(F.lit("[C"), F.col("claim_no").cast("string"), F.lit("] (support: "), F.coalesce("support_level", F.lit("unknown")), F.lit("; evidence: "), F.coalesce("evidence_grade", F.lit("unknown")), F.lit(") "), "text")
    tension = F.concat(F.lit("[T"), F.col("tension_no").cast("string"), F.lit("] "), "text")
    both = listed(claims, "claim_no", claim, "c").join(listed(tensions, "tension_no", tension, "t"), "doc", "left")
    return both.select("doc", F.concat(F.lit("## Corpus digest (full texts — not titles)\n\n### Claims\n\n"), "c", F.lit("\n### Tensions\n\n"), F.coalesce("t", F.lit("(none recorded)\n"))).alias("digest"))


def mergeable(candidates: DataFrame, plan_sections: DataFrame) -> DataFrame:
    """(doc, sectionable): whether every planned heading is in two candidates (doc, candidate, text) or more."""
    have = candidates.select("doc", "candidate", F.explode(sections(F.col("text"))).alias("s")).select("doc", "candidate", F.col("s.heading").alias("heading")).distinct().groupBy("doc", "heading").agg(F.count("*").alias("n"))
    return plan_sections.select("doc", "heading").distinct().join(have, ["doc", "heading"], "left").groupBy("doc").agg(F.min(F.coalesce("n", F.lit(0)) >= 2).alias("sectionable"))


def grouped_by_relation(edges: DataFrame, nodes: DataFrame, chars: int = 60) -> DataFrame:
    """(relation, line): edges with the first characters of both claims, for a graph's Markdown."""
    short = nodes.select("node_id", F.when(F.length("claim") > chars, F.concat(F.substring("claim", 1, chars), F.lit("…"))).otherwise(F.col("claim")).alias("short"))
    a, b = short.toDF("source", "a"), short.toDF("target", "b")
    return edges.join(a, "source").join(b, "target").select("relation", F.concat(F.lit("- "), "a", F.lit(" → "), "b").alias("line"))
