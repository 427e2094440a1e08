"""Paper APIs' payloads of unlike shapes as VARIANT: papers, citation edges, and what could not be read, with a reason.

Kinds of payloads: `paper` (one paper), `search` (a list under `data`), `batch` (a list with nulls
for ids that are not known), `citations` and `references` (lists under `data` whose entries have
the paper under `citingPaper` or `citedPaper`).

Defined results: entries that are null, or whose paper has no paperId, are passed over but keep
their place in the order; a missing `data` is an empty list; fields that are missing or of another
type are null, a blank arXiv id or PDF address too, and counts are 0 where they are missing. A
payload that is null or blank, is no JSON, or has another shape than its kind, gives no paper and
one row of failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank

#: Where a kind's entries are and what of an entry is the paper.
SHAPES = {"paper": (None, None), "search": ("$.data", None), "batch": ("$", None), "citations": ("$.data", "$.citingPaper"), "references": ("$.data", "$.citedPaper")}


def variants(payloads: DataFrame) -> DataFrame:
    """payloads (cache_key, kind, payload) with their `entries`, an array of VARIANT, or the `reason` why there are none."""
    v = payloads.withColumn("_v", F.try_parse_json("payload"))
    entries, bad = F.lit(None).cast("array<variant>"), F.lit("unknown kind")
    for kind, (path, _) in SHAPES.items():
        if path is None:
            found = F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.array("_v"))
        else:
            found = F.try_variant_get("_v", path, "array<variant>")
            if path != "$":
                inner = F.try_variant_get("_v", path, "variant")
                missing = inner.isNull() | F.is_variant_null(inner)
                found = F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.when(missing, F.array().cast("array<variant>")).otherwise(found))
        entries = F.when(F.col("kind") == kind, found).otherwise(entries)
        bad = F.when(F.col("kind") == kind, F.when(found.isNull(), F.lit(f"not a {kind} payload"))).otherwise(bad)
    reason = F.when(F.coalesce(blank(F.col("payload")), F.lit(True)), "empty payload").when(F.col("_v").isNull(), "not JSON").otherwise(bad)
    return v.withColumns({"entries": entries, "reason": reason}).drop("_v")


def failures(payloads: DataFrame) -> DataFrame:
    """(cache_key, kind, reason) of the payloads that could not be read."""
    return variants(payloads).filter("reason IS NOT NULL").select("cache_key", "kind", "reason")


def papers(payloads: DataFrame) -> DataFrame:
    """A row for each paper of payloads (cache_key, kind, payload): its place `ord`, ids and fields."""
    each = variants(payloads).select("cache_key", "kind", F.posexplode("entries").alias("ord", "_e"))
    inner = F.col("_e")
    for kind, (_, path) in SHAPES.items():
        if path is not None:
            inner = F.when(F.col("kind") == kind, F.try_variant_get("_e", path, "variant")).otherwise(inner)
    p = each.withColumn("_p", inner)

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get("_p", path, kind)

    def filled(path: str) -> Column:
        return F.when(~blank(get(path, "string")), get(path, "string"))

    arxiv, s2 = filled("$.externalIds.ArXiv"), get("$.paperId", "string")
    authors = F.filter(F.transform(F.coalesce(get("$.authors", "array<variant>"), F.array().cast("array<variant>")), lambda a: F.try_variant_get(a, "$.name", "string")), lambda n: n.isNotNull())
    return p.filter(s2.isNotNull()).select(
        "cache_key", "kind", "ord", F.when(arxiv.isNotNull(), F.concat(F.lit("arxiv:"), arxiv)).otherwise(F.concat(F.lit("s2:"), s2)).alias("paper_id"), s2.alias("s2_paper_id"), arxiv.alias("arxiv_id"), get("$.externalIds.DOI", "string").alias("doi"),
        F.coalesce(get("$.title", "string"), F.lit("")).alias("title"), get("$.abstract", "string").alias("abstract"), get("$.year", "int").alias("year"), get("$.venue", "string").alias("venue"),
        *(F.coalesce(get(f"$.{name}", "bigint"), F.lit(0).cast("bigint")).alias(alias) for name, alias in (("citationCount", "citation_count"), ("influentialCitationCount", "influential_count"), ("referenceCount", "reference_count"))),
        authors.alias("authors"), filled("$.openAccessPdf.url").alias("open_access_pdf_url"),
    )


def edges(payloads: DataFrame) -> DataFrame:
    """(src, dst, kind, edge_ord) out of `citations` (kind 1) and `references` (kind 0) payloads of the papers in `paper_id`; for `graph.frontier`."""
    around = payloads.filter(F.col("kind").isin("citations", "references"))
    found = papers(around.select(F.struct("cache_key", "paper_id").alias("cache_key"), "kind", "payload"))
    return found.select(F.col("cache_key.paper_id").alias("src"), F.col("paper_id").alias("dst"), (F.col("kind") == "citations").cast("int").alias("kind"), F.col("ord").alias("edge_ord"))
