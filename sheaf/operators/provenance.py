"""Claims and their sources; quotes and where they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import blank, content_tokens, sentences, strip
from .fitness import valid_source, with_membership
from .retrieval import first_seen

MIN_OVERLAP, SNAP_SCORE, INHERIT_SCORE = 4, 0.55, 0.5
SUPPORT_LEVELS = ("established", "converging", "contested", "emerging", "single-source")
AGREEMENT_LEVELS = ("consensus", "majority", "divided", "minority")
NOT_SOURCES = ("system", "system_resolution")


def prefixes(text: Column) -> Column:
    """The text, and every part of it before a `_` or `:`."""
    cuts = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, 1).isin("_", ":"))
    return F.when(F.length(text) > 0, F.concat(F.array(text), F.transform(cuts, lambda i: F.substring(text, F.lit(1), i - 1)))).otherwise(F.array(text))


def panel_id_of(rows: DataFrame, panel: DataFrame, column: str, *key: str) -> DataFrame:
    """rows with `column` as the longest panel id that it is, or goes on from by `_` or `:`; else as it was.

    The id is tried without what follows its first `:` and without `new_`, then as it stands.
    Every part that could match is joined by equality, not by comparing all ids with all.
    """
    raw = F.col(column)
    bare = F.regexp_replace(F.split(raw, ":", 2)[0], "^new_", "")
    tried = rows.select(*key, F.explode(F.concat(F.transform(prefixes(bare), lambda p: F.struct(F.lit(1).alias("try"), p.alias("_id"))), F.transform(prefixes(raw), lambda p: F.struct(F.lit(0).alias("try"), p.alias("_id"))))).alias("t")).select(*key, "t.try", "t._id")
    found = tried.join(panel.select(F.col("source_id").alias("_id")).distinct(), "_id").groupBy(*key).agg(F.max_by("_id", F.struct("try", F.length("_id"))).alias("_found"))
    return rows.join(found, [*key], "left").withColumn(column, F.coalesce("_found", raw)).drop("_found")


def normalised_sources(sources: DataFrame, panel: DataFrame) -> DataFrame:
    """Claim sources (claim_id, source_ord, source_id) as panel ids, each once for a claim, in first-seen order."""
    return first_seen(panel_id_of(sources, panel, "source_id", "claim_id", "source_ord"), ["claim_id", "source_id"], "source_ord")


def without_invalid(rows: DataFrame, panel: DataFrame, column: str = "source_id", counters: Observation | None = None) -> DataFrame:
    """rows of valid sources; counters, if given, observes `n` rows and how many are `stripped` when the result is computed."""
    judged = with_membership(rows, panel, column).withColumn("_valid", F.coalesce(valid_source(F.col(column), F.col("member")), F.lit(False)))
    if counters is not None:
        judged = judged.observe(counters, F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_valid")).alias("stripped"))
    return judged.filter("_valid").drop("member", "_valid")


def agreement(claims: DataFrame, sources: DataFrame, panel: DataFrame) -> DataFrame:
    """claims (claim_id, agreement_level) with the level that their distinct sources over the panel's size give; kept where either is none."""
    counts = sources.filter(~F.col("source_id").isin(*NOT_SOURCES)).groupBy("claim_id").agg(F.count_distinct("source_id").alias("n_sources"))
    size = panel.agg(F.count_distinct("source_id").alias("n_panel"))  # one row
    ratio = F.col("n_sources") / F.nullif(F.col("n_panel"), F.lit(0))
    level = F.when(ratio >= 0.75, "consensus").when(ratio >= 0.5, "majority").when(ratio >= 0.15, "divided").when(ratio.isNotNull(), "minority").otherwise(F.col("agreement_level"))
    return claims.join(counts, "claim_id", "left").crossJoin(F.broadcast(size)).withColumn("agreement_level", level)


def coverage(panel: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(panel members that no claim cites, one row with the share that is cited; 1 for an empty panel)."""
    missing = panel.join(sources.select("source_id").distinct(), "source_id", "left_anti")
    ratio = panel.agg(F.count_distinct("source_id").alias("n")).crossJoin(missing.agg(F.count_distinct("source_id").alias("m")))
    return missing, ratio.select(F.when(F.col("n") == 0, 1.0).otherwise((F.col("n") - F.col("m")) / F.col("n")).alias("coverage"))


def minority_only(claims: DataFrame, sources: DataFrame, reports: DataFrame) -> DataFrame:
    """Sources that only claims of the minority level cite, without a report of theirs."""
    cited = sources.join(claims.select("claim_id", "agreement_level"), "claim_id").groupBy("source_id").agg(F.max(F.coalesce(F.col("agreement_level") != "minority", F.lit(True))).alias("other"), F.count_distinct("claim_id").alias("n_claims"))
    return cited.filter(~F.col("other")).join(reports.select("source_id").distinct(), "source_id", "left_anti").select("source_id", "n_claims")


def support_level(label: Column) -> Column:
    text = F.lower(strip(label))
    return F.when(text.isin(*SUPPORT_LEVELS), text)


def agreement_label(label: Column, profile: str = "v1") -> Column:
    """A label of the vocabulary; others are `divided` (v1) or null."""
    text = F.lower(strip(label))
    return F.when(text.isin(*AGREEMENT_LEVELS), text).otherwise(F.lit("divided" if profile == "v1" else None))


def gaps(claims: DataFrame, sources: DataFrame, counterarguments: DataFrame) -> DataFrame:
    """(claim_id, kind): claims of one source, and agreed claims without a counterargument."""
    single = sources.groupBy("claim_id").agg(F.count("*").alias("n")).filter("n = 1").select("claim_id", F.lit("single_source").alias("kind"))
    agreed = claims.filter(F.col("agreement_level").isin("consensus", "majority")).join(counterarguments.select("claim_id").distinct(), "claim_id", "left_anti")
    return single.unionByName(agreed.select("claim_id", F.lit("no_counterargument").alias("kind")))


def draft_gaps(agreements: Column, disagreements: Column, uncertainties: Column) -> Column:
    """What a whole draft lacks, by its counts: disagreement, where agreements are over twice as many; uncertainties, where there are none."""
    found = F.array(F.when(agreements > 2 * disagreements, F.lit("Check for additional areas of disagreement")), F.when(uncertainties == 0, F.lit("Identify uncertainties in the expert responses")))
    return F.filter(found, lambda g: g.isNotNull())


def resolved_sources(sources: DataFrame, retrieved: DataFrame) -> DataFrame:
    """sources, and all retrieved ids (claim_id, ord, source_id) for claims that have exactly one, without repeats."""
    single = sources.groupBy("claim_id").agg(F.count("*").alias("n")).filter("n = 1").select("claim_id")
    added = retrieved.join(single, "claim_id").select("claim_id", (F.col("ord") + 1_000_000).alias("source_ord"), "source_id")
    return first_seen(sources.select("claim_id", "source_ord", "source_id").unionByName(added), ["claim_id", "source_id"], "source_ord")


def revision_kept(before: Column, after: Column, parsed: Column) -> Column:
    """Whether the original stays: its revision is not parsed, or has lost all sources."""
    return ~F.coalesce(parsed, F.lit(False)) | ((before > 0) & (F.coalesce(after, F.lit(0)) == 0))


def quote_status(quote: Column, text: Column) -> Column:
    """unverified without text or quote; verified word for word; paraphrased but for case; else absent."""
    empty = F.coalesce(quote, F.lit("")) == ""
    none = F.coalesce(text, F.lit("")) == ""
    return F.when(empty | none, "unverified").when(F.contains(text, strip(quote)), "verified").when(F.contains(F.lower(text), F.lower(quote)), "paraphrased").otherwise("absent")


def quotes_verified(quotes: DataFrame, texts: DataFrame, missing: str = "unverified") -> DataFrame:
    """quotes (source_id, quote) with their status in their source's text (source_id, text); `missing` where there is no such source."""
    joined = quotes.join(texts.select("source_id", "text", F.lit(True).alias("_known")), "source_id", "left")
    return joined.withColumn("status", F.when(F.col("_known").isNull(), missing).otherwise(quote_status(F.col("quote"), F.col("text")))).drop("_known")


def snapped(quotes: DataFrame, *keys: str) -> DataFrame:
    """For quotes (quote_id, quote, text) the source's sentence that shares most words with each, if enough; the shorter, then the earlier of equal ones.

    keys tell quotes apart: quote_id alone, or more columns where an id stands for a quote in several sources.
    """
    keys = keys or ("quote_id",)
    # the quote's words once, and only the sentence that wins, travel
    source = quotes.withColumn("_tokens", content_tokens(F.col("quote"))).filter(F.size("_tokens") >= MIN_OVERLAP)
    each = source.select(*keys, "_tokens", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    scored = each.withColumn("overlap", F.size(F.array_intersect("_tokens", content_tokens(F.col("sentence"))))).withColumn("score", F.col("overlap") / F.size("_tokens"))
    good = scored.filter((F.col("overlap") >= MIN_OVERLAP) & (F.col("score") >= SNAP_SCORE))
    best = F.min_by(F.struct("sentence", "score"), F.struct(-F.col("score"), F.octet_length("sentence"), "pos"))
    return good.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.sentence").alias("sentence"), F.col("b.score").alias("score"))


def quotes_resolved(quotes: DataFrame, texts: DataFrame, counters: Observation | None = None) -> DataFrame:
    """quotes verified, and those that are not replaced by the sentence they snap to, as verified; a quote_id may name a quote in several sources.

    counters, if given, observes `n` quotes and how many are `verified`, `snapped` and `absent`.
    """
    judged = quotes_verified(quotes, texts, "absent")
    failed = judged.filter(~F.col("status").isin("verified", "unverified")).filter("text is not null").select("quote_id", "source_id", "quote", "text")
    out = judged.drop("text").join(snapped(failed, "quote_id", "source_id"), ["quote_id", "source_id"], "left")
    hit = F.col("sentence").isNotNull()
    out = out.withColumns({"quote": F.coalesce("sentence", "quote"), "status": F.when(hit, "verified").otherwise(F.col("status")), "snapped": hit}).drop("sentence", "score")
    if counters is not None:
        out = out.observe(counters, F.count(F.lit(1)).alias("n"), F.count_if("snapped").alias("snapped"), *(F.count_if(F.col("status") == s).alias(s) for s in ("verified", "absent")))
    return out


def node_quotes(refs: DataFrame, nodes: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes that claims without a verified quote get from the verified nodes they refer to (claim_id, ref_ord, node_id)."""
    first = first_seen(nodes, ["node_id"], "node_ord").filter((F.col("status") == "verified") & ~blank(F.col("quote"))).select("node_id", "expert_id", "quote")
    wanting = refs.join(quotes.filter("status = 'verified'").select("claim_id").distinct(), "claim_id", "left_anti")
    given = wanting.join(first, "node_id").select("claim_id", "ref_ord", "node_id", F.col("expert_id").alias("source_id"), "quote")
    new = given.join(quotes.filter("node_id is not null").select("claim_id", "node_id"), ["claim_id", "node_id"], "left_anti").join(quotes.select("claim_id", "source_id", "quote"), ["claim_id", "source_id", "quote"], "left_anti")
    return first_seen(first_seen(new, ["claim_id", "node_id"], "ref_ord"), ["claim_id", "source_id", "quote"], "ref_ord")


def inherited_quotes(claims: DataFrame, sources: DataFrame, nodes: DataFrame, quotes: DataFrame, refs: DataFrame) -> DataFrame:
    """For claims without node references, and each source of theirs without a verified quote: the quote of the verified node that the claim contains most of."""
    wanting = sources.join(refs.select("claim_id").distinct(), "claim_id", "left_anti").join(quotes.filter("status = 'verified'").select("claim_id", "source_id").distinct(), ["claim_id", "source_id"], "left_anti")
    usable = nodes.filter((F.col("status") == "verified") & ~blank(F.col("quote"))).select(F.col("expert_id").alias("source_id"), "node_ord", "claim", "quote", content_tokens(F.col("claim")).alias("_node"))
    told = wanting.join(claims.select("claim_id", content_tokens(F.col("text")).alias("_claim")), "claim_id")
    # a claim with enough of a node's words has one of its rarest, all but so many that the rest is too few;
    # by these few words they meet, so a source may have any number of both
    usable = usable.filter(F.size("_node") >= MIN_OVERLAP).withColumn("_name", F.struct("source_id", "node_ord", F.xxhash64("claim", "quote")))
    words = told.select("source_id", "claim_id", F.explode("_claim").alias("_word")).distinct()
    frequency = words.groupBy("source_id", "_word").agg(F.count("*").alias("_n"))
    ordered = usable.select("_name", "source_id", F.size("_node").alias("_size"), F.explode("_node").alias("_word")).join(frequency, ["source_id", "_word"], "left")
    ordered = ordered.groupBy("_name", "source_id", "_size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_word"))).alias("_words"))
    needed = F.greatest(F.lit(MIN_OVERLAP), F.ceil(F.col("_size") * F.lit(INHERIT_SCORE) - 1e-9)).cast("int")
    rare = ordered.select("_name", "source_id", F.explode(F.slice("_words", F.lit(1), F.greatest(F.lit(0), F.col("_size") - needed + 1))).alias("w")).select("_name", "source_id", "w._word")
    pairs = words.join(rare, ["source_id", "_word"]).select("claim_id", "_name").distinct()
    met = told.join(pairs, "claim_id").join(usable.drop("source_id").distinct(), "_name").filter(F.col("source_id") == F.col("_name.source_id"))
    met = met.withColumn("overlap", F.size(F.array_intersect("_node", "_claim"))).withColumn("score", F.col("overlap") / F.size("_node"))
    good = met.filter((F.col("overlap") >= MIN_OVERLAP) & (F.col("score") >= INHERIT_SCORE))
    best = good.groupBy("claim_id", "source_id").agg(F.min_by("quote", F.struct(-F.col("score"), F.octet_length("claim"), "node_ord")).alias("quote"))
    return best.join(quotes.select("claim_id", "source_id", "quote"), ["claim_id", "source_id", "quote"], "left_anti")
