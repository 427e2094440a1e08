"""Operator 4: URL verdicts by rules and, where none fits, by gradient-boosted trees.

The trees see lexical features only: length, depth, digit ratio, character entropy, parameter
counts, and suffix statistics: how the labelled URLs with the same last label of the host, the
same last two labels, and these with the same first part of the path were judged. Labelled URLs
are those that a rule decides. All is DataFrame expressions and Spark's own GBT, which trains
on the executors.

The trees are trained on at most MAX_TRAINING distinct labelled URLs, those of least hash; the
suffix statistics count all labelled URLs. The statistics of a labelled URL leave out its own
fold, one of FOLDS by a hash of the URL, so that no label is among its own features; with
`held_out` the last fold is not learned from at all.

Defined results: a null URL, or one without `://`, has empty host and path, no rule, and the
method's verdict; repeated rows are judged alike; with no labelled URL, or labels of one kind
only, the method's verdict is that kind (`allow` if there is none); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import named
from .spaces import checkpoint

#: (host, path, verdict): fixed values of the contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
MAX_TRAINING = 20_000
TREES, DEPTH, BINS, SEED, FOLDS = 12, 4, 32, 5, 5
FEATURES = ["n_chars", "host_chars", "path_chars", "depth", "host_labels", "digit_ratio", "path_digits", "upper_ratio", "entropy", "n_params", "query_chars", "has_fragment", "has_extension", "is_https", "hyphens", "suffix_share", "suffix_count", "domain_share", "domain_count", "section_share", "section_count"]
ASCII_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://`, A-Z lower-cased) and path, both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, *ASCII_LOWER), F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def judged(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A struct of the longest fitting rule and its verdict, or null."""
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for h, p, _ in longest]
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for fit, (h, p, v) in reversed([*zip(fits, longest, strict=True)]):
        out = F.when(fit, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the text's characters; 0 for the empty text."""
    n = F.length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def count_of(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"(?s)[^{pattern}]", "")).cast("double")


def lexical(df: DataFrame) -> DataFrame:
    """df (url, host, path) with the features that the URL alone gives, and its suffixes."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1))
    labels = F.split(F.col("host"), r"\.")
    domain = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    made = {
        "n_chars": F.length(url), "host_chars": F.length("host"), "path_chars": F.length("path"),
        "depth": count_of(F.col("path"), "/"), "host_labels": F.size(labels),
        "digit_ratio": count_of(url, "0-9") / n, "path_digits": count_of(F.col("path"), "0-9"), "upper_ratio": count_of(url, "A-Z") / n,
        "entropy": entropy(url), "n_params": F.when(query == "", 0).otherwise(count_of(query, "&") + 1), "query_chars": F.length(query),
        "has_fragment": F.contains(url, F.lit("#")), "has_extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$"), "is_https": F.lower(url).startswith("https:"), "hyphens": count_of(url, "_-"),
    }
    return df.withColumns({k: v.cast("double") for k, v in made.items()} | {"_suffix": F.element_at(labels, -1), "_domain": domain, "_section": F.concat(domain, F.regexp_extract("path", r"^/[^/]*", 0))})


def with_suffix_statistics(df: DataFrame) -> DataFrame:
    """df (label, or null; fold) with the smoothed share of allowed among labelled URLs of the same suffix but not of the same fold, and log counts.

    The counts are pre-aggregated on the map side. The tables have a row for each suffix,
    registered name and section; Spark joins them by a shuffle unless they are small, and splits
    the partitions of frequent names.
    """
    labelled = df.filter("label is not null")
    folds = [F.col("fold") == i for i in range(FOLDS)]
    for key, name in (("_suffix", "suffix"), ("_domain", "domain"), ("_section", "section")):
        yes, n = ([F.sum(F.when(f, x).otherwise(0.0)) for f in folds] for x in (F.col("label"), F.lit(1.0)))
        stats = labelled.groupBy(key).agg(F.array(*yes).alias("_yes"), F.array(*n).alias("_n"))

        def others(c: str) -> Column:
            whole = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
            own = F.when(F.col("label").isNotNull(), F.get(c, F.col("fold"))).otherwise(0.0)
            return F.coalesce(whole - own, F.lit(0.0))

        df = df.join(stats, key, "left").withColumns({f"{name}_share": (others("_yes") + 1) / (others("_n") + 2), f"{name}_count": F.log1p(others("_n"))}).drop("_yes", "_n")
    return df


def classify(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, max_training: int = MAX_TRAINING, id_column: str = "page_id", url_column: str = "url", held_out: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's probability of allow for every URL; with held_out also fold, of which the last one was not learned from."""
    host, path = host_and_path(F.col("url"))
    base = named(pages, page_id=id_column, url=url_column).withColumn("host", host).withColumn("path", path)
    fold = F.pmod(F.xxhash64(F.lit(SEED + 1), "url"), F.lit(FOLDS)).cast("int")
    base = base.withColumn("_rule", judged(F.col("host"), F.col("path"), rules)).withColumn("fold", fold)
    learned = F.col("_rule").isNotNull() & ((F.col("fold") < FOLDS - 1) if held_out else F.lit(True))
    featured = lexical(base).withColumn("label", F.when(learned, (F.col("_rule.verdict") == "allow").cast("double")))
    labelled = featured.filter("label is not null")
    kinds = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.approx_count_distinct("url").alias("n")).collect()}
    if len(kinds) < 2:
        only = "block" if 0.0 in kinds else "allow"
        scored = base.withColumn("score", F.lit(1.0 if only == "allow" else 0.0))
    else:
        full = with_suffix_statistics(featured)
        # the number of distinct URLs is an estimate; should the sample exceed the bound, those of least hash stay
        share = min(1.0, 0.9 * max_training / sum(kinds.values()))
        place = F.pmod(F.xxhash64(F.lit(SEED), "url"), F.lit(1 << 30))
        train = full.filter((F.col("label").isNotNull()) & (place < int(share * (1 << 30)))).dropDuplicates(["url"])
        train = checkpoint(train.select(*FEATURES, "label", place.alias("_place"), "url"))
        if train.count() > max_training:
            train = train.orderBy("_place", "url").limit(max_training)
        gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, seed=SEED)
        model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), gbt]).fit(train)
        scored = model.transform(full).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return scored.select("page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score", *(["fold"] if held_out else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 over all pages."""
    return classify(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")
