"""Operator 11: text quality by a sparse ensemble of rules.

Each text is described by STATISTICS: shares of kinds of characters, repeats of words and lines,
lengths. Shallow random trees are grown on them by Spark; the paths from their roots to each of
their nodes are conjunctive rules, such as `symbols > 0.02 and distinct_words <= 0.6`. A logistic
regression with a lasso penalty weighs the rules, and most get no weight. Those that do are
compiled to one Spark column expression, the score. Statistics are made of whole texts, in Arrow
batches; fitting and scoring are Spark's.

The fit takes at most MAX_TRAINING labelled rows, half of each label, those of least id hash, with
weights that restore the labels' shares. Only sampled documents are described for it, and only
their statistics and labels are joined. The penalty is that of PENALTIES with the least loss on a
quarter of the rows that the regression did not see.

Defined results: null texts are empty, and an empty text's statistics are 0; labels other than 0
and 1 are not learned from, nor such without a document; a document with several labels counts with
each, and a repeated one each time; without a label to learn from every score is 0.5, and with one
kind only it is that label; a null doc_id has no label and is not held out; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import BYTE_VALUES, prefix_hash, span_hash, text_blocks, tidied, word_spans
from .columns import named
from .spaces import checkpoint

MAX_TRAINING = 20_000
TREES, DEPTH, BINS, SEED = 24, 3, 64, 7
#: Lasso penalties to choose from; rounds of the regression; the share of label 1 from which on a text is good.
PENALTIES, STEPS, LEVEL = (0.002, 0.0005), 60, 0.3
SIZE = 1 << 30

KINDS = {
    "letters": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC2, 0xF5)],
    "upper": range(0x41, 0x5B),
    "digits": range(0x30, 0x3A),
    "spaces": b" \t\n\v\f\r",
    "marks": b".,;:!?'\"()-",
    "symbols": b"#$%&*+/<=>@[\\]^_`{|}~",
}
STATISTICS = [*KINDS, "other_scripts", "log_chars", "log_words", "log_lines", "word_length", "longest_word", "distinct_words", "top_word", "repeated_next", "distinct_lines", "line_length", "capital_words", "upper_words", "marked_words", "symbol_words", "double_ends"]
_KIND = np.zeros((256, len(KINDS)), np.float64)
for _i, _k in enumerate(KINDS.values()):
    _KIND[[*_k], _i] = 1
IS_WORD = np.ones(256, np.bool_)
IS_WORD[[*KINDS["spaces"]]] = False
IS_LINE = np.ones(256, np.bool_)
IS_LINE[0x0A] = False
#: Bytes of which a histogram is made at a time.
STEP = 1 << 20


def byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each document has each byte."""
    docs = len(offsets) - 1
    out = np.zeros(docs * 256, np.int64)
    for a in range(0, len(data), STEP):
        b = min(a + STEP, len(data))
        first = int(np.searchsorted(offsets, a, side="right")) - 1
        last = int(np.searchsorted(offsets, b, side="left"))
        sizes = np.diff(np.clip(offsets[first : last + 1], a, b))
        n = np.bincount(np.repeat(np.arange(last - first, dtype=np.int64) << 8, sizes) | data[a:b], minlength=(last - first) * 256)
        out[first * 256 : last * 256] += n
    return out.reshape(docs, 256)


def per_document(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between the documents' edges."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[at])


def repeats_of(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, occurrences of the most frequent one) of each document."""
    docs = len(at) - 1
    row = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(at))
    keys, n = np.unique((row << np.uint64(40)) | (hashes >> np.uint64(24)), return_counts=True)
    whose = (keys >> np.uint64(40)).astype(np.int64)
    distinct, top = np.bincount(whose, minlength=docs), np.zeros(docs, np.int64)
    if len(keys):
        heads = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
        top[whose[heads]] = np.maximum.reduceat(n, heads)
    return distinct, top


def described(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each document of a block."""
    counts = byte_counts(data, offsets)
    chars = np.maximum(1, counts[:, :0x80].sum(axis=1) + counts[:, 0xC0:].sum(axis=1))
    prefix = prefix_hash(BYTE_VALUES[data])
    starts, ends, at = word_spans(data, offsets, IS_WORD)
    n = np.diff(at)
    words = np.maximum(1, n)
    word_hash = span_hash(prefix, starts, ends)
    distinct, top = repeats_of(word_hash, at)
    line_starts, line_ends, line_at = word_spans(data, offsets, IS_LINE)
    lines = np.diff(line_at)
    distinct_lines, _ = repeats_of(span_hash(prefix, line_starts, line_ends), line_at)
    first, last = data[starts], data[ends - 1]
    upper, mark, symbol = (_KIND[:, [*KINDS].index(k)] > 0 for k in ("upper", "marks", "symbols"))
    longest = np.zeros(len(n), np.int64)
    if len(starts):
        longest[n > 0] = np.maximum.reduceat(ends - starts, at[:-1][n > 0])
    same = np.zeros(len(starts), np.bool_)
    same[1:] = word_hash[1:] == word_hash[:-1]
    same[at[:-1][n > 0]] = False
    second = data[np.maximum(ends - 2, 0)]
    return np.column_stack([
        counts @ _KIND / chars[:, None],
        counts[:, 0xC0:].sum(axis=1) / chars, np.log1p(chars), np.log1p(n), np.log1p(lines),
        per_document(ends - starts, at) / words, longest, distinct / words, top / words, per_document(same, at) / words,
        distinct_lines / np.maximum(1, lines), np.log1p(chars / np.maximum(1, lines)),
        per_document(upper[first], at) / words, per_document(upper[first] & upper[last] & (ends - starts > 1), at) / words,
        per_document(mark[last], at) / words, per_document(symbol[first] | symbol[last], at) / words, per_document((last == second) & (ends - starts > 1) & (mark[last] | symbol[last]), at) / words,
    ])


def statistics(docs: DataFrame) -> DataFrame:
    """docs, whose last column is the text, with STATISTICS in its place."""
    kept = docs.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch.column(batch.num_columns - 1)):
                found = described(data, offsets)
                found[np.diff(offsets) == 0] = 0
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in batch.columns[:-1]), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], [*batch.schema.names[:-1], *STATISTICS])

    return docs.mapInArrow(tidied(run), T.StructType([*kept, *(T.StructField(s, T.DoubleType()) for s in STATISTICS)]))


#: Bounds of a rule: (statistic, low, high) means low < statistic <= high.
Rule = tuple[tuple[str, float, float], ...]


def column_of(rule: Rule) -> Column:
    """Whether a rule holds, 1.0 or 0.0."""
    holds = F.lit(True)
    for name, low, high in rule:
        if low > -np.inf:
            holds &= F.col(name) > low
        if high < np.inf:
            holds &= F.col(name) <= high
    return holds.cast("double")


@dataclass
class Ensemble:
    """Weighted rules and an intercept; a text's score is the logistic function of the sum of what holds."""

    weights: dict[Rule, float]
    intercept: float

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.weights.items():
            total += F.lit(float(weight)) * column_of(rule)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def explained(self) -> list[str]:
        """The rules in words, those of most weight first."""
        text = lambda r: " and ".join(f"{n} > {a:.4g}" * (a > -np.inf) + " and " * (a > -np.inf and b < np.inf) + f"{n} <= {b:.4g}" * (b < np.inf) for n, a, b in r)
        return [f"{w:+.3f} if {text(r)}" for r, w in sorted(self.weights.items(), key=lambda x: -abs(x[1]))]


def paths(forest) -> list[Rule]:
    """The rules of all nodes but the roots of a fitted forest, each once, in order."""
    found: dict[Rule, None] = {}

    def walk(node, bounds: dict[str, tuple[float, float]]) -> None:
        if bounds:
            found[tuple((n, *b) for n, b in sorted(bounds.items()))] = None
        if node.subtreeDepth() == 0:
            return
        name, threshold = STATISTICS[node.split().featureIndex()], node.split().threshold()
        low, high = bounds.get(name, (-np.inf, np.inf))
        walk(node.leftChild(), bounds | {name: (low, min(high, threshold))})
        walk(node.rightChild(), bounds | {name: (max(low, threshold), high)})

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), {})
    return [*found]


def training_rows(docs: DataFrame, labels: DataFrame, max_training: int) -> DataFrame:
    """(label, weight, part, STATISTICS) of a bounded sample of docs (doc_id, text) and labels (doc_id, label)."""
    labels = labels.filter("label IN (0, 1) AND doc_id IS NOT NULL")
    place = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string")), F.lit(SIZE))
    sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    each = max_training // max(1, len(sizes))
    # hashes vary, and documents may be repeated: what exceeds the bound is cut by the hash
    rates = {k: min(SIZE, int(1.1 * each / n * SIZE) + 1) for k, n in sizes.items()}
    rate = F.lit(0)
    for k, r in rates.items():
        rate = F.when(F.col("label") == k, r).otherwise(rate)
    sampled = labels.withColumn("place", place).filter(F.col("place") < rate)
    most = max(rates.values(), default=0)
    facts = statistics(docs.filter("doc_id IS NOT NULL").filter(place < most).select("doc_id", "text"))
    joined = sampled.join(facts, "doc_id")
    kept = None
    for k in sizes:
        own = joined.filter(F.col("label") == k).orderBy("place", "doc_id", *STATISTICS).limit(each)
        kept = own if kept is None else kept.unionByName(own)
    if kept is None:
        return joined.select("label", F.lit(1.0).alias("weight"), F.lit(0).alias("part"), *STATISTICS)
    kept = checkpoint(kept.select(F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64(F.lit(SEED + 1), "place"), F.lit(4)).alias("part"), *STATISTICS))
    n = {r["label"]: r["n"] for r in kept.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = F.lit(1.0)
    for k, m in n.items():
        weight = F.when(F.col("label") == k, sizes[int(k)] / sum(sizes.values()) * sum(n.values()) / m).otherwise(weight)
    return kept.withColumn("weight", weight)


def fit(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> Ensemble:
    """The ensemble learned from docs (doc_id, text) and labels (doc_id, label)."""
    rows = training_rows(docs, labels, max_training)
    kinds = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        return Ensemble({}, 0.0 if not kinds else np.inf if kinds[0] == 1 else -np.inf)
    # few rows: one partition of trees' bins is enough, and results don't depend on how they were spread
    rows = checkpoint(rows.repartitionByRange(1, "label", *STATISTICS).sortWithinPartitions("label", *STATISTICS))
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=BINS, seed=SEED, weightCol="weight", minInstancesPerNode=5).fit(vectors)
    rules = paths(forest)
    if not rules:
        share = rows.agg(F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).first()[0]
        return Ensemble({}, float(np.log(share / (1 - share))))
    names = [f"rule_{i}" for i in range(len(rules))]
    held = rows.select("label", "weight", "part", *(column_of(r).alias(n) for r, n in zip(rules, names, strict=True)))
    held = checkpoint(VectorAssembler(inputCols=names, outputCol="features").transform(held).select("label", "weight", "part", "features"))

    def regression(penalty: float, which: DataFrame):
        return LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=STEPS, standardization=False, weightCol="weight").fit(which)

    def loss(penalty: float) -> float:
        seen = held.filter("part > 0")
        if len(seen.select("label").distinct().collect()) < 2:
            return penalty
        judged = regression(penalty, seen).transform(held.filter("part = 0"))
        p = vector_to_array("probability")[1]
        return judged.select(F.avg(-F.col("weight") * F.log(F.when(F.col("label") == 1, p).otherwise(1 - p) + 1e-9))).first()[0] or 0.0

    model = regression(min(PENALTIES, key=loss) if len(PENALTIES) > 1 else PENALTIES[0], held)
    weights = {r: w for r, w in zip(rules, model.coefficients.toArray().tolist(), strict=True) if w}
    return Ensemble(weights, float(model.intercept))


def held_out(id_column: str) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(5)) == 0, F.lit(False))


def scored(docs: DataFrame, model: Ensemble, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score and STATISTICS of every whole text."""
    rows = statistics(named(docs, doc_id=id_column, text=text_column))
    score = model.score() if np.isfinite(model.intercept) else F.lit(float(model.intercept > 0))
    return rows.select("doc_id", score.alias("score"), *STATISTICS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).filter(~held_out("doc_id"))
    found = scored(docs, fit(docs.select("doc_id", "text"), labels))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= LEVEL).cast("int").alias("predicted"))
