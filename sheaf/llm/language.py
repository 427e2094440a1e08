"""Operator 5: language identification by averaged hashed subword embeddings.

A text's features are its byte n-grams of 2 to 4 bytes inside words (words padded by a
space, A-Z lower-cased), hashed into BUCKETS rows of an embedding table; their average goes
through a linear softmax. Embeddings and softmax are trained by stochastic gradient descent
in numpy on the driver, from hashed counts that the executors make. For prediction both are
multiplied out to one table of BUCKETS x languages, so that a text's logits are an average of
table rows.

Calibrated rejection: a temperature is fitted on training rows that the descent did not see,
and a document is rejected when its calibrated probability is under the level that all but
KEEP of those rows reach (never above MAX_FLOOR), or when it has no letter.

The fit takes at most MAX_TRAINING distinct labelled texts, as many of each language (FLOOR at
least, should there be many languages): those of least hash, of a sample by text hash whose rate
follows from the language's number of distinct texts. So copies count once, and rare
languages keep their rows. Each text is taken whole, and a second time with one stretch of it of
at most 12 words, so that short texts are learned too. What comes to the driver is at most 2 *
BUCKETS counts for each of them. Prediction reads every whole text.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected;
with no labelled row every text is `und`, and `confident` keeps all documents, for nothing can be
judged; repeated rows are predicted alike; an empty table gives an empty result; the contract's
query ignores other columns, `confident` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import BYTE_VALUES, mix, text_blocks, tidied
from .columns import box, boxed, free_name, named

GRAMS = (2, 3, 4)
BUCKETS = 1 << 13
WIDTH = 16
MAX_TRAINING, FLOOR = 3000, 50
EPOCHS, LEAST_STEPS, BATCH, RATE, TABLE_RATE, SEED = 6, 800, 32, 0.5, 10, 11
SHORT = 12
KEEP, MAX_FLOOR = 0.999, 0.5

#: Letters are ASCII letters and, for the bytes of a word, everything above ASCII.
PART = np.zeros(256, np.uint8)
PART[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
FOLD = np.where(PART == 1, np.arange(256), 0x20).astype(np.uint8)
FOLD[0x41:0x5B] += 32


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets of the documents) of a block's n-grams; none crosses documents, and none is of spaces only."""
    n, docs = len(data), len(offsets) - 1
    # a space before and after each document
    padded = np.full(n + docs + 1, 0x20, np.uint8)
    places = np.arange(n) + np.repeat(np.arange(1, docs + 1), np.diff(offsets))
    padded[places] = FOLD[data]
    bounds = offsets + np.arange(docs + 1)
    v = BYTE_VALUES[padded]
    space = padded == 0x20
    out, at = [], []
    code = v
    for g in range(2, max(GRAMS) + 1):
        m = len(padded) - g + 1
        if m <= 0:
            break
        code = mix(code[:m] * np.uint64(0xD6E8FEB86659FD93) + v[g - 1 :])
        # spaces only at the gram's ends, and something between them
        good = ~(space[:m] & space[g - 1 :]) if g == 2 else good_inside(space, g, m)
        kept = np.flatnonzero(good)
        out.append((code[kept] & np.uint64(BUCKETS - 1)).astype(np.int32))
        at.append(kept)
    if not out:
        return np.zeros(0, np.int32), np.zeros(docs + 1, np.int64)
    buckets, at = np.concatenate(out), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    return buckets[order], np.searchsorted(at[order], bounds)


def good_inside(space: np.ndarray, g: int, m: int) -> np.ndarray:
    good = ~space[1 : m + 1]
    for j in range(2, g - 1):
        good = good & ~space[j : m + j]
    return good


def has_letter(texts: pa.Array) -> np.ndarray:
    """Rows with a letter of any script."""
    found = pc.match_substring_regex(texts.cast(pa.large_string()), r"\p{L}")
    return pc.fill_null(found, False).to_numpy(zero_copy_only=False)


@dataclass
class Model:
    """languages, the table of averaged logits, the temperature and the rejection floor."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    floor: float

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, for each text."""
        n = len(texts)
        logits = np.zeros((n, max(1, len(self.languages))), np.float64)
        seen = np.zeros(n, np.bool_)
        if self.languages:
            for first, end, data, offsets in text_blocks(texts):
                buckets, at = grams(data, offsets)
                counts = np.diff(at)
                some = counts > 0
                seen[first:end] = some
                if not some.any():
                    continue
                for k in range(len(self.languages)):
                    sums = np.add.reduceat(np.take(self.table[:, k], buckets), at[:-1][some], dtype=np.float64)
                    logits[first:end][some, k] = sums / counts[some] + self.bias[k]
        p = softmax(logits / self.temperature)
        ok = has_letter(texts) & bool(self.languages)
        best = p.argmax(axis=1)
        score = np.where(ok, p[np.arange(n), best], 0.0)
        names = [self.languages[b] if o else "und" for b, o in zip(best, ok, strict=True)]
        return names, score, ~ok | (score < self.floor)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def stretch(text: str, key: int) -> str:
    """1 to SHORT words of a text, chosen by the key."""
    words = text.split()
    n = 1 + key % SHORT
    begin = (key >> 8) % max(1, len(words) - n + 1)
    return " ".join(words[begin : begin + n])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, calibrate, text) to (lang, calibrate, key, buckets, counts), of each text once in a task; a short stretch of it is a second row. Nothing depends on the partitioning."""
    done: set[tuple[str, int]] = set()
    for batch in batches:
        texts = batch.column(2)
        keys = [xxhash.xxh64_intdigest(t, SEED) >> 2 for t in texts.to_pylist()]
        fresh = []
        for i, (name, key) in enumerate(zip(batch.column(0).to_pylist(), keys, strict=True)):
            if (name, key) not in done:
                done.add((name, key))
                fresh.append(i)
        batch, keys = batch.take(pa.array(fresh, pa.int64())), [keys[i] for i in fresh]
        texts = batch.column(2)
        short = pa.array([stretch(t, k) for t, k in zip(texts.to_pylist(), keys, strict=True)], texts.type)
        for second, column in enumerate((texts, short)):
            rows = []
            for _, _, data, offsets in text_blocks(column):
                buckets, at = grams(data, offsets)
                rows += [np.unique(buckets[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([2 * k + second for k in keys], pa.int64()), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))],
                ["lang", "calibrate", "key", "buckets", "counts"],
            )


def training_rows(labelled: DataFrame, text: str, lang: str, max_training: int) -> DataFrame:
    """(lang, calibrate, key, buckets, counts) of the texts to learn from, two rows of each; a strict bound on both sides."""
    rows = named(labelled, lang=lang, text=text).select(F.col("lang").cast("string").alias("lang"), "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = F.xxhash64(F.lit(SEED), "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(hashed).alias("n")).collect()}
    each = max(FLOOR, max_training // max(1, len(sizes)))
    # half as many again as are wanted, for the counts are estimates and hashes vary
    rates = {k: min(1 << 30, int(1.5 * each / max(1, n) * (1 << 30)) + (100 << 30) // max(100, n)) for k, n in sizes.items()}
    rate = F.try_element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col("lang")) if rates else F.lit(0)
    taken = rows.filter(F.pmod(hashed, F.lit(1 << 30)) < rate).select("lang", (F.pmod(F.xxhash64(F.lit(SEED + 1), "text"), F.lit(5)) == 0).alias("calibrate"), "text")
    made = taken.mapInArrow(tidied(counted), "lang string, calibrate boolean, key long, buckets array<int>, counts array<float>")
    order = Window.partitionBy("lang").orderBy("key")
    return made.dropDuplicates(["lang", "key"]).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= 2 * each).drop("n")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", max_training: int = MAX_TRAINING) -> Model:
    """Train on (text, lang) rows; null texts and labels are left out."""
    got = training_rows(labelled, text, lang, max_training).toArrow()
    got = got.filter(pc.greater(pc.list_value_length(got["buckets"]), 0))
    languages = sorted(set(got["lang"].to_pylist()))
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    order = pc.sort_indices(got.select(["lang", "key"]), sort_keys=[("lang", "ascending"), ("key", "ascending")])
    got = got.take(order)
    y = np.array([languages.index(v) for v in got["lang"].to_pylist()])
    held = np.array(got["calibrate"].to_pylist())
    if held.all() or not held.any():
        held = np.arange(len(y)) % 5 == 0 if len(y) >= 10 else np.zeros(len(y), np.bool_)
    lists = got["buckets"].combine_chunks(), got["counts"].combine_chunks()
    at = np.asarray(lists[0].offsets)
    idx, val = np.asarray(lists[0].values), np.asarray(lists[1].values)

    def dense(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that these rows use, and their shares in each row."""
        cells = [idx[at[i] : at[i + 1]] for i in which]
        used = np.unique(np.concatenate(cells))
        x = np.zeros((len(which), len(used)), np.float32)
        for r, (i, c) in enumerate(zip(which, cells, strict=True)):
            v = val[at[i] : at[i + 1]]
            x[r, np.searchsorted(used, c)] = v / v.sum()
        return used, x

    random = np.random.default_rng(SEED)
    del got
    table = (random.standard_normal((BUCKETS, WIDTH)) * 0.5).astype(np.float32)
    weight = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    train = np.flatnonzero(~held)
    each = max(1, -(-len(train) // BATCH))
    epochs = max(EPOCHS, -(-LEAST_STEPS // each)) if len(train) else 0
    steps, done = epochs * each, 0
    for _ in range(epochs):
        random.shuffle(train)
        for b in range(0, len(train), BATCH):
            rows_ = train[b : b + BATCH]
            used, x = dense(rows_)
            rate = RATE * (1 - done / steps)
            hidden = x @ table[used]
            p = softmax((hidden @ weight + bias).astype(np.float64)).astype(np.float32)
            p[np.arange(len(rows_)), y[rows_]] -= 1
            g = p @ weight.T
            g /= np.maximum(1, np.linalg.norm(g, axis=1, keepdims=True))  # short texts move few rows far
            weight -= rate * (hidden.T @ p) / len(rows_)
            bias -= rate * p.mean(axis=0)
            table[used] -= rate * TABLE_RATE * (x.T @ g)
            done += 1
    flat = (table @ weight).astype(np.float32)
    model = Model(languages, flat, bias.astype(np.float64), 1.0, 0.0)
    if held.any():
        which = np.flatnonzero(held)
        logits = np.stack([val[at[i] : at[i + 1]] @ flat[idx[at[i] : at[i + 1]]] / val[at[i] : at[i + 1]].sum() for i in which]) + bias
        temperatures = np.geomspace(0.05, 1000, 80)
        loss = [-np.log(softmax(logits / t)[np.arange(len(which)), y[which]] + 1e-12).mean() for t in temperatures]
        model.temperature = float(temperatures[int(np.argmin(loss))])
        p = softmax(logits / model.temperature)
        model.floor = float(min(MAX_FLOOR, np.quantile(p.max(axis=1), 1 - KEEP)))
    del idx, val, at, lists, dense
    pa.default_memory_pool().release_unused()  # the driver is small
    return model


def held_out(id_column: str) -> Column:
    """Documents that are never learned from."""
    return F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(4)) == 2


def predictions(docs: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs, or the given columns of it, with lang_pred, score and rejected (and underscores after names that are taken) for every whole text."""
    keep = docs.columns if keep is None else keep
    inner = boxed(docs)
    source = inner.select(*[F.col(box(docs, c)).alias(f"c{i}") for i, c in enumerate(keep)], F.col(box(docs, text_column)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rejected = model.predict(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], [*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    added = T._parse_datatype_string("lang_pred string, score double, rejected boolean").fields
    kept = source.drop("text")
    return source.mapInArrow(tidied(run), T.StructType(kept.schema.fields + added)).toDF(*keep, *(free_name(kept.toDF(*keep), f.name) for f in added))


def confident(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """docs, all their columns, without the documents that the model rejects; all of them if it knows no language."""
    if not model.languages:
        return docs
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected = model.predict(batch.column(place))[2]
            yield batch.filter(pa.array(~rejected))

    return boxed(docs).mapInArrow(tidied(run), boxed(docs).schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out("doc_id")))
    return predictions(docs.withColumn("held_out", held_out("doc_id")), model, keep=["doc_id", "held_out"])
