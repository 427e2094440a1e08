"""Operator 10: incremental removal of repeated word windows over a log-structured index.

The index is a folder of immutable runs. A run has the window hashes of one batch of
documents, sorted, a row for each bucket of hashes: of each anchored window the hash of the
anchor's gram and that of its context (see `repeats`), with the earliest place of it. A new
batch is made a run of its own; this is merged with the runs of the history bucket by bucket,
which tells what of the batch is settled and what must be verified; the windows in question
are then compared by two hashes of their words, taken from the stored texts of the batch and
of the historical documents concerned. When there are more than MAX_RUNS runs they are
compacted to one, which keeps the earliest place of equal hashes only.

Documents of earlier batches are earlier, whatever their ids; within a batch the smaller
doc_id is. `judged` and `cleaned` put a whole table through an index in BATCHES batches of
ascending doc_id, so the result is that of the table at once.

Defined results: a null text has no words (`cleaned` leaves it null); texts of fewer words
than a window lose nothing; equal doc_ids in one batch follow each other in the order of their
texts; an empty table gives an empty result; other columns, whatever their names, are ignored
by the contract's query and kept by `cleaned`.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .columns import box, boxed, named
from .spaces import release, shared_dir
from .squeeze import squeezed

LENGTH, GRAM, BATCHES, MAX_RUNS = 20, 8, 4, 2
SEPARATORS = b" \t\n\v\f\r"


def rule_for(length: int = LENGTH) -> repeats.Rule:
    return repeats.Rule(length, min(GRAM, max(1, length // 2)), True, SEPARATORS)


def sorted_run(rule: repeats.Rule):
    """One bucket of a run: its records sorted by hash, the earliest of equal ones; a second row has those settled within the batch."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        settled, _, ids, places, head, tail = repeats.unpacked(table)
        keep = np.flatnonzero(~settled)
        order = keep[np.lexsort((places[keep], ids[keep], tail[keep], head[keep]))]
        new = repeats.changes(head[order], tail[order])
        known = np.concatenate((np.flatnonzero(settled), order[~new]))
        rows = [repeats.blob(bucket, flag, False, *(c[at] for c in (ids, places, head, tail))) for flag, at in ((False, order[new]), (True, known)) if len(at)]
        return pa.Table.from_batches([repeats.blob_batch(rows)])

    return run


MANIFEST = "version int, kind string, path string, batch string, low long, high long, length int, gram int, buckets long"


@dataclass(frozen=True)
class Entry:
    """What the manifest has of one file set: kind is run, text, codes or windows; low and high bound the batch's keys."""

    kind: str
    path: str
    batch: str | None = None
    low: int | None = None
    high: int | None = None


class FingerprintIndex:
    """Runs of window hashes, the texts to verify them, and each batch's result, in a folder that all executors share.

    The folder's manifest is a table with the entries of every version of the index; a version's
    rows are written, in one file, after all else that it needs. So an index that is opened
    again, by this job or a later one, has what was appended completely, and files of an append
    that was cut short are never read. A batch has a name, and its result is stored before the
    commit: a job that dies after it appends the batch under the same name again and gets that
    result, and nothing is indexed twice. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, rule: repeats.Rule, buckets: int, folder: str | None = None):
        self.spark, self.rule, self.buckets = spark, rule, buckets
        self.folder = folder or f"{shared_dir(spark)}/window-index-{uuid.uuid4().hex}"
        self.version, self.entries = 0, []
        if folder is not None:
            self.recover()

    def recover(self) -> None:
        """Take over the last version in the folder, if there is one."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest").collect()  # a row for each entry of each version
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        self.version = max((r["version"] for r in rows), default=0)
        last = [r for r in rows if r["version"] == self.version]
        if any((r["length"], r["gram"]) != (self.rule.length, self.rule.gram) for r in last):
            raise ValueError(f"the index in {self.folder} is for other windows")
        self.entries = [Entry(r["kind"], r["path"], r["batch"], r["low"], r["high"]) for r in last]
        self.buckets = last[0]["buckets"] if last else self.buckets

    def commit(self, entries: list[Entry]) -> None:
        """Make these what the index has."""
        rows = [(self.version + 1, e.kind, e.path, e.batch, e.low, e.high, self.rule.length, self.rule.gram, self.buckets) for e in entries]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        self.version, self.entries = self.version + 1, entries

    def paths(self, kind: str, batch: str | None = None) -> list[str]:
        return [e.path for e in self.entries if e.kind == kind and batch in (None, e.batch)]

    @property
    def runs(self) -> list[str]:
        return self.paths("run")

    def result(self, batch: str) -> DataFrame:
        """The stored result of a batch: its rows with compressed text, `_codes` and `_windows` (see `repeats.finished`)."""
        text, codes, windows = (self.spark.read.parquet(*self.paths(kind, batch)) for kind in ("text", "codes", "windows"))
        return text.join(codes.filter("not _old").drop("_old"), "_key", "left").join(windows, "_key", "left")

    def key_range(self, batch: DataFrame) -> tuple[int | None, int | None]:
        """The least and the greatest `_key`; an error if a key is there twice, in the batch or in the history."""
        low, high, most = batch.groupBy("_key").agg(F.count("*").alias("n")).agg(F.min("_key"), F.max("_key"), F.max("n")).first()
        if (most or 0) > 1:
            raise ValueError("a batch has a key twice")
        meet = [e.path for e in self.entries if e.kind == "text" and None not in (low, e.low) and e.low <= high and low <= e.high]
        if meet and self.spark.read.parquet(*meet).select("_key").join(batch.select("_key"), "_key", "left_semi").limit(1).count():
            raise ValueError("a batch has a key that the index has already")
        return low, high

    def append(self, batch: DataFrame, text_column: str = "text", name: str | None = None) -> DataFrame:
        """Add a batch that has a long `_key`, unique over all batches; gives its `result`, of an earlier append if the name is known."""
        spark, rule = self.spark, self.rule
        if name is not None and self.paths("text", name):
            return self.result(name)
        name = name or uuid.uuid4().hex
        low, high = self.key_range(batch)
        run, text, codes_at, windows_at = (f"{self.folder}/{kind}-{self.version + 1:05d}-{uuid.uuid4().hex[:8]}" for kind in ("run", "text", "codes", "windows"))
        source = batch.select(F.col("_key").alias("doc_id"), F.col(text_column).alias("text"))
        repeats.anchor_blobs(source, rule, self.buckets, "gram").groupBy("bucket").applyInArrow(sorted_run(rule), repeats.BLOB).write.parquet(run)
        squeezed(batch, text_column).write.parquet(text)
        release(spark)
        merged = spark.read.parquet(run)
        if self.runs:
            merged = merged.unionByName(spark.read.parquet(*self.runs).filter("not settled").withColumn("old", F.lit(True)))
        codes = repeats.by_bucket(merged, repeats.reduce_anchors(rule))
        codes.groupBy(F.col("doc_id").alias("_key"), (F.col("code").bitwiseAND(2) > 0).alias("_old")).agg(F.collect_list("code").alias("_codes")).write.parquet(codes_at)
        release(spark)
        codes, texts = spark.read.parquet(codes_at), spark.read.parquet(text)
        pairs = repeats.pair_blobs(repeats.open_ones(texts, codes.filter("not _old").drop("_old"), text_column), rule, self.buckets)
        if self.paths("text"):
            history = repeats.open_ones(spark.read.parquet(*self.paths("text")), codes.filter("_old").drop("_old"), text_column)
            pairs = pairs.unionByName(repeats.pair_blobs(history, rule, self.buckets, old=True))
        repeats.lists(repeats.by_bucket(pairs, repeats.reduce_pairs(rule)), "_windows").write.parquet(windows_at)
        del pairs
        release(spark)
        self.commit([*self.entries, *(Entry(kind, path, name, low, high) for kind, path in (("run", run), ("text", text), ("codes", codes_at), ("windows", windows_at)))])
        if len(self.runs) > MAX_RUNS:
            self.compact()
        return self.result(name)

    def compact(self) -> None:
        """Merge all runs to one."""
        path = f"{self.folder}/run-{self.version + 1:05d}-{uuid.uuid4().hex[:8]}"
        self.spark.read.parquet(*self.runs).filter("not settled").groupBy("bucket").applyInArrow(sorted_run(self.rule), repeats.BLOB).filter("not settled").write.parquet(path)
        self.commit([Entry("run", path), *(e for e in self.entries if e.kind != "run")])


def batches_of(docs: DataFrame, n: int) -> list[DataFrame]:
    """docs in n batches of ascending `_key`, of about as many rows each."""
    shares = [(i + 1) / n for i in range(n - 1)]
    bounds = docs.agg(F.percentile_approx("_key", F.array(*map(F.lit, shares)), 10_000)).first()[0] if n > 1 else []
    bounds = sorted(set(bounds or []))
    edges = [None, *bounds, None]
    key = F.col("_key")
    return [docs.filter((F.lit(True) if a is None else key > a) & (F.lit(True) if b is None else key <= b)) for a, b in zip(edges, edges[1:], strict=False)]


def indexed(docs: DataFrame, length: int, id_column: str, text_column: str, batches: int) -> tuple[DataFrame, repeats.Rule]:
    """Boxed docs through an index of their own, batch after batch."""
    rule = rule_for(length)
    index = FingerprintIndex(docs.sparkSession, rule, repeats.bucket_count(docs, text_column))
    out = None
    for number, batch in enumerate(batches_of(repeats.keyed(docs, id_column, text_column), batches)):
        rows = index.append(batch, text_column, f"batch-{number}")
        out = rows if out is None else out.unionByName(rows)
    return out, rule


def digests(batch, texts, data, offsets, at, starts, ends, covered):
    kept = np.concatenate(([0], np.cumsum(~covered)))
    raw = data.tobytes()
    hashes = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        stay = np.flatnonzero(~covered[a:b]) + a
        hashes.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])).hexdigest())
    n = np.diff(at)
    return [pa.array(n.astype(np.int64)), pa.array((n - np.diff(kept[at])).astype(np.int64)), pa.array(hashes, pa.string())]


def kept_texts(batch, texts, data, offsets, at, starts, ends, covered):
    """Texts without the removed words and the white space after them; untouched ones as they are."""
    out = texts.to_pylist()
    removed = np.diff(np.concatenate(([0], np.cumsum(covered)))[at])
    for k in np.flatnonzero(removed):
        a, b = at[k], at[k + 1]
        until = np.append(starts[a + 1 : b], offsets[k + 1])
        drop = np.zeros(offsets[k + 1] - offsets[k] + 1, np.int32)
        gone = covered[a:b]
        np.add.at(drop, starts[a:b][gone] - offsets[k], 1)
        np.add.at(drop, until[gone] - offsets[k], -1)
        out[k] = data[offsets[k] : offsets[k + 1]][np.cumsum(drop[:-1]) == 0].tobytes().decode().rstrip()
    return [pa.array(out, pa.string()), pa.array(removed.astype(np.int64))]


def judged(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    rows, rule = indexed(named(docs, doc_id=id_column, text=text_column), length, "doc_id", "text", batches)
    return repeats.finished(rows, rule, "text", ["doc_id"], "n_words long, n_removed long, kept_sha256 string", digests)


def cleaned(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", batches: int = BATCHES) -> DataFrame:
    """docs, all their columns, with what stays of each text."""
    text, columns = box(docs, text_column), boxed(docs).columns
    rows, rule = indexed(boxed(docs), length, box(docs, id_column), text, batches)
    return repeats.finished(rows, rule, text, [c for c in columns if c != text], f"{text} string, removed long", kept_texts).select(*columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over all documents."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS win FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS p)),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS r FROM wins),
gone AS (SELECT DISTINCT doc_id, q FROM ranked, LATERAL (SELECT unnest(range(p, p + 20)) AS q) WHERE r > 1),
words AS (SELECT doc_id, q, w[q] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS q)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS t FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
