"""Operator 8: removal of repeated byte strings by distributed prefix doubling.

Every byte that is covered by a string of `length` bytes which also starts in a document with
a smaller doc_id is removed. Positions are ranked by growing strings that start (or lie) at
them: first the gram of GRAM bytes at the position's anchor, then, for positions of grams that
repeat, pairs of the ranks of length/2 bytes at offsets 0 and length/2. After each step
positions of a unique rank retire; past the threshold the least doc_id of each rank stays.
See `repeats` for how positions of one anchor travel as one.

Ranks are named by hashes of the ranked bytes (40 + 64 bits in the first step, with the
context; 96 + log2(buckets) bits in the second), not by running numbers, so that no step has to
number all positions; equal bytes have equal names and no name depends on the partitioning.

Defined results: a null text is empty; texts shorter than the length lose nothing; strings may
overlap and are judged on the input; equal doc_ids follow each other in the order of their
texts as if their ids rose; an empty table gives an empty result; other columns, whatever their
names, are ignored by the contract's query and kept by `cleaned`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import repeats
from .columns import box, boxed, named

LENGTH, GRAM = 50, 28


def rule_for(length: int = LENGTH) -> repeats.Rule:
    return repeats.Rule(length, max(1, min(GRAM, length * 9 // 16)), False, None)


def kept_bytes(data: np.ndarray, offsets: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes that stay, offsets of the documents in them)."""
    stays = ~covered
    return data[stays], np.concatenate(([0], np.cumsum(stays)))[offsets]


def digests(batch, texts, data, offsets, at, starts, ends, covered):
    kept, kept_at = kept_bytes(data, offsets, covered)
    raw = kept.tobytes()
    begins = covered & ~np.concatenate(([False], covered[:-1])) if len(covered) else covered
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = covered[inner]
    spans = np.concatenate(([0], np.cumsum(begins)))
    return [
        pa.array(np.diff(offsets)), pa.array(np.diff(offsets) - np.diff(kept_at)), pa.array(np.diff(spans[offsets]).astype(np.int64)),
        pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(kept_at[:-1].tolist(), kept_at[1:].tolist(), strict=True)], pa.string()),
    ]


def kept_texts(batch, texts, data, offsets, at, starts, ends, covered):
    """The bytes that stay, as text; characters that were cut inside are dropped. Null texts stay null."""
    kept, kept_at = kept_bytes(data, offsets, covered)
    raw = kept.tobytes()
    valid = texts.is_valid().to_pylist()
    out = [raw[a:b].decode("utf-8", "ignore") if v else None for a, b, v in zip(kept_at[:-1].tolist(), kept_at[1:].tolist(), valid, strict=True)]
    return [pa.array(out, pa.string()), pa.array(np.diff(offsets) - np.diff(kept_at))]


def judged(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    rule = rule_for(length)
    rows = repeats.marked(named(docs, doc_id=id_column, text=text_column), rule, "doc_id", "text")
    return repeats.finished(rows, rule, "text", ["doc_id"], "n_bytes long, n_removed long, n_spans long, kept_sha256 string", digests)


def cleaned(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs, all their columns, with what stays of each text."""
    rule = rule_for(length)
    text, columns = box(docs, text_column), boxed(docs).columns
    rows = repeats.marked(boxed(docs), rule, box(docs, id_column), text)
    return repeats.finished(rows, rule, text, [c for c in columns if c != text], f"{text} string, removed long", kept_texts).select(*columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over all documents."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
