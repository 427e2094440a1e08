"""Operator 7: canonical exact digests, grouped by a wide hash and compared byte by byte.

The canonical form of a text is its NFKC form, case-folded, with runs of white space as one
space and none at the ends. Its fingerprint is the 128-bit xxhash3 of the form's UTF-8 bytes.
`groups` gathers documents of equal fingerprints and compares their canonical bytes with those
of the group's first document; should different forms share a hash, they get groups of their
own. Likeness of two exact digests is 1 if they are equal and else 0.

Neighbours in ascending doc_id come from one range partitioning by doc_id: texts move once.
The last document of a partition meets the first of the next one in a small second step.

Defined results: a null text is empty; equal doc_ids, and null ones, which come first, follow
each other in the order of their texts and are documents of their own; group_id is the doc_id of
the group's first document; a single document is its own next one; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import tidied
from .columns import named
from .repeats import keyed, unique_ids
from .spaces import checkpoint
from .squeeze import squeezed

SPACE = re.compile(r"\s+")


def canonical(text: str) -> str:
    """NFKC, case-folded, white space folded."""
    if text.isascii():
        return " ".join(text.casefold().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return SPACE.sub(" ", folded).strip()


def fingerprint(text: str) -> str:
    """32 hexadecimal digits."""
    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) characters replaced by as many first ones of the following text, or all it has."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def shared_prints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id and head of the documents whose fingerprint another one has; head is the group's least doc_id."""
    kind = docs.schema[id_column].dataType

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(tidied(printed), f"doc_id {kind.simpleString()}, fingerprint string")
    rows = checkpoint(rows)
    # checkpointed, for Spark splits a large group only between plain shuffles
    heads = checkpoint(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).filter("n > 1"))
    return rows.join(heads, "fingerprint").select("doc_id", "head").distinct()


FIELDS = [("doc_id", None), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()), ("part", T.IntegerType()), ("role", T.StringType()), ("edge", T.StringType())]
ARROW = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32()}


def batch_of(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(list(c), id_type if t is None else ARROW[t]) for (_, t), c in zip(FIELDS, columns, strict=True)], [n for n, _ in FIELDS])


def ranged_pass(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One pass over the texts in ascending doc_id, after their only shuffle.

    Rows by role: `done` has a document's digests; `first` and `last` have a partition's
    first text and its last, still open one; `copy` and `head` have the canonical form (edge)
    of a document that shares its fingerprint. Which documents share one is known from a
    narrow first pass, whose rows travel with the texts through the same range partitioning.
    """
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField(n, kind if t is None else t) for n, t in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, mark = None, None
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            id_type = batch.schema.field(0).type
            for doc_id, head, marks, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if marks:
                    mark = doc_id, head
                    continue
                text = "" if text is None else decompress(text).decode()
                form = canonical(text)
                own = xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))
                if mark is not None and mark[0] == doc_id:
                    out.append((doc_id, None, None, own, None, None, None, part, "head" if mark[1] == doc_id else "copy", form))
                if last is None:
                    out.append((doc_id, len(text), None, own, None, None, None, part, "first", text))
                else:
                    out.append(done(*last, text, own))
                last = doc_id, text, own
            yield batch_of(out, id_type)
        if last is not None:
            yield batch_of([(last[0], len(last[1]), None, last[2], None, None, None, part, "last", last[1])], id_type)

    texts = squeezed(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), "text").select("doc_id", F.lit(None).cast(kind).alias("head"), F.lit(False).alias("marks"), "text")
    marks = shared_prints(docs, id_column, text_column).select("doc_id", "head", F.lit(True).alias("marks"), F.lit(None).cast("binary").alias("text"))
    ranged = texts.unionByName(marks).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.desc("marks"), "text")
    return checkpoint(ranged.mapInArrow(tidied(run), schema))


def done(doc_id, text: str, own: str, following: str, other: str) -> tuple:
    changed = edited(text, following)
    print_ = fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, print_, float(own == print_), float(own == other), 0, "done", None


def compared(kept: DataFrame) -> DataFrame:
    """doc_id, fingerprint, group_id and copies of the documents that share their fingerprint, after byte comparison.

    Each canonical form meets that of its group's head in a join on the fingerprint, whose hot
    keys Spark splits. Documents that differ from the head (a collision) form groups by a
    SHA-256 of their form.
    """
    shared = kept.filter("role in ('head', 'copy')").select("doc_id", "fingerprint", "role", F.col("edge").alias("form"))
    heads = checkpoint(shared.filter("role = 'head'").groupBy("fingerprint").agg(F.min("form").alias("head_form")))
    met = shared.join(heads, "fingerprint").select("doc_id", "fingerprint", F.when(F.col("form") == F.col("head_form"), F.lit("")).otherwise(F.sha2("form", 256)).alias("other"))
    met = checkpoint(met)
    sizes = checkpoint(met.groupBy("fingerprint", "other").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("copies")))
    return met.distinct().join(sizes, ["fingerprint", "other"]).select("doc_id", "fingerprint", "group_id", "copies")


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint, group_id (the group's least doc_id) and copies (its documents) of every document."""
    return with_next(docs, id_column, text_column).select("doc_id", "fingerprint", "group_id", "copies")


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The contract's columns, and group_id and copies, of every document."""
    docs = named(docs, doc_id=id_column, text=text_column)
    if unique_ids(docs, "doc_id"):
        return digested(docs, "doc_id", "text")
    docs = keyed(docs, "doc_id", "text")
    names = docs.select("_key", "doc_id")
    found = digested(docs, "_key", "text").withColumnsRenamed({"doc_id": "_key", "group_id": "_group"})
    found = found.join(names, "_key").join(names.select(F.col("_key").alias("_group"), F.col("doc_id").alias("group_id")), "_group")
    return found.select(*[f for f, _ in FIELDS if f not in ("part", "role", "edge")], "group_id", "copies")


def digested(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """with_next for ids that are unique and not null."""
    kind = docs.schema[id_column].dataType
    kept = ranged_pass(docs, id_column, text_column)
    firsts = kept.filter("role = 'first'").select(F.col("part").alias("to"), F.col("edge").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    # one number for each partition that has rows
    parts = sorted(r["to"] for r in firsts.select("to").collect())
    follows = docs.sparkSession.createDataFrame([*zip(parts, [*parts[1:], *parts[:1]], strict=True)], "part int, to int")
    opened = kept.filter("role = 'last'").join(F.broadcast(follows), "part").join(firsts, "to").select("doc_id", "edge", "fingerprint", "next_text", "next_fingerprint")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of([done(*r.values()) for r in batch.to_pylist()], batch.schema.field(0).type)

    closed = opened.mapInArrow(tidied(close), T.StructType([T.StructField(n, kind if t is None else t) for n, t in FIELDS]))
    rows = kept.filter("role = 'done'").unionByName(closed).drop("part", "role", "edge")
    return rows.join(compared(kept), ["doc_id", "fingerprint"], "left").withColumns({"group_id": F.coalesce("group_id", "doc_id"), "copies": F.coalesce("copies", F.lit(1).cast("long"))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 over all documents."""
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
