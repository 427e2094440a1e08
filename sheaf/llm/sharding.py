"""Operator 3: a reproducible shuffle into shards by a Feistel permutation of global row numbers.

Row number x of N (ascending doc_id) goes to place pi(x) of a permutation pi of 0..N-1, and
from there to shard pi(x) mod S at slot pi(x) div S. Shard and slot are computable from x, N,
S and the seed alone, shards differ by one row at most, slots have no gaps.

pi is a Feistel network on pairs (x div a, x mod a), a = ceil(sqrt(N)), whose round function is
Spark's own xxhash64; places in a*a that are not below N walk on along their cycle. All of it
is DataFrame expressions.

Defined results: null texts have 16 bytes of size and the CRC of the empty text; repeated rows
and equal doc_ids are numbered one after the other, by text size and CRC; an empty table gives
an empty result; other columns of the input are ignored, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import named
from .numbering import row_numbers

ROUNDS = 6
SHARDS = 40


def feistel(x: Column, side: int, seed: int, rounds: int = ROUNDS) -> Column:
    """One pass of the network over 0 .. side*side - 1; a bijection for every seed."""
    start = F.struct((x.cast("long") / side).cast("long").alias("l"), (x.cast("long") % side).alias("r"))
    keys = F.array(*(F.lit(seed * 1_000_003 + i).cast("long") for i in range(rounds)))
    end = F.aggregate(keys, start, lambda s, k: F.struct(s["r"].alias("l"), ((s["l"] + F.pmod(F.xxhash64(k, s["r"]), F.lit(side).cast("long"))) % side).alias("r")))
    return F.aggregate(F.array(end), F.lit(0).cast("long"), lambda _, e: e["l"] * side + e["r"])


def walk(x: Column, n: int, side: int, seed: int, steps: int) -> Column:
    """One pass, then at most `steps` more while the place is not below n."""
    first = feistel(x, side, seed)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda y, _: F.when(y < n, y).otherwise(feistel(y, side, seed))) if steps else first


def longest_walk(spark: SparkSession, n: int, side: int, seed: int) -> int:
    """Steps that suffice: tried on the places from n on, of which there are fewer than 2*sqrt(n) + 1."""
    steps = 0
    left = spark.range(n, side * side).select(F.col("id").alias("y"))
    for steps in (1, 4, 16, 64, 256, 1024):
        moved = left.select(walk(F.col("y"), n, side, seed, steps - 1).alias("y"))
        if not moved.filter(F.col("y") >= n).limit(1).count():
            return steps
    return side * side - n


def permuted(rows: DataFrame, total: int, seed: int, number: str = "row_number", name: str = "place") -> DataFrame:
    """rows with the place of each row number under the permutation."""
    side = max(1, math.isqrt(max(total - 1, 0)) + 1)
    steps = longest_walk(rows.sparkSession, total, side, seed) if side * side > total else 0
    return rows.withColumn(name, walk(F.col(number), total, side, seed, steps))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, place, shard and slot of every document."""
    text = F.coalesce("text", F.lit(""))
    narrow = named(docs, doc_id=id_column, text=text_column).select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    numbered, total = row_numbers(narrow, "doc_id", "size", "text_crc32")
    placed = permuted(numbered, total, seed)
    return placed.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", (F.col("place") / shards).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: law `rows`: the shards' counts are at most one apart, whatever the texts are."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "place")
