"""Corpus tables that are changed in place: hash-partitioned by their key, only the touched partitions rewritten.

A change names the keys that it touches. Their partitions, and no others, are read, changed by one
of the operators of `operators.corpus`, settled in the shared folder and written over by Spark's
dynamic partition overwrite; files of other partitions stay the files that they are. So a change
costs what it touches, not what the table has. There is one writer at a time. If a job dies while
partitions are moved to their places the same change, run again, gives the same table, for all
changes here are upserts, replacements or deletions by key.

The number of partitions is fixed when the table is made; choose it so that one fits a task at the
size that the table will have. Counters are observed on the way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import corpus
from ..session import observed, settled

PART = "_part"


class Store:
    """A parquet table under a path, partitioned by a hash of its key columns."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], parts: int):
        self.spark, self.path, self.keys, self.parts = spark, path.rstrip("/"), keys, parts

    def placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(PART, F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))

    def create(self, rows: DataFrame) -> None:
        """Make the table of these rows; of no rows, with their columns."""
        self.placed(rows).repartition(PART).write.partitionBy(PART).mode("overwrite").parquet(self.path)
        rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}.columns")

    def rows(self, parts: list[int] | None = None) -> DataFrame:
        """The table, or some partitions of it, of which only their files are read."""
        columns = self.spark.read.parquet(f"{self.path}.columns").schema
        held = self.spark.read.schema(columns.add(PART, T.IntegerType())).parquet(self.path)
        return (held if parts is None else held.filter(F.col(PART).isin(parts))).drop(PART)

    def change(self, touched: DataFrame, make: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Put make(rows) in the place of the rows of the partitions that the touched keys are in: (n_before, n_after, n_parts)."""
        parts = [r[PART] for r in self.placed(touched.select(*self.keys)).select(PART).distinct().collect()]  # numbers under `parts`
        if not parts:
            return {"n_before": 0, "n_after": 0, "n_parts": 0}
        before, after = Observation(), Observation()
        old = self.rows(parts)
        made = make(old.observe(before, F.count(F.lit(1)).alias("n"))).select(*old.columns)
        new = settled(self.placed(made).observe(after, F.count(F.lit(1)).alias("n")))
        new.repartition(PART).write.partitionBy(PART).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        # partitions that have no row any more are not overwritten
        left = {r[PART] for r in new.select(PART).distinct().collect()}
        for part in set(parts) - left:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{PART}={part}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return {"n_before": observed(before), "n_after": observed(after), "n_parts": len(parts)}


def upsert(store: Store, writes: DataFrame) -> dict[str, int]:
    """Fold writes (paper_id, seq, columns), later than all that the store has, into its papers; see `corpus.upserted`."""
    return store.change(writes, lambda old: corpus.upserted(old.unionByName(writes)))


def set_credibility(store: Store, signals: DataFrame) -> dict[str, int]:
    return store.change(signals, lambda old: corpus.with_credibility(old, signals))


def set_status(store: Store, changes: DataFrame) -> dict[str, int]:
    return store.change(changes, lambda old: corpus.with_status(old, changes))


def put(store: Store, rows: DataFrame, *order: str) -> dict[str, int]:
    """Replace rows by key, or add them; of several of a key the last by `order`."""
    last = corpus.last_written(rows, store.keys, *order)
    return store.change(rows, lambda old: old.join(last.select(*store.keys), store.keys, "left_anti").unionByName(last.select(*old.columns)))


def delete(store: Store, keys: DataFrame) -> dict[str, int]:
    """Delete rows by key; n_before - n_after of them were there."""
    gone = keys.select(*store.keys).distinct()
    return store.change(gone, lambda old: old.join(gone, store.keys, "left_anti"))
