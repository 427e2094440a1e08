"""Global row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import box, boxed
from .spaces import checkpoint


def row_numbers(df: DataFrame, *order: str, name: str = "row_number") -> tuple[DataFrame, int]:
    """df with its 0-based row numbers in the given order as a last column, and the number of rows.

    Rows are range-partitioned by the order (a shuffle of the given columns only, so pass
    narrow rows), sorted within partitions and checkpointed, which fixes the partitions.
    Only the count of each partition comes to the driver; it goes back as a table of one row
    for each partition. Rows that tie in the whole order are numbered arbitrarily among
    themselves. Nulls come first. An empty input gives an empty table and 0. Columns of df may
    have any names.
    """
    spark = df.sparkSession
    keys = [box(df, c) for c in order]
    kept = checkpoint(boxed(df).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = sorted((r["part"], r["n"]) for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    total, offsets = 0, []
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    out = kept.join(table, part == F.col("part")).withColumn("number", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
    return out.drop("at", "part", "before").toDF(*df.columns, name), total
