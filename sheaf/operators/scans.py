"""Running sums, counts and maxima over groups of any size, by partitioned prefix scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows range-partitioned and sorted by group and order, with their place (_at) and partition (_part), which a checkpoint fixes.

    A large group takes several partitions, so no task has the whole of it.
    """
    ordered = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    return settled(ordered.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))


def running(rows: DataFrame, group: list[str], name: str, how: str, value: Column, before: bool = False) -> DataFrame:
    """placed rows with the running `sum` or `max` of a value within their group; with `before`, without the row itself.

    Each partition's share of a group is scanned by itself; what came before it, one number for
    each partition and group, is scanned in a second step and added.
    """
    reduce, both = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest)}[how]
    valued = rows.withColumn("_value", value)
    totals = valued.groupBy(*group, "_part").agg(reduce("_value").alias("_total"))
    earlier = totals.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), reduce("_total").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    inner = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = valued.withColumn("_local", reduce("_value").over(inner))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return local.join(earlier, same).withColumn(name, both(F.col("_earlier"), F.col("_local"))).drop("_value", "_local", "_earlier", "_p", *[f"_g{i}" for i in range(len(group))])
