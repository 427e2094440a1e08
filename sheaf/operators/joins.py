"""Joins that the engine offers beyond equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """left with the values of right's last row of the same keys at or before its time.

    Both sides are put together and the last value carried forward, so there is one shuffle and
    no row for pairs. Right rows must be unique by keys and time.
    """
    tagged = left.select("*", *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values), F.lit(1).alias("_side"))
    other = right.select(*keys, time, *values, F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = other.unionByName(tagged, allowMissingColumns=True)
    filled = both.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})
    return filled.filter("_side = 1").select(*left.columns, *values)
