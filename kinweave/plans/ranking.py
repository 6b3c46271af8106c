"""Ranks inside groups of any size, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread_rank(df: DataFrame, keys: list[str], order: Column, tie: Column, name: str, slices: int = 64) -> DataFrame:
    """Add the 1-based rank of each row in its group, in the order of a 64-bit hash.

    ``order`` has to be a bigint spread evenly (a hash); ``tie`` tells rows with equal hashes apart. A group is cut into
    ``slices`` ranges of the hash. Each range is ranked by itself and shifted by the rows in the ranges before it, so a
    group with a third of all rows is sorted by many tasks. The table of range sizes has at most ``slices`` rows a group.
    """
    at = "__slice"
    cut = df.withColumn("__order", order).withColumn(at, F.pmod(F.shiftrightunsigned(F.col("__order"), 40), F.lit(slices)).cast("int"))
    sizes = cut.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, at).orderBy("__order", tie)
    ranked = cut.withColumn("__inside", F.row_number().over(inside))
    left, right = ranked.alias("l"), sizes.alias("r")
    same = F.lit(True)
    for k in [*keys, at]:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return (
        left.join(right, same)
        .select("l.*", (F.col("l.__inside") + F.col("r.__before")).cast("bigint").alias(name))
        .drop("__order", "__inside", at)
    )
