"""The best items of every group (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_items(pairs: DataFrame, n: int = 5, group: str = "s1_id", item: str = "cand_id", score: str = "score") -> DataFrame:
    """``group, item, score, rank`` of the ``n`` distinct items of highest score in each group.

    An item given more than once counts with its highest score; among equal scores the smaller item comes first. Rows with
    a null group or item, or a null or NaN score, do not count. Repeats are combined before any shuffle; a rank
    filter on ``row_number`` lets the optimiser keep ``n`` rows of a group in each task before the second one, so a group
    with a third of all rows moves little. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = pairs.select(F.col(group), F.col(item), F.col(score)).where(F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    best = rows.groupBy(group, item).agg(F.max(score).alias(score))
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(item).asc())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
