"""Pairs of records from groups of records, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 2000  #: records of a group that one share of its pairs starts from


def merged(df: DataFrame) -> DataFrame:
    """The table, to be joined by sorting and never sent to all tasks.

    Before a table is made, Spark takes its size from the files it comes from; after an explode, a batch of Python or a checkpoint of these it is
    larger by any factor, and one taken as small passes through the driver to be broadcast.
    """
    return df.hint("merge")


def pairs_within(rows: DataFrame, keys: list[str], raw: str = "raw", share: int = SHARE) -> DataFrame:
    """``entity_id_1 < entity_id_2`` and the keys, for records of one group whose ``raw`` texts differ.

    ``rows`` has one row for each ``entity_id, *keys, raw``. Groups in which all texts are equal are dropped before
    anything is paired. The pairs of a large group are made in shares: each record starts pairs in one share and meets
    all others there, so no task makes more than ``share`` times the group's size. A record paired through
    several texts comes out once.
    """
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(raw).alias("__a"), F.max(raw).alias("__b")).where("__a <> __b").drop("__a", "__b")
    kept = rows.select("entity_id", *keys, F.col(raw).alias("__raw")).join(merged(n), keys).withColumn("__shares", F.ceil(F.col("__n") / F.lit(share)).cast("int"))
    left = kept.select(*keys, F.col("entity_id").alias("entity_id_1"), F.col("__raw").alias("__r1"), F.pmod(F.xxhash64("entity_id"), F.col("__shares")).cast("int").alias("__s"))
    right = kept.select(*keys, F.col("entity_id").alias("entity_id_2"), F.col("__raw").alias("__r2"), F.explode(F.sequence(F.lit(0), F.col("__shares") - 1)).alias("__s"))
    return left.join(merged(right), [*keys, "__s"]).where("entity_id_1 < entity_id_2 and __r1 <> __r2").select("entity_id_1", "entity_id_2", *keys).distinct()


def meet(left: DataFrame, right: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """The equi-join of two tables on ``key`` for keys that may hold any number of rows on either side.

    The rows of a key with more than ``share`` rows on the right are dealt into shares, and those of the left go to each of them; so no
    task makes more than ``share`` times the left rows of a key. Only such keys are in the table of sizes.
    """
    hot = right.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > share).select(key, F.ceil(F.col("__n") / F.lit(share)).cast("int").alias("__shares"))
    spread = F.struct(*(F.col(c) for c in right.columns))  # of the row itself, so a task that runs again deals alike
    dealt = right.join(hot, key, "left").withColumn("__s", F.when(F.col("__shares").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("__shares")).cast("int"))).drop("__shares")
    every = left.join(hot, key, "left").withColumn("__s", F.explode(F.sequence(F.lit(0), F.coalesce("__shares", F.lit(1)) - 1))).drop("__shares")
    return every.join(merged(dealt), [key, "__s"]).drop("__s")
