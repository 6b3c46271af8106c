"""Hash splits in which matches follow the record that owns them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def set_of(entity_id: Column, n_sets: int) -> Column:
    """The set of an id: its unsigned CRC-32 modulo the number of sets."""
    return (F.crc32(F.encode(entity_id, "utf-8")) % F.lit(n_sets)).cast("int")


def owners(truth: DataFrame, n_sets: int) -> DataFrame:
    """``entity_id, owner_set`` for each matched id; of several owners the smallest id counts."""
    pairs = truth.select("s1_id", F.explode("ids").alias("entity_id"))
    return pairs.groupBy("entity_id").agg(F.min("s1_id").alias("s1_id")).select("entity_id", set_of(F.col("s1_id"), n_sets).alias("owner_set"))


def assigned(records: DataFrame, truth: DataFrame, n_sets: int) -> DataFrame:
    """Records with ``set_id``: that of the owner for a matched record, its own otherwise."""
    return records.join(owners(truth, n_sets), "entity_id", "left").withColumn("set_id", F.coalesce("owner_set", set_of(F.col("entity_id"), n_sets))).drop("owner_set")


def counts(spark: SparkSession, split: DataFrame, n_sets: int) -> DataFrame:
    """``set_id, source, n`` for every set and source, 0 where a set is empty."""
    every = spark.range(n_sets).select(F.col("id").cast("int").alias("set_id"))
    grid = every.crossJoin(F.broadcast(split.select("source").distinct()))  # a row for each source
    n = split.groupBy("set_id", "source").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["set_id", "source"], "left").select("set_id", "source", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
