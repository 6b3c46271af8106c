"""Splits that keep related records together (problem 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import spread_rank
from .components import connected_components

FULL_WIDTH = "０１２３４５６７８９ＢＥＳｂｅｓ"
PLAIN_WIDTH = "0123456789BESbes"


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.translate(c, FULL_WIDTH, PLAIN_WIDTH)), "[^0-9A-Z]", "")


def owner_id(c: Column) -> Column:
    """The owner as ``BE-`` and eight digits; null for a missing one, for any text without a number, and for number 0."""
    digits = F.regexp_extract(_letters(c), "^BE0*([0-9]+)$", 1)
    return F.when((digits == "") | (digits == "0"), F.lit(None)).otherwise(F.concat(F.lit("BE-"), F.lpad(digits, F.greatest(F.length(digits), F.lit(8)), F.lit("0"))))


def record_id(c: Column) -> Column:
    """A record id as ``S<n>-`` and nine digits, null for anything else."""
    t = _letters(c)
    digits = F.regexp_extract(t, "^S[123]0*([0-9]+)$", 1)
    return F.when(digits == "", F.lit(None)).otherwise(F.concat(F.lit("S"), F.substring(t, 2, 1), F.lit("-"), F.lpad(digits, F.greatest(F.length(digits), F.lit(9)), F.lit("0"))))


def record_ids(c: Column) -> Column:
    """All ids of a list as meant: between commas, semicolons or bars, cleaned, without repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;|]"), record_id), lambda x: x.isNotNull()))


def related_groups(labels: DataFrame) -> DataFrame:
    """``source1_entity_id, component, group_id`` for each labelled record.

    Rows are tied by their record, their owner, and each matched id. A row without a record id still ties its owner to its
    matched ids. ``group_id`` is the smallest owner of the component, null if none of its rows names one. Nulls, stand-ins
    and unreadable ids tie nothing; repeated rows count once; extra columns are ignored.
    """
    rows = labels.select(
        record_id(F.col("source1_entity_id")).alias("s1"), owner_id(F.col("entity_id")).alias("owner"), record_ids(F.col("matched_entity_ids")).alias("ids")
    ).distinct()
    rows = rows.withColumn("hub", F.coalesce("s1", "owner", F.get("ids", F.lit(0)))).where("hub is not null")
    edges = rows.select(F.col("hub").alias("u"), F.explode(F.concat(F.array("hub"), F.when(F.col("owner").isNull(), F.array().cast("array<string>")).otherwise(F.array("owner")), "ids")).alias("v"))
    parts = connected_components(edges)
    owners = parts.where(F.col("node").startswith("BE-")).groupBy("component").agg(F.min("node").alias("group_id"))
    return parts.where(F.col("node").startswith("S1-")).join(owners, "component", "left").select(F.col("node").alias("source1_entity_id"), "component", "group_id")


def shared_groups(labels: DataFrame) -> DataFrame:
    """``source1_entity_id, group_id`` of the groups with an owner and two or more records."""
    g = related_groups(labels)
    sizes = g.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("group_id").alias("group_id")).where("n > 1 and group_id is not null")
    return g.drop("group_id").join(sizes, "component").select("source1_entity_id", "group_id")


def plan_groups(sizes: Sequence[tuple[int, int]], shares: Sequence[float]) -> list[tuple[int, int, list[int]]]:
    """Largest-first assignment over (size, number of groups): how many groups of each size go to each split.

    Each group goes to the split that is furthest below its target, the first of several. Many groups of one size are
    dealt out in bulk down to the point where single steps give the same counts.
    """
    total = sum(s * n for s, n in sizes)
    below = [share / sum(shares) * total for share in shares]
    out = []
    for size, number in sorted(sizes, reverse=True):
        given, left = [0] * len(shares), number
        while left > 4 * len(shares) and size:
            # the level to which the shortfalls sink when all remaining groups are dealt
            order, level, used = sorted(below, reverse=True), 0.0, 0.0
            for k, top in enumerate(order, 1):
                used += top
                level = (used - size * left) / k
                if k == len(order) or level >= order[k]:
                    break
            bulk = [max(0, int((b - level) // size) - 1) for b in below]
            if not any(bulk):
                break
            for i, k in enumerate(bulk):
                given[i] += k
                below[i] -= k * size
                left -= k
        for _ in range(left):
            i = max(range(len(below)), key=lambda j: (below[j], -j))
            given[i] += 1
            below[i] -= size
        out.append((size, number, given))
    return out


def grouped_splits(labels: DataFrame, shares: dict[str, float] | None = None, seed: int = 17) -> DataFrame:
    """``source1_entity_id, component, split``: whole groups, in the given proportions of records.

    Which groups of one size go where is decided by a seeded hash. The driver sees only the histogram of group
    sizes, which has at most the square root of twice the number of records as rows.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    g = related_groups(labels).select("source1_entity_id", "component")
    groups = g.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    histogram = [(r["size"], r["n"]) for r in groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()]
    names, bounds = list(shares), []
    for size, _, given in plan_groups(histogram, list(shares.values())):
        at = 0
        for name, k in zip(names, given):
            if k:
                bounds.append((size, at + 1, at + k, name))
                at += k
    spark = labels.sparkSession
    table = spark.createDataFrame(bounds, "size bigint, first bigint, last bigint, split string")
    ranked = spread_rank(groups, ["size"], F.xxhash64(F.lit(seed), "component"), F.col("component"), "rank")
    # the table has at most splits x sizes rows
    placed = ranked.join(F.broadcast(table), "size").where("rank between first and last").select("component", "split")
    return g.join(placed, "component")
