"""What tells true candidate pairs from false ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import partial_ratio, similarity_column, token_set_ratio

COLUMNS = ("score", "rank", "score_gap", "name_jaccard", "name_token_set", "name_partial", "name_extra_tokens", "addr_jaccard", "addr_token_set", "legal_agree", "legal_missing", "num_jaccard", "num_overlap", "s1_addr_empty", "cand_addr_empty")


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda t: t != ""))


def numbers(c: Column) -> Column:
    """Words of digits only, where ``/`` and ``-`` part words and a comma stays with its word."""
    return F.array_distinct(F.filter(F.split(F.translate(c, "/-", "  "), r"\s+"), lambda t: t.rlike("^[0-9]+$")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all words; 0 if neither side has one."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def ranked(pairs: DataFrame) -> DataFrame:
    """Add ``rank`` from 0 by score and id, and ``score_gap`` to the best score of the record."""
    by = Window.partitionBy("s1_id")
    order = by.orderBy(F.round("score", 6).desc(), "cand_id")
    return pairs.withColumn("rank", (F.row_number().over(order) - 1).cast("int")).withColumn("score_gap", F.col("score") - F.max("score").over(by))


def sides(records: DataFrame, prefix: str) -> DataFrame:
    """Texts and word sets of each record, made once however many pairs it is in."""
    r = records.dropDuplicates(["entity_id"])
    cols = {"name": F.col("name_norm"), "addr": F.col("address_norm"), "legal": F.col("legal_form"), "nw": words(F.col("name_norm")), "aw": words(F.col("address_norm")), "num": numbers(F.col("address_norm"))}
    return r.select(F.col("entity_id").alias(f"{prefix}_id"), *(c.alias(f"{prefix}_{k}") for k, c in cols.items()))


def pair_features(pairs: DataFrame, s1: DataFrame, targets: DataFrame, fuzzy: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """``s1_id, cand_id``, the columns of ``pairs`` to ``keep``, and ``COLUMNS``; pairs with an unknown id are dropped.

    Without ``fuzzy`` the three ratios that need Python are left out.
    """
    x = ranked(pairs).join(sides(s1, "s1"), "s1_id").join(sides(targets, "cand"), "cand_id")
    flag = lambda c: c.cast("double")
    both = lambda k: (F.col(f"s1_{k}"), F.col(f"cand_{k}"))
    a, b = both("nw")
    la, lb = both("legal")
    made = {
        "name_jaccard": jaccard(a, b), "name_extra_tokens": (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))).cast("double"), "addr_jaccard": jaccard(*both("aw")),
        "legal_agree": flag((la != "") & (la == lb)), "legal_missing": flag((la == "") | (lb == "")), "num_jaccard": jaccard(*both("num")), "num_overlap": flag(F.arrays_overlap(*both("num"))),
        "s1_addr_empty": flag(F.col("s1_addr") == ""), "cand_addr_empty": flag(F.col("cand_addr") == ""),
    }
    if fuzzy:
        made |= {"name_token_set": similarity_column(token_set_ratio, *both("name")), "name_partial": similarity_column(partial_ratio, *both("name")), "addr_token_set": similarity_column(token_set_ratio, *both("addr"))}
    return x.withColumns(made).select("s1_id", "cand_id", *keep, *(c for c in COLUMNS if c in made or c in ("score", "rank", "score_gap")))
