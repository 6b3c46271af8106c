"""What goes wrong: breakdowns of scores, lost pairs and wrong pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import entity_scores, joined


def distribution(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """``perfect, zero, partial`` shares of the records' scores."""
    share = lambda c: F.avg(c.cast("double"))
    f = F.col("f0_5")
    return entity_scores(truth, pairs).agg(share(f == 1).alias("perfect"), share(f == 0).alias("zero"), share((f > 0) & (f < 1)).alias("partial"))


def ceiling(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """``entities, fully, partially``: records with true ids, of which blocking lost all or some."""
    j = joined(truth, candidates).where(F.size("ids") > 0)
    missed = F.size(F.array_except("ids", "pred"))
    return j.agg(F.count(F.lit(1)).alias("entities"), F.count_if(missed == F.size("ids")).alias("fully"), F.count_if((missed > 0) & (missed < F.size("ids"))).alias("partially"))


def wrong_pairs(truth: DataFrame, final: DataFrame) -> DataFrame:
    """``s1_id, cand_id, owner, case``: accepted pairs that are not true; ``stolen`` from an owner, or ``unclaimed``."""
    true = truth.select(F.col("s1_id"), F.explode("ids").alias("cand_id"))
    owner = true.groupBy("cand_id").agg(F.min("s1_id").alias("owner"))
    wrong = final.select("s1_id", "cand_id").join(truth.select("s1_id"), "s1_id", "left_semi").join(true, ["s1_id", "cand_id"], "left_anti")
    return wrong.join(owner, "cand_id", "left").select("s1_id", "cand_id", "owner", F.when(F.col("owner").isNull(), "unclaimed").otherwise("stolen").alias("case"))


def wrong_cases(truth: DataFrame, final: DataFrame) -> DataFrame:
    """``case, n, share`` of the wrong pairs."""
    n = wrong_pairs(truth, final).groupBy("case").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("case", "n", (F.col("n") / F.col("all")).alias("share"))  # one row


def lost_below(labeled: DataFrame, threshold: float) -> DataFrame:
    """True pairs whose probability is below the threshold; those lost later are not counted."""
    return labeled.where((F.col("label") == 1) & (F.col("match_proba") < threshold))


def examples(pairs: DataFrame, s1: DataFrame, targets: DataFrame, n: int = 10) -> DataFrame:
    """The texts of the ``n`` worst pairs, by probability and then by ids."""
    worst = pairs.orderBy(F.col("match_proba").desc(), "s1_id", "cand_id").limit(n)
    cols = ("business_name", "business_address")
    left = s1.select(F.col("entity_id").alias("s1_id"), *(F.col(c).alias(f"s1_{c}") for c in cols))
    right = targets.select(F.col("entity_id").alias("cand_id"), *(F.col(c).alias(f"cand_{c}") for c in cols))
    worst = F.broadcast(worst)  # at most n rows
    return worst.join(left, "s1_id").join(right, "cand_id")
