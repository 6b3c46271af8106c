"""Scores of matches and candidates against known lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _none() -> Column:
    return F.array().cast("array<string>")


def joined(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """``s1_id, ids, pred`` for every row of the truth; predictions for others are ignored."""
    pred = pairs.groupBy("s1_id").agg(F.collect_set("cand_id").alias("pred"))
    return truth.select("s1_id", "ids").join(pred, "s1_id", "left").withColumn("pred", F.coalesce("pred", _none()))


def f05(ids: Column, pred: Column) -> Column:
    """F0.5 of one record: 1 if both are empty, 0 without a hit."""
    hits = F.size(F.array_intersect(ids, pred))
    p, r = hits / F.size(pred), hits / F.size(ids)
    return F.when(F.size(ids) == 0, F.when(F.size(pred) == 0, 1.0).otherwise(0.0)).when(hits == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_scores(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """``s1_id, f0_5, n_true, n_pred, false_pos, false_neg``."""
    j = joined(truth, pairs)
    return j.select(
        "s1_id", f05(F.col("ids"), F.col("pred")).alias("f0_5"), F.size("ids").alias("n_true"), F.size("pred").alias("n_pred"),
        F.size(F.array_except("pred", "ids")).alias("false_pos"), F.size(F.array_except("ids", "pred")).alias("false_neg"),
    )


def macro_score(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """``f0_5``, the mean over all records of the truth; null for an empty truth."""
    return entity_scores(truth, pairs).agg(F.avg("f0_5").alias("f0_5"))


def recall_at(truth: DataFrame, candidates: DataFrame, ks: Iterable[int]) -> DataFrame:
    """``k, recall`` of the best ``k`` candidates: hits over true pairs, 1 if there are none. One pass for all ``k``."""
    ks = sorted(set(ks))
    lists = truth.where("ids is not null").groupBy("s1_id").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    total = lists.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"))
    # joined by record, as candidates lie after they are ranked; most of them are gone before anything else
    times = F.size(F.filter("ids", lambda x: x == F.col("cand_id")))
    hit = candidates.select("s1_id", "cand_id", "rank").join(lists, "s1_id").select("s1_id", "cand_id", "rank", times.alias("times")).where("times > 0")
    # a pair counts each time it is listed, at its best rank, however often it is a candidate
    best = hit.groupBy("s1_id", "cand_id").agg(F.min("rank").alias("rank"), F.max("times").alias("times"))
    sums = total.crossJoin(best.agg(*(F.coalesce(F.sum(F.when(F.col("rank") < k, F.col("times"))), F.lit(0)).alias(f"h{k}") for k in ks)))
    table = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.when(F.col("n") == 0, 1.0).otherwise(F.col(f"h{k}") / F.col("n")).alias("recall")) for k in ks)))
    return sums.select(table.alias("x")).select("x.k", "x.recall")


def mean_candidates(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """``mean_candidates`` over all records of the truth."""
    return joined(truth, candidates).agg(F.avg(F.size("pred")).alias("mean_candidates"))


def candidates_per_record(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """``pairs_per_record``: all pairs over all records, whether labelled or not."""
    return candidates.agg(F.count(F.lit(1)).alias("p")).crossJoin(records.agg(F.count(F.lit(1)).alias("r"))).select((F.col("p") / F.nullif(F.col("r"), F.lit(0))).alias("pairs_per_record"))


def singleton_rate(truth: DataFrame) -> DataFrame:
    """``singleton_rate``: the share of records without a true match; null for an empty truth."""
    return truth.agg(F.avg((F.size("ids") == 0).cast("double")).alias("singleton_rate"))


def baselines(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """``baseline, f0_5`` of predicting nothing and of taking the best candidate of each record."""
    nothing = macro_score(truth, candidates.where("false")).select(F.lit("nothing").alias("baseline"), "f0_5")
    top = macro_score(truth, candidates.where("rank = 0")).select(F.lit("top1").alias("baseline"), "f0_5")
    return nothing.union(top)


def alarms(recall: float, score: float, baseline: float) -> list[str]:
    """What looks wrong about a run."""
    out = []
    if recall < 0.85:
        out.append(f"blocking finds only {recall:.3f} of the true pairs")
    if score <= baseline + 0.02:
        out.append(f"the score {score:.3f} hardly beats the baseline {baseline:.3f}")
    return out
