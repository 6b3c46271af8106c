"""Labels, the classifier, and the step from probabilities to matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import boosting
from .evaluate import f05
from .features import COLUMNS

GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))


def labeled_pairs(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidates with ``label`` 1 where the truth lists them, 0 elsewhere."""
    true = truth.select("s1_id", F.explode("ids").alias("cand_id")).distinct().withColumn("label", F.lit(1))
    return candidates.join(true, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def label_summary(labeled: DataFrame, truth: DataFrame) -> DataFrame:
    """``positives, negatives, negative_rate, true_pairs, recovered, missed``."""
    n = labeled.agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))
    t = truth.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("bigint").alias("true_pairs"))
    p, q = F.col("positives"), F.col("negatives")
    return n.crossJoin(t).select("positives", "negatives", F.when(p + q == 0, 0.0).otherwise(q / (p + q)).alias("negative_rate"), "true_pairs", p.alias("recovered"), (F.col("true_pairs") - p).alias("missed"))


class Matcher:
    """Boosted trees over the pair features; a true pair weighs as much as all false ones do for each of it."""

    def __init__(self, rounds: int = 400, depth: int = 6, step: float = 0.05, share: float = 0.8, seed: int = 0, weight: float | None = None):
        self.params = {"maxIter": rounds, "maxDepth": depth, "stepSize": step, "subsamplingRate": share, "featureSubsetStrategy": str(share), "seed": seed}
        self.weight = weight
        self.model: boosting.Forest | None = None

    def fit(self, labeled: DataFrame) -> Matcher:
        n = labeled.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")).first()
        weight = self.weight if self.weight is not None else n["q"] / n["p"] if n["p"] and n["q"] else 1.0
        p = self.params
        self.model = boosting.fit(labeled, COLUMNS, n["p"] + n["q"], weight, p["maxIter"], p["maxDepth"], p["stepSize"], p["subsamplingRate"], float(p["featureSubsetStrategy"]), p["seed"])
        return self

    def predict(self, features: DataFrame) -> DataFrame:
        """Add ``match_proba``."""
        if self.model is None:
            raise ValueError("the matcher has not been fitted")
        return features.withColumn("match_proba", self.model.probability([F.col(c).cast("double") for c in COLUMNS]))

    def importance(self) -> list[tuple[str, float]]:
        if self.model is None:
            raise ValueError("the matcher has not been fitted")
        return sorted(zip(COLUMNS, self.model.importance().tolist()), key=lambda x: (-x[1], x[0]))

    def save(self, path: str) -> None:
        if self.model is None:
            raise ValueError("the matcher has not been fitted")
        SparkSession.active().createDataFrame([(self.model.text(),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str, **params: object) -> Matcher:
        m = cls(**params)
        m.model = boosting.Forest.of(SparkSession.active().read.parquet(path).first()["model"])
        return m


def decide(scored: DataFrame, threshold: float, margin: float | None = None) -> DataFrame:
    """Pairs at or above the threshold, within the margin of their record's best, each candidate with one record.

    The margin is applied before candidates are made unique; equal probabilities go to the smaller record id.
    """
    kept = scored.where(F.col("match_proba") >= threshold)
    if margin is not None:
        kept = kept.withColumn("_best", F.max("match_proba").over(Window.partitionBy("s1_id"))).where(F.col("match_proba") >= F.col("_best") - margin).drop("_best")
    first = Window.partitionBy("cand_id").orderBy(F.col("match_proba").desc(), "s1_id")
    return kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def threshold_scores(scored: DataFrame, truth: DataFrame, thresholds: Sequence[float] = GRID, margin: float | None = None) -> DataFrame:
    """``threshold, f0_5`` for each threshold, in one job.

    Raising the threshold only takes rows away from the end of each candidate's and record's order, so who wins a candidate and
    what is within the margin is settled once, at the lowest threshold.
    """
    pairs = decide(scored, min(thresholds), margin)
    grid = F.explode(F.array(*map(F.lit, sorted(thresholds)))).alias("threshold")
    pred = pairs.groupBy("s1_id").agg(F.collect_list(F.struct("match_proba", "cand_id")).alias("p"))
    each = truth.select("s1_id", "ids").join(pred, "s1_id", "left").select("s1_id", "ids", "p", grid)
    above = F.coalesce(F.array_distinct(F.transform(F.filter("p", lambda x: x["match_proba"] >= F.col("threshold")), lambda x: x["cand_id"])), F.array().cast("array<string>"))
    return each.withColumn("pred", above).groupBy("threshold").agg(F.avg(f05(F.col("ids"), F.col("pred"))).alias("f0_5"))


def tune_threshold(scored: DataFrame, truth: DataFrame, thresholds: Sequence[float] = GRID, margin: float | None = None) -> DataFrame:
    """``threshold, f0_5`` of the best score; of several the lowest threshold."""
    return threshold_scores(scored, truth, thresholds, margin).orderBy(F.round("f0_5", 12).desc(), "threshold").limit(1)
