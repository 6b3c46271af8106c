"""Named stages and the runs made of them."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import normalize
from ..functions.transliterate import transliterate
from ..operators import errors, evaluate, features, matching, validate
from ..operators.blocking import TrigramBlocker
from ..sources import sinks, tables
from .lineage import cut

TRANSLITERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {"rules": transliterate, "none": lambda df: df}
NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {"rules": normalize}
BLOCKERS: dict[str, Callable[..., TrigramBlocker]] = {"trigrams": TrigramBlocker}


def pick(registry: dict, name: str, kind: str):
    if name not in registry:
        raise ValueError(f"no {kind} is called {name!r}; there are {', '.join(sorted(registry))}")
    return registry[name]


@contextmanager
def timed(what: str, to: dict[str, float]):
    began = time.time()
    yield
    to[what] = time.time() - began


def wanted_sets(text: str, n_sets: int) -> list[int]:
    sets = [int(x) for x in text.split(",") if x.strip()]
    if any(not 0 <= k < n_sets for k in sets):
        raise ValueError(f"sets have to be from 0 to {n_sets - 1}")
    return sets


def prepare(s1: DataFrame, *others: DataFrame, transliterator: str = "rules", normalizer: str = "rules", columns: tuple[str, ...] = ("*",)) -> tuple[DataFrame, DataFrame]:
    """Both sides of the matching, normalized; of these the ``columns`` that are wanted later."""
    run = lambda df: df.transform(pick(TRANSLITERATORS, transliterator, "transliterator")).transform(pick(NORMALIZERS, normalizer, "normalizer")).select(*columns)
    return cut(run(tables.records(s1))), cut(run(tables.records(tables.targets(*others))))


def block_and_featurize(s1: DataFrame, targets: DataFrame, k: int = 20, blocker: str = "trigrams") -> tuple[DataFrame, DataFrame]:
    candidates = cut(pick(BLOCKERS, blocker, "blocker")().fit(targets).query(s1, k))
    return candidates, features.pair_features(candidates, s1, targets)


def train(train: tuple[DataFrame, DataFrame, DataFrame], val: tuple[DataFrame, DataFrame, DataFrame], matcher: matching.Matcher | None = None) -> dict:
    """Fit on one side, tune the threshold on the other; each has records, targets and truth. The sides may share no record."""
    shared = train[0].select("entity_id").join(val[0].select("entity_id"), "entity_id", "left_semi").limit(1).count()
    if shared:
        raise ValueError("training and validation share records")
    sets = []
    for s1, targets, truth in (train, val):
        a, b = prepare(s1, targets)
        candidates, feats = block_and_featurize(a, b)
        sets.append((candidates, cut(matching.labeled_pairs(feats, truth)), truth))
    model = (matcher or matching.Matcher()).fit(sets[0][1])
    candidates, labeled, truth = sets[1]
    scored = cut(model.predict(labeled))
    best = matching.tune_threshold(scored, truth).first()
    final = matching.decide(scored, best["threshold"])
    base = {r["baseline"]: r["f0_5"] for r in evaluate.baselines(truth, candidates).collect()}
    recall = evaluate.recall_at(truth, candidates, [10**9]).first()["recall"]
    return {"model": model, "threshold": best["threshold"], "f0_5": best["f0_5"], "baselines": base, "recall": recall, "candidates": candidates, "final": final, "alarms": evaluate.alarms(recall, best["f0_5"], max(base.values()))}


def predict(s1: DataFrame, targets: DataFrame, model: matching.Matcher, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Candidates and final pairs of new records."""
    a, b = prepare(s1, targets)
    candidates, feats = block_and_featurize(a, b)
    return candidates, matching.decide(model.predict(feats), threshold)


def recall_report(truth: DataFrame, candidates: DataFrame, k: int, nrows: int | None = None) -> DataFrame | None:
    """Recall of the best 1, 5, 10 and ``k``; none where only a part of the rows was read."""
    return None if nrows is not None else evaluate.recall_at(truth, candidates, {1, 5, 10, k})


def analyze(s1: DataFrame, targets: DataFrame, truth: DataFrame, model: matching.Matcher, threshold: float) -> dict[str, DataFrame]:
    """What a model gets wrong on labelled records: scores, lost and wrong pairs with examples, weights of the features."""
    a, b = prepare(s1, targets)
    candidates, feats = block_and_featurize(a, b)
    labeled = cut(model.predict(matching.labeled_pairs(feats, truth)))
    final = cut(matching.decide(labeled, threshold))
    lost, wrong = errors.lost_below(labeled, threshold), errors.wrong_pairs(truth, final)
    scored = lambda pairs: pairs.join(labeled.select("s1_id", "cand_id", "match_proba"), ["s1_id", "cand_id"])
    spark = s1.sparkSession
    return {
        "score": evaluate.macro_score(truth, final), "recall": evaluate.recall_at(truth, candidates, {1, 5, 10, 20}), "singletons": evaluate.singleton_rate(truth), "labels": matching.label_summary(labeled, truth),
        "distribution": errors.distribution(truth, final), "ceiling": errors.ceiling(truth, candidates), "wrong cases": errors.wrong_cases(truth, final),
        "lost": lost.agg(F.count(F.lit(1)).alias("n")), "lost examples": errors.examples(lost.select("s1_id", "cand_id", "match_proba"), s1, targets),
        "wrong examples": errors.examples(scored(wrong.select("s1_id", "cand_id")), s1, targets), "weights": spark.createDataFrame(model.importance(), "feature string, weight double"),
    }


def report(found: dict[str, DataFrame], rows: int = 20) -> None:
    for name, df in found.items():
        print(f"== {name}")
        for r in df.limit(rows).collect():
            print("  " + ", ".join(f"{k} {v:.6g}" if isinstance(v, float) else f"{k} {v}" for k, v in r.asDict().items()))


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description="Link business records across sources.")
    runs = parser.add_subparsers(dest="run", required=True)

    def add(name: str, text: str, *options: tuple[str, dict]) -> None:
        p = runs.add_parser(name, help=text)
        for option, how in options:
            p.add_argument(option, **how)

    need, number = {"required": True}, {"required": True, "type": float}
    sets = (("--train", {**need, "help": "folder with train_source1.tsv and so on"}), ("--sets-dir", need), ("--n-sets", {"type": int, "default": 5}))
    add("split", "write all sets and print their sizes", *sets)
    add("block", "candidates of some sets and their recall; names of stages from a file of settings", *sets, ("--sets", need), ("--k", {"type": int, "default": 20}), ("--config", {"default": ".env"}))
    add("train", "fit on some sets, tune on another, save the model and write the results", *sets, ("--train-sets", need), ("--val-set", need), ("--model", need), ("--out", need))
    add("analyze", "errors of a model on some sets", *sets, ("--sets", need), ("--model", need), ("--threshold", number))
    add("predict", "match the records of a test folder with a saved model", ("--model", need), ("--test", need), ("--out", need), ("--threshold", number))
    add("validate", "check result files; fails if there are errors", ("--results", need), ("--test", need), ("--check-ids", {"action": "store_true"}))
    return parser


def write_results(candidates: DataFrame, final: DataFrame, s1: DataFrame, out: str) -> None:
    spine = s1.select(F.col("entity_id").alias("s1_id")).distinct()
    sinks.write_candidates(candidates, spine, f"{out}/candidate_pairs.tsv")
    sinks.write_matches(final, spine, f"{out}/matching_results.tsv")


def main(args: Iterable[str] | None = None) -> int:
    """Run one of the commands; 1 if a validation found errors, else 0."""
    a = _arguments().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    took: dict[str, float] = {}

    def side(text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        wanted = wanted_sets(text, a.n_sets)
        with timed("sets", took):
            sinks.ensure_sets(spark, a.train, a.sets_dir, wanted, a.n_sets)
        return tables.load_sets(spark, a.sets_dir, wanted)

    if a.run == "split":
        report({"counts": sinks.write_sets(spark, a.train, a.sets_dir, a.n_sets)}, 10**6)
    elif a.run == "block":
        config = tables.load_config(a.config) if tables.config_there(a.config) else {}
        s1, targets, truth = side(a.sets)
        with timed("normal forms", took):
            x, y = prepare(s1, targets, transliterator=config.get("TRANSLITERATOR", "rules"), normalizer=config.get("NORMALIZER", "rules"))
        with timed("candidates", took):
            candidates = cut(pick(BLOCKERS, config.get("BLOCKER", "trigrams"), "blocker")().fit(y).query(x, a.k))
        report({"recall": recall_report(truth, candidates, a.k), "candidates": evaluate.mean_candidates(truth, candidates)})
    elif a.run == "train":
        val = side(a.val_set)
        with timed("training", took):
            found = train(side(a.train_sets), val)
        found["model"].save(a.model)
        write_results(found["candidates"], found["final"], val[0], a.out)
        print("\n".join([f"{k} {found[k]}" for k in ("threshold", "f0_5", "baselines", "recall")] + [f"warning: {w}" for w in found["alarms"]]))
    elif a.run == "analyze":
        report(analyze(*side(a.sets), matching.Matcher.load(a.model), a.threshold))
    elif a.run == "predict":
        s1, s2, s3 = (tables.read_tsv(spark, f"{a.test}/test_source{i}.tsv") for i in (1, 2, 3))
        candidates, final = predict(s1, tables.targets(s2, s3), matching.Matcher.load(a.model), a.threshold)
        write_results(candidates, final, s1, a.out)
    else:
        wrong, warnings = validate.validate_folder(spark, a.results, a.test, a.check_ids)
        print("\n".join([f"warning {i}: {w}" for i, w in enumerate(warnings, 1)] + [f"error {i}: {e}" for i, e in enumerate(wrong, 1)] + [f"{len(wrong)} errors, {len(warnings)} warnings"]))
        return 1 if wrong else 0
    for what, seconds in took.items():
        print(f"{what}: {seconds:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
