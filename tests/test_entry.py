import importlib.util
import pathlib

import duckdb
import pytest

import __spark_entry__
from kinweave.plans import pipeline
from kinweave.plans.ranking import spread_rank
from kinweave.streaming.incremental import block_stream

DATA = pathlib.Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_need_the_other_part():
    root = pathlib.Path(__spark_entry__.__file__).parent / "kinweave"
    for p in root.rglob("*.py"):
        if p.relative_to(root).parts[0] != "llm":
            text = p.read_text()
            assert "kinweave.llm" not in text and "from ..llm" not in text and "from .llm" not in text
    assert importlib.util.find_spec("kinweave.plans.queries")


@pytest.mark.skipif(not DATA.exists(), reason="no data")
@pytest.mark.parametrize("name", ["block_topk", "pair_jaccard", "tune_threshold", "split_counts", "validate_subset"])
def test_oracles(spark, name):
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    want = c.execute(__spark_entry__.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    df = __spark_entry__.queries()[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want.fetchall())


def test_registries():
    with pytest.raises(ValueError, match="no blocker"):
        pipeline.pick(pipeline.BLOCKERS, "x", "blocker")
    with pytest.raises(ValueError):
        pipeline.wanted_sets("1,9", 5)
    assert pipeline.wanted_sets("1, 4", 5) == [1, 4]


def test_spread_rank_counts_each_group_in_full(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).withColumn("g", F.when(F.col("id") < 450, "hot"))
    got = spread_rank(df, ["g"], F.xxhash64("id"), F.col("id"), "n", slices=8).collect()
    assert len(got) == 500
    for g, size in (("hot", 450), (None, 50)):
        rows = sorted((r for r in got if r["g"] == g), key=lambda r: r["n"])
        assert [r["n"] for r in rows] == list(range(1, size + 1))


def test_training_run_and_stream(spark, tmp_path):
    rows = lambda p, ks: [(f"{p}-{k}", f"Firm {chr(97 + k % 26) * 3} {k} Tools", f"{k} Elm Street, Town{k}", "US") for k in ks]
    frame = lambda r: spark.createDataFrame(r, "entity_id string, business_name string, business_address string, country string")
    truth = lambda ks: spark.createDataFrame([(f"S1-{k}", [f"S2-{k}"]) for k in ks], "s1_id string, ids array<string>")
    a, b = range(30), range(30, 60)
    side = lambda ks: (frame(rows("S1", ks)), frame(rows("S2", ks)), truth(ks))
    from kinweave.operators.matching import Matcher

    out = pipeline.train(side(a), side(b), Matcher(rounds=3, depth=2))
    assert out["recall"] > 0.8 and out["f0_5"] > 0.5
    with pytest.raises(ValueError):
        pipeline.train(side(a), side(a))
    s1, t = pipeline.prepare(frame(rows("S1", range(5))), frame(rows("S2", range(5))))
    s1.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s1.schema).parquet(str(tmp_path / "in"))
    q = block_stream(stream, pipeline.BLOCKERS["trigrams"](max_df=1.0).fit(t), str(tmp_path / "out"), str(tmp_path / "ck"), 1)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("rank = 0 and substring(s1_id, 4) = substring(cand_id, 4)").count() == 5


@pytest.mark.skipif(not DATA.exists(), reason="no data")
def test_registered_trees_are_those_of_the_operator(spark, monkeypatch):
    from kinweave.operators import matching

    made = []

    class Seen(matching.Matcher):
        def fit(self, labeled):
            made.append(self.params)
            self.params = {**self.params, "maxIter": 1, "maxDepth": 1}  # what counts is how it was set up
            return super().fit(labeled)

    monkeypatch.setattr(matching, "Matcher", Seen)
    __spark_entry__.queries()["gbt_match_proba"](spark, str(DATA))
    monkeypatch.undo()
    assert made == [matching.Matcher().params]


def test_commands_from_files_to_a_valid_result(spark, tmp_path, capsys):
    header = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    line = lambda p, k: f"{p}-{k:03}\tFirm {chr(97 + k % 26) * 3} {chr(97 + k * 7 % 26) * 4} Tools\t{k} {chr(97 + k * 5 % 26) * 5} Street, Town{k}\tUS\n"
    train, test, sets, out, model = (str(tmp_path / x) for x in ("train", "test", "sets", "out", "model"))
    for folder, prefix, ks in ((train, "train", range(80)), (test, "test", range(80, 100))):
        pathlib.Path(folder).mkdir()
        for i in (1, 2, 3):
            pathlib.Path(folder, f"{prefix}_source{i}.tsv").write_text(header + "".join(line(f"S{i}", k) for k in ks if i != 3 or k % 2))
    pathlib.Path(train, "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{k:03}\t{'' if k % 9 == 0 else f'S2-{k:03}'}\n" for k in range(80)))
    common = ["--train", train, "--sets-dir", sets, "--n-sets", "3"]
    assert pipeline.main(["block", *common, "--sets", "0,1"]) == 0 and "recall" in capsys.readouterr().out
    assert pipeline.main(["split", *common]) == 0 and "source ground_truth" in capsys.readouterr().out
    from kinweave.sources import tables

    parts = [tables.load_sets(spark, sets, [k]) for k in range(3)]
    assert sum(p[0].count() for p in parts) == 80 and sum(p[2].count() for p in parts) == 80 and tables.load_sets(spark, sets)[1].count() == 120
    for s1, targets, truth in parts:  # matches follow their owners
        assert truth.selectExpr("explode(ids) as entity_id").join(targets, "entity_id", "left_anti").count() == 0
    from kinweave.operators import matching

    default = matching.Matcher.__init__.__defaults__
    matching.Matcher.__init__.__defaults__ = (2, 2, *default[2:])
    try:
        assert pipeline.main(["train", *common, "--train-sets", "0,1", "--val-set", "2", "--model", model, "--out", out]) == 0
    finally:
        matching.Matcher.__init__.__defaults__ = default
    assert "f0_5" in capsys.readouterr().out
    assert pipeline.main(["analyze", *common, "--sets", "2", "--model", model, "--threshold", "0.5"]) == 0 and "== ceiling" in capsys.readouterr().out
    assert pipeline.main(["predict", "--model", model, "--test", test, "--out", out, "--threshold", "0.5"]) == 0
    assert pipeline.main(["validate", "--results", out, "--test", test, "--check-ids"]) == 0, capsys.readouterr().out
    from kinweave.sources import sinks

    sinks.merged(spark, f"{out}/matching_results.tsv", str(tmp_path / "one.tsv"))
    lines = (tmp_path / "one.tsv").read_text().splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and [x.split("\t")[0] for x in lines[1:]] == [f"S1-{k:03}" for k in range(80, 100)]
    pathlib.Path(test, "test_source1.tsv").write_text(header + line("S1", 80) + line("S1", 500))
    assert pipeline.main(["validate", "--results", out, "--test", test]) == 1 and "missing_rows: 1" in capsys.readouterr().out
