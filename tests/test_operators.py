import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kinweave.operators import errors, evaluate, features, matching, split, validate
from kinweave.operators.blocking import TrigramBlocker
from kinweave.sources import sinks, tables

REC = "entity_id string, name_norm string, address_norm string, country string, legal_form string"
TARGETS = [("S2-1", "acme widgets", "12 elm street", "US", ""), ("S2-2", "acme widgts", "12 elm street", "US", ""), ("S2-3", "widgets acme", "12 elm street", "US", ""), ("S2-4", "zebra foods", "9 oak road", "US", ""), ("S2-5", "acme widgets", "12 elm street", "France", "")]


@pytest.fixture(scope="module")
def blocked(spark):
    s1 = spark.createDataFrame([("S1-1", "acme widgets", "12 elm street", "US", ""), ("S1-2", "qqq", "", "Peru", ""), ("S1-3", "", "", "US", "")], REC)
    return TrigramBlocker(max_df=1.0).fit(spark.createDataFrame(TARGETS, REC)).query(s1, 10).orderBy("s1_id", "rank").collect()


def test_blocker(blocked):
    assert [r["cand_id"] for r in blocked][0] == "S2-1" and blocked[0]["score"] == pytest.approx(1)
    assert {r["cand_id"] for r in blocked} <= {"S2-1", "S2-2", "S2-3", "S2-4"} and {r["s1_id"] for r in blocked} == {"S1-1"}
    assert [r["rank"] for r in blocked] == list(range(len(blocked))) and all(0 < r["score"] <= 1 + 1e-9 for r in blocked)


def test_blocker_without_targets_or_rare_grams(spark):
    s1 = spark.createDataFrame([("S1-1", "acme", "", "US", "")], REC)
    assert TrigramBlocker().fit(spark.createDataFrame([], REC)).query(s1, 5).count() == 0
    assert TrigramBlocker(max_df=0.05).fit(spark.createDataFrame(TARGETS[:1], REC)).query(s1, 5).columns == ["s1_id", "cand_id", "score", "rank"]


def test_scores(spark):
    truth = spark.createDataFrame([("a", ["1", "2"]), ("b", []), ("c", ["3"]), ("d", [])], "s1_id string, ids array<string>")
    pairs = spark.createDataFrame([("a", "1"), ("a", "9"), ("d", "3"), ("z", "7")], "s1_id string, cand_id string")
    got = {r["s1_id"]: r for r in evaluate.entity_scores(truth, pairs).collect()}
    assert got["a"]["f0_5"] == pytest.approx(0.5) and got["b"]["f0_5"] == 1 and got["c"]["f0_5"] == 0 and got["d"]["f0_5"] == 0
    assert (got["a"]["false_pos"], got["a"]["false_neg"]) == (1, 1)
    assert evaluate.macro_score(truth, pairs).first()[0] == pytest.approx(0.375)
    assert evaluate.macro_score(truth.where("false"), pairs).first()[0] is None
    cands = pairs.withColumn("rank", F.when(F.col("cand_id") == "9", 0).otherwise(1))
    assert {r["k"]: r["recall"] for r in evaluate.recall_at(truth, cands, (1, 2)).collect()} == {1: 0.0, 2: pytest.approx(1 / 3)}
    assert evaluate.recall_at(truth.where("size(ids) = 0"), cands, (1,)).first()["recall"] == 1
    assert {r["case"]: r["n"] for r in errors.wrong_cases(truth, pairs).collect()} == {"unclaimed": 1, "stolen": 1}
    assert tuple(errors.ceiling(truth, pairs).first()) == (2, 1, 1)
    assert evaluate.alarms(0.5, 0.3, 0.29) and not evaluate.alarms(0.9, 0.9, 0.3)


def test_decisions(spark):
    scored = spark.createDataFrame([("a", "1", 0.9), ("a", "2", 0.85), ("a", "3", 0.5), ("b", "1", 0.95), ("b", "3", 0.5), ("c", "4", 0.2)], "s1_id string, cand_id string, match_proba double")
    run = lambda *a: {(r["s1_id"], r["cand_id"]) for r in matching.decide(scored, *a).collect()}
    assert run(0.5) == {("b", "1"), ("a", "2"), ("a", "3")}
    assert run(0.5, 0.1) == {("b", "1"), ("a", "2")}  # its best is lost to another record, what was near it stays
    truth = spark.createDataFrame([("a", ["2"]), ("b", ["1"]), ("c", [])], "s1_id string, ids array<string>")
    for margin in (None, 0.1):
        curve = {r["threshold"]: r["f0_5"] for r in matching.threshold_scores(scored, truth, matching.GRID, margin).collect()}
        for t in (0.05, 0.2, 0.5, 0.9, 0.95):
            assert curve[t] == pytest.approx(evaluate.macro_score(truth, matching.decide(scored, t, margin)).first()[0])
    assert matching.tune_threshold(scored, truth).first()["threshold"] == 0.55
    assert matching.decide(scored.where("false"), 0.5).count() == 0


def test_features_and_matcher(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-1", "acme tools", "12/3 elm street, boston", "US", "ltd"), ("S1-2", "", "", "US", "")], REC)
    t = spark.createDataFrame([("S2-1", "acme tools co", "12 elm street, boston", "US", "ltd"), ("S2-2", "", "", "US", "")], REC)
    pairs = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-1", "S2-2", 0.1), ("S1-2", "S2-2", 0.5), ("S1-2", "S2-9", 0.7)], "s1_id string, cand_id string, score double")
    f = {(r["s1_id"], r["cand_id"]): r for r in features.pair_features(pairs, s1, t).collect()}
    x = f["S1-1", "S2-1"]
    assert len(f) == 3 and x["name_jaccard"] == pytest.approx(2 / 3) and x["name_token_set"] == 1 and x["num_jaccard"] == 0.5 and x["num_overlap"] == 1 and x["legal_agree"] == 1
    assert f["S1-2", "S2-2"]["name_jaccard"] == 0 and f["S1-2", "S2-2"]["s1_addr_empty"] == 1 and f["S1-1", "S2-2"]["score_gap"] == pytest.approx(-0.8)
    rows = [(str(i), str(i), *([float(i % 2)] * len(features.COLUMNS)), i % 2) for i in range(40)]
    labeled = spark.createDataFrame(rows, ["s1_id", "cand_id", *features.COLUMNS, "label"])
    with pytest.raises(ValueError):
        matching.Matcher().predict(labeled)
    m = matching.Matcher(rounds=3, depth=2).fit(labeled)
    m.save(str(tmp_path / "m"))
    for r in matching.Matcher.load(str(tmp_path / "m")).predict(labeled).collect():
        assert (r["match_proba"] > 0.5) == bool(r["label"])
    assert sum(v for _, v in m.importance()) == pytest.approx(1)


def test_trees_in_one_stage_are_those_of_spark(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from kinweave.operators import boosting

    value = [F.round(F.rand(i) * 20) / 20 for i in range(len(features.COLUMNS))]
    rows = spark.range(600).select(F.col("id").cast("string").alias("s1_id"), F.lit("x").alias("cand_id"), *(v.alias(c) for v, c in zip(value, features.COLUMNS)))
    # shallow, as splits of few rows tie between columns
    labeled = rows.withColumn("label", (F.col("score") * F.col("name_jaccard") + F.col("num_jaccard") / 4 + F.rand(99) / 5 > 0.5).cast("int")).localCheckpoint()
    n = labeled.where("label = 1").count()
    vectors = VectorAssembler(inputCols=list(features.COLUMNS), outputCol="v").transform(labeled).withColumn("w", F.when(F.col("label") == 1, (600 - n) / n).otherwise(1.0))
    model = GBTClassifier(featuresCol="v", labelCol="label", weightCol="w", maxIter=12, maxDepth=2, stepSize=0.3).fit(vectors)
    want = model.transform(vectors).withColumn("p", vector_to_array("probability")[1]).drop("v", "w", "probability", "rawPrediction", "prediction").localCheckpoint()
    for part in (600, 150):  # one task, then four that wait for one another
        monkeypatch.setattr(boosting, "PART", part)
        spark.sparkContext.setJobGroup(f"trees{part}", "")
        m = matching.Matcher(rounds=12, depth=2, step=0.3, share=1.0).fit(labeled)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees{part}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert jobs < 12  # not one for each level of each tree
        assert m.predict(want).agg(F.max(F.abs(F.col("p") - F.col("match_proba")))).first()[0] < 1e-9
    deep = matching.Matcher(rounds=2, depth=8, step=0.3, weight=1.0).fit(labeled)
    assert max(map(len, (t.column for t in deep.model.trees))) > 1 and deep.predict(labeled).where("(match_proba > 0.5) = (label = 1)").count() > 500
    with pytest.raises(ValueError):
        matching.Matcher(rounds=1).fit(labeled.limit(0))


def test_split(spark):
    truth = spark.createDataFrame([("S1-1", ["S2-1", "S3-1"]), ("S1-2", [])], "s1_id string, ids array<string>")
    ids = spark.createDataFrame([("S1-1", "s1"), ("S1-2", "s1"), ("S2-1", "s2"), ("S3-1", "s3"), ("S2-é", "s2")], "entity_id string, source string")
    got = {r["entity_id"]: r["set_id"] for r in split.assigned(ids, truth, 7).collect()}
    assert got["S1-1"] == got["S2-1"] == got["S3-1"] == zlib.crc32(b"S1-1") % 7 and got["S2-é"] == zlib.crc32("S2-é".encode()) % 7
    n = split.counts(spark, split.assigned(ids, truth, 7), 7)
    assert n.count() == 21 and n.agg(F.sum("n")).first()[0] == 5


def test_files(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"x\tNA\t\nS1-2\tnull\t\tUS\n', encoding="utf-8")
    got = {r[0]: tuple(r) for r in tables.read_tsv(spark, str(p)).collect()}
    assert got == {"S1-1": ("S1-1", '"x', "NA", ""), "S1-2": ("S1-2", "null", "", "US")}
    assert tables.read_tsv(spark, [str(p), str(p)], nrows=1).count() == 2
    pairs = spark.createDataFrame([("S1-1", "S2-2", 1), ("S1-1", "S2-1", 0), ("S1-1", "S2-1", 5), ("S1-9", "S2-1", 0)], "s1_id string, cand_id string, rank int")
    spine = spark.createDataFrame([("S1-1",), ("S1-3",)], "s1_id string")
    sinks.write_candidates(pairs, spine, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1,S2-2\nS1-3\t\n"
    lists = tables.read_id_lists(spark, str(tmp_path / "out"))
    assert {r["s1_id"]: r["ids"] for r in lists.collect()} == {"S1-1": ["S2-1", "S2-2"], "S1-3": []}
    (tmp_path / ".env.example").write_text("# c\nA = 1\nB=2=3\n\n")
    assert tables.load_config(str(tmp_path / ".env"), {"A": "9", "C": "8"}) == {"A": "9", "B": "2=3"}
    sinks.write_split(tables.read_tsv(spark, str(p)).withColumn("set_id", F.lit(1)), str(tmp_path / "sets"))
    assert tables.read_split(spark, str(tmp_path / "sets"), [1]).count() == 2 and tables.read_split(spark, str(tmp_path / "sets"), [0]).count() == 0


def test_validator(spark, tmp_path):
    for n, text in (("test_source1", "entity_id\nS1-1\nS1-2\n"), ("test_source2", "entity_id\nS2-1\n"), ("test_source3", "entity_id\nS3-1\n")):
        (tmp_path / f"{n}.tsv").write_text(text)
    out = tmp_path / "out"
    out.mkdir()
    (out / "matching_results.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1,S1-5,,S2-8\nS1-1\t\nS1-7\tS3-1\nbroken line\n")
    (out / "candidate_pairs.tsv").write_text("Source1_Entity_Id\tcandidate_entity_ids\nS1-1\tS2-1\nS1-2\t\n")
    found, warned = validate.validate_folder(spark, str(out), str(tmp_path), check_ids=True)
    said = " ".join(found)
    assert all(x in said for x in ("duplicate_rows", "repeated_ids", "own_ids", "bad_ids", "missing_rows", "extra_rows", "unknown_ids", "without a tab")) and any("not_among" in w for w in warned)
    (out / "matching_results.tsv").write_text("a,b\n")
    assert "commas" in validate.validate_folder(spark, str(out), str(tmp_path))[0][0]
    assert validate.check_file(spark, str(tmp_path / "none"), "matches")


def test_blocks_of_targets_are_stored_once(spark):
    from kinweave.operators import blocking

    rng = random.Random(5)
    words = ["acme", "zebra", "elm", "oak", "foods", "tools", "widget", "north", "river", "stone"]
    rows = lambda side, n: [(f"{side}-{i}", " ".join(rng.sample(words, 3)), rng.choice(words), rng.choice(("US", "US", "France", "")), "") for i in range(n)]
    targets, records = spark.createDataFrame(rows("S2", 60), REC), spark.createDataFrame(rows("S1", 40), REC)
    get = lambda b: {(r["s1_id"], r["cand_id"], round(r["score"], 6), r["rank"]) for r in b.query(records, 3).collect()}
    whole, dealt = TrigramBlocker(max_df=1.0).fit(targets), TrigramBlocker(max_df=1.0, target_block=5, query_block=7).fit(targets)
    found = get(dealt)
    assert found == get(whole) and len({f[0] for f in found}) == 40
    ids = [i for country in ("US", "France", "") for b in blocking._stored(dealt.folder, country) for i in b["ids"].to_pylist()]
    assert sorted(ids) == sorted(r["entity_id"] for r in targets.collect())
    assert "CoGroup" not in dealt.query(records, 3)._jdf.queryExecution().toString()  # no copies for the cells of records by targets


def test_recall_shuffles_no_pairs(spark):
    truth = spark.createDataFrame([("a", ["1", "2", "2"]), ("a", ["1"]), ("b", []), ("c", None)], "s1_id string, ids array<string>")
    cands = spark.createDataFrame([("a", "1", 3), ("a", "1", 0), ("a", "2", 1), ("a", "9", 0), ("c", "1", 0)], "s1_id string, cand_id string, rank int")
    assert {r["k"]: r["recall"] for r in evaluate.recall_at(truth, cands, (1, 2)).collect()} == {1: 0.5, 2: 1.0}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = evaluate.recall_at(truth, cands, (1, 2))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(s1_id" in plan and not re.search(r"hashpartitioning\(s1_id#\d+, cand_id", plan)


def test_prepared_records_have_only_the_columns_that_are_wanted(spark):
    from kinweave.plans import pipeline

    raw = spark.createDataFrame([("S1-1", "Acme Inc", "12 Elm St", "US")], "entity_id string, business_name string, business_address string, country string")
    wanted = ("entity_id", "country", "name_norm", "address_norm")
    a, b = pipeline.prepare(raw, raw, columns=wanted)
    assert a.columns == b.columns == list(wanted) and a.count() == b.count() == 1
    assert {"legal_form", "business_name"} < set(pipeline.prepare(raw, raw)[0].columns)


def test_common_grams_are_no_single_products():
    """Grams that half of the targets have cost less than their products one by one, and give the same scores."""
    import time

    import numpy as np
    import pyarrow as pa

    from kinweave.operators import blocking

    rng = np.random.default_rng(5)

    def side(n, letter):
        has = np.concatenate([rng.random((n, 60)) < 0.5, rng.random((n, 400)) < 0.01], axis=1)
        tf, idf = rng.integers(1, 4, has.shape), np.linspace(1, 9, 460)
        w = has * (1 + np.log(tf)) * idf
        norm = np.sqrt((w * w).sum(1))
        grams = [np.flatnonzero(h) for h in has]
        columns = {"country": pa.array(["US"] * n), "entity_id": pa.array([f"{letter}{i:05}" for i in range(n)]), "grams": pa.array(grams), "tfs": pa.array([t[g] for t, g in zip(tf, grams)]), "idfs": pa.array([idf[g] for g in grams]), "norm": pa.array(norm)}
        return pa.table(columns), w / norm[:, None]

    (queries, x), (targets, y) = side(600, "q"), side(12_000, "t")
    lists = blocking.posting_lists(targets)
    block = {"ids": lists.column("ids").combine_chunks().flatten(), **{k: np.frombuffer(lists.column(k)[0].as_buffer(), t) for k, t in blocking.LISTS.items()}}
    took = []
    for _ in range(2):
        began = time.perf_counter()
        got = blocking.best_of_blocks(queries, [block], 5).to_pylist()
        took.append(time.perf_counter() - began)
    scores = x @ y.T
    best = {(f"q{i:05}", f"t{j:05}"): scores[i, j] for i in range(600) for j in np.argsort(-scores[i])[:5]}
    assert {(r["s1_id"], r["cand_id"]) for r in got} >= set(best)
    assert all(r["score"] == pytest.approx(best[r["s1_id"], r["cand_id"]], abs=1e-12) for r in got if (r["s1_id"], r["cand_id"]) in best)
    products = int(((x > 0).sum(0) * (y > 0).sum(0)).sum())
    at, ones, sums = np.arange(1 << 20) % 12_000, np.ones(1 << 20), []
    for _ in range(3):
        began = time.perf_counter()
        np.bincount(at, weights=ones, minlength=12_000)
        sums.append(time.perf_counter() - began)
    assert min(took) < min(sums) / (1 << 20) * products  # less than their bare sum
