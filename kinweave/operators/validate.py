"""Checks of result files: every rule gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import exists, match_targets, read_ids

HEADERS = {"matches": ("source1_entity_id", "matched_entity_ids"), "candidates": ("source1_entity_id", "candidate_entity_ids")}
EXAMPLES = 5


def rows_of(table: DataFrame, key: str, lists: str) -> DataFrame:
    """``s1_id, ids``: ids as written, '' among them where a comma is stray; an empty list has none."""
    text = F.coalesce(F.col(lists), F.lit(""))
    return table.select(F.trim(key).alias("s1_id"), F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(text, ",", -1), lambda x: F.trim(x))).alias("ids"))


def each_id(rows: DataFrame) -> DataFrame:
    return rows.select("s1_id", F.explode("ids").alias("id"))


def duplicate_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s1_id")


def repeated_ids(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("ids") != F.size(F.array_distinct("ids"))).select("s1_id").distinct()


def own_ids(rows: DataFrame) -> DataFrame:
    return each_id(rows).where(F.col("id").startswith("S1-")).select("s1_id").distinct()


def bad_ids(rows: DataFrame) -> DataFrame:
    i = F.col("id")
    return each_id(rows).where(~(i.startswith("S1-") | i.startswith("S2-") | i.startswith("S3-"))).select("s1_id").distinct()


def unknown_ids(rows: DataFrame, known: DataFrame) -> DataFrame:
    ids = each_id(rows).where(F.col("id").startswith("S2-") | F.col("id").startswith("S3-"))
    return ids.join(known.select("id"), "id", "left_anti").select("s1_id").distinct()


def missing_rows(rows: DataFrame, required: DataFrame) -> DataFrame:
    return required.select("s1_id").distinct().join(rows.select("s1_id"), "s1_id", "left_anti")


def extra_rows(rows: DataFrame, required: DataFrame) -> DataFrame:
    return rows.select("s1_id").distinct().join(required.select("s1_id"), "s1_id", "left_anti")


def not_among_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    return each_id(matches).join(each_id(candidates), ["s1_id", "id"], "left_anti").select("s1_id").distinct()


def summary(rows: DataFrame) -> DataFrame:
    """``n_rows, n_empty, n_filled``."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("ids") == 0).alias("n_empty"), F.count_if(F.size("ids") > 0).alias("n_filled"))


def findings(rows: DataFrame, required: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """``rule, severity, n, examples``: how many records break each rule, with the first few of them."""
    rules = {
        "duplicate_rows": ("error", duplicate_rows(rows)), "repeated_ids": ("error", repeated_ids(rows)), "own_ids": ("error", own_ids(rows)), "bad_ids": ("error", bad_ids(rows)),
        "missing_rows": ("error", missing_rows(rows, required)), "extra_rows": ("error", extra_rows(rows, required)),
    }
    if known is not None:
        rules["unknown_ids"] = ("error", unknown_ids(rows, known))
    if candidates is not None:
        rules["not_among_candidates"] = ("warning", not_among_candidates(rows, candidates))
    out = None
    for rule, (severity, broken) in rules.items():
        # ranked before it is gathered, so only the examples are
        first = broken.orderBy("s1_id").limit(EXAMPLES).agg(F.array_join(F.array_sort(F.collect_list("s1_id")), ",").alias("examples"))
        part = broken.agg(F.count(F.lit(1)).alias("n")).crossJoin(first).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "examples")
        out = part if out is None else out.union(part)
    return out


def check_file(spark: SparkSession, path: str, kind: str) -> list[str]:
    """What stops a file, or a folder of files, from being read at all: missing, empty, not UTF-8, no tabs, or another header.

    Bytes that are not UTF-8 are told by the sign that stands for them after reading, so that sign itself is not allowed.
    """
    if not exists(spark, path):
        return [f"{path} is missing"]
    lines = spark.read.text(path)
    first = lines.first()
    if first is None or not first["value"].strip():
        return [f"{path} is empty"]
    if lines.where(F.col("value").contains("\ufffd")).limit(1).count():
        return [f"{path} can't be read as UTF-8"]
    header = first["value"]
    if "\t" not in header and "," in header:
        return [f"{path} seems to be parted by commas; tabs are wanted"]
    if tuple(x.strip().lower() for x in header.split("\t")) != HEADERS[kind]:
        return [f"{path} should have the header {' '.join(HEADERS[kind])}"]
    return []


def untabbed_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").contains("\t") & (F.trim("value") != ""))


def read_result(spark: SparkSession, path: str, kind: str) -> DataFrame:
    key, lists = HEADERS[kind]
    table = spark.read.option("sep", "\t").option("quote", "").schema(f"`{key}` string, `{lists}` string").option("header", True).csv(path)
    return rows_of(table.where(F.col(key).isNotNull()), key, lists)


def validate_folder(spark: SparkSession, folder: str, test_folder: str, check_ids: bool = False) -> tuple[list[str], list[str]]:
    """Errors and warnings about the result files of a folder."""
    source = f"{test_folder}/test_source1.tsv"
    if not exists(spark, source):
        return [f"{source} is missing"], []
    required = read_ids(spark, source).select(F.col("id").alias("s1_id"))
    errors, warnings, tables = [], [], {}
    known = None
    if check_ids:
        known, said = match_targets(spark, test_folder)
        warnings += said
    else:
        warnings.append("ids are not checked against the targets")
    for kind, name in (("matches", "matching_results.tsv"), ("candidates", "candidate_pairs.tsv")):
        path = f"{folder}/{name}"
        if kind == "candidates" and not exists(spark, path):
            warnings.append(f"{path} is missing")
            continue
        stop = check_file(spark, path, kind)
        if stop:
            errors += stop
            continue
        n = untabbed_lines(spark, path).count()
        if n:
            errors.append(f"{path}: {n} lines without a tab")
        tables[kind] = read_result(spark, path, kind)
    for kind, rows in tables.items():
        for r in findings(rows, required, known, tables.get("candidates") if kind == "matches" else None).where("n > 0").collect():
            (errors if r["severity"] == "error" else warnings).append(f"{kind}: {r['rule']}: {r['n']}, e.g. {r['examples']}")
    return errors, warnings
