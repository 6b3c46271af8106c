"""Readers: record tables, id lists and configuration."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD = ("entity_id", "business_name", "business_address", "country")
RECORD_SCHEMA = StructType([StructField(c, StringType()) for c in RECORD])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_tsv(spark: SparkSession, paths: str | Iterable[str], schema: StructType = RECORD_SCHEMA, nrows: int | None = None) -> DataFrame:
    """Tab-separated files with a header, every column text, quotes ordinary characters, nothing missing: empty is ''.

    ``nrows`` keeps so many rows of each file, which need not be the first ones.
    """
    files = [paths] if isinstance(paths, str) else list(paths)
    read = lambda p: spark.read.schema(schema).options(header=True, sep="\t", quote="").csv(p)
    if nrows is None:
        return read(files).na.fill("")
    parts = [read(p).limit(nrows) for p in files]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.na.fill("")


def read_split(spark: SparkSession, path: str, sets: Iterable[int] | None = None) -> DataFrame:
    """A table written by set; only the folders of the wanted sets are read."""
    df = spark.read.schema(StructType([*RECORD_SCHEMA.fields])).options(header=True, sep="\t", quote="").csv(path)
    return (df if sets is None else df.where(F.col("set_id").isin(list(sets)))).na.fill("")


def records(df: DataFrame) -> DataFrame:
    """The four record columns without missing values; deliveries of the same record once."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in RECORD)).distinct()


def targets(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def parse_ids(text: F.Column | str) -> F.Column:
    """Ids of a comma-joined list, each once, without empty ones."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != ""))


def body_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, at`` of all lines but the first of each file, whatever it holds; ``at`` grows along each file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    first = lines.groupBy("file").agg(F.min("at").alias("at"))  # one row a file
    return lines.join(first, ["file", "at"], "left_anti").select("value", "at")


def read_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """``s1_id, ids`` of files of id lists: headers skipped, split at the first tab; the last line of an id wins."""
    parts = body_lines(spark, path).where("trim(value) <> ''").withColumn("p", F.split("value", "\t", 2))
    rows = parts.select(F.col("p")[0].alias("s1_id"), parse_ids(F.get("p", F.lit(1))).alias("ids"), "at")
    return rows.groupBy("s1_id").agg(F.max_by("ids", "at").alias("ids"))


def id_lists(df: DataFrame, key: str, lists: str, order: str | None = None) -> DataFrame:
    """``s1_id, ids`` from a table: of an id's rows the last by ``order`` (and then by its list), or without one all of them joined."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("s1_id"), parse_ids(lists).alias("ids"), *([F.struct(order, lists).alias("o")] if order else []))
    every = F.array_distinct(F.flatten(F.sort_array(F.collect_set("ids"))))
    return rows.groupBy("s1_id").agg((F.max_by("ids", "o") if order else every).alias("ids"))


def load_sets(spark: SparkSession, folder: str, sets: Iterable[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records of the first source, targets, and true lists of the wanted sets of a folder written by ``write_sets``."""
    s1, s2, s3 = (read_split(spark, f"{folder}/source{i}", sets).select(*RECORD) for i in (1, 2, 3))
    schema = StructType([StructField(c, StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
    truth = spark.read.schema(schema).options(header=True, sep="\t", quote="").csv(f"{folder}/ground_truth")
    truth = truth if sets is None else truth.where(F.col("set_id").isin(list(sets)))
    return s1, targets(s2, s3), id_lists(truth, "source1_entity_id", "matched_entity_ids")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct first columns of a file with a header, outer blanks taken off."""
    lines = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return lines.select(F.trim(F.col(f"`{lines.columns[0]}`")).alias("id")).where("id <> ''").distinct()


def match_targets(spark: SparkSession, folder: str) -> tuple[DataFrame | None, list[str]]:
    """Ids of both target files, or a warning and none if a file is missing."""
    paths = [f"{folder}/test_source{i}.tsv" for i in (2, 3)]
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        return None, [f"{p} is missing; ids are not checked against it" for p in missing]
    return read_ids(spark, paths[0]).union(read_ids(spark, paths[1])).distinct(), []


def config_there(path: str) -> bool:
    return Path(path).exists() or Path(path).with_name(".env.example").exists()


def load_config(path: str, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """``KEY=VALUE`` lines; an example file beside it stands in for a missing one; the environment overrides named keys."""
    environment = os.environ if environment is None else environment
    p = Path(path)
    if not p.exists():
        p = p.with_name(".env.example")
    found: dict[str, str] = {}
    for line in p.read_text(encoding="utf-8").splitlines():
        line = line.strip()
        if line and line[0] != "#" and "=" in line:
            key, value = line.split("=", 1)
            found[key.strip()] = environment.get(key.strip(), value.strip())
    return found
