"""Writers: id lists and split tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import split
from . import tables


def id_list_table(pairs: DataFrame, spine: DataFrame, out_col: str, order: str | None = None) -> DataFrame:
    """``source1_entity_id, out_col`` with one row for each id of ``spine``, '' where it has no pair.

    Repeated pairs count once; ids stand in the order of ``order``, then of the id; pairs outside the spine are left out.
    """
    first = pairs.groupBy("s1_id", "cand_id").agg(F.min(F.col(order) if order else F.lit(0)).alias("o"))
    joined = first.groupBy("s1_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "cand_id"))), lambda x: x["cand_id"]), ",").alias(out_col))
    return spine.select("s1_id").join(joined, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(out_col, F.lit("")).alias(out_col))


def write_id_lists(table: DataFrame, path: str) -> None:
    """A folder of tab-separated files in the order of the ids, each with a header; an empty list is nothing, not a pair of quotes.

    The files are written by many tasks; ``merged`` makes one of them.
    """
    table.orderBy("source1_entity_id").write.mode("overwrite").options(header=True, sep="\t", quote="", emptyValue="").csv(path)


def write_matches(pairs: DataFrame, spine: DataFrame, path: str) -> None:
    write_id_lists(id_list_table(pairs, spine, "matched_entity_ids"), path)


def write_candidates(pairs: DataFrame, spine: DataFrame, path: str) -> None:
    write_id_lists(id_list_table(pairs, spine, "candidate_entity_ids", "rank"), path)


def write_split(df: DataFrame, path: str) -> None:
    """One folder for each set."""
    df.write.mode("overwrite").partitionBy("set_id").options(header=True, sep="\t", quote="", emptyValue="").csv(path)


def merged(spark: SparkSession, folder: str, path: str) -> None:
    """One file from a folder of files with headers, copied as a stream through the driver, with the header once."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(conf)
    parts = sorted(str(s.getPath()) for s in fs.listStatus(where) if s.getPath().getName().startswith("part-"))
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    for i, part in enumerate(parts):
        source = fs.open(jvm.org.apache.hadoop.fs.Path(part))
        while i and source.read() not in (10, -1):
            pass
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
        source.close()
    out.close()


def write_sets(spark: SparkSession, train: str, out: str, n_sets: int) -> DataFrame:
    """The three sources and the true lists of a folder, each written by set; gives ``set_id, source, n``, 0 where a set is empty."""
    truth = tables.read_id_lists(spark, f"{train}/train_ground_truth.tsv")
    sources = {f"source{i}": split.assigned(tables.read_tsv(spark, f"{train}/train_source{i}.tsv"), truth, n_sets) for i in (1, 2, 3)}
    lists = truth.select(F.col("s1_id").alias("source1_entity_id"), F.array_join("ids", ",").alias("matched_entity_ids"), split.set_of(F.col("s1_id"), n_sets).alias("set_id"))
    every = {**sources, "ground_truth": lists}
    for name, df in every.items():
        write_split(df, f"{out}/{name}")
        for k in range(n_sets):  # a folder for an empty set too
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}/set_id={k}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    found = None
    for name, df in every.items():
        part = df.select("set_id", F.lit(name).alias("source"))
        found = part if found is None else found.union(part)
    return split.counts(spark, found, n_sets)


def ensure_sets(spark: SparkSession, train: str, out: str, sets: list[int], n_sets: int) -> DataFrame | None:
    """Write all sets where one of those wanted is missing; gives the counts if it wrote any."""
    there = all(tables.exists(spark, f"{out}/{name}/set_id={k}") for name in ("source1", "source2", "source3", "ground_truth") for k in sets)
    return None if there else write_sets(spark, train, out, n_sets)
