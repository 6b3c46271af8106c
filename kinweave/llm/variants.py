"""Variant spellings of names typed by people (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .components import connected_components
from .names import LEGAL, block_keys, name_key, name_of, name_words, parse_name, same_name, word_kind
from .pairs import meet, pairs_within

PARSED = "raw string, key string, trade string, blocks array<struct<block:string,whole:boolean>>"


TRADE_SHARE = 0.002  #: least share of the distinct names that a kind of business ends
TRADE_SPREAD = 0.5  #: least number of different words before it, in proportion to those names


def _endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for raw in b["raw"]:
            words = [w for w in name_words(raw) or () if w not in LEGAL]
            if len(words) > 1 and len(words[-1]) > 3:
                rows.append((words[-1], words[-2]))
        yield pd.DataFrame(rows, columns=["word", "before"])


def learned_trades(names: DataFrame) -> frozenset[str]:
    """Kinds of business that no list holds, told by where they stand: words that end many names, after ever other words.

    Every name has one ending, so at most one word for each ``TRADE_SHARE`` comes to the driver; names in rare endings keep them
    as words of the name. At least twenty names have to end in a word.
    """
    distinct = names.select("raw").where("raw is not null").distinct()
    ends = distinct.mapInPandas(_endings, "word string, before string")
    n = ends.groupBy("word", "before").agg(F.count(F.lit(1)).alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("spread"))
    total = distinct.agg(F.count(F.lit(1)).alias("total"))
    found = n.crossJoin(F.broadcast(total)).where((F.col("n") >= F.greatest(F.lit(20), F.col("total") * TRADE_SHARE)) & (F.col("spread") >= F.col("n") * TRADE_SPREAD))  # one row
    return frozenset(r["word"] for r in found.select("word").collect() if word_kind(r["word"])[0] == "core")


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b[[same_name(name_of(x), name_of(y)) for x, y in zip(b["key_1"], b["key_2"])]]


def parsed_names(names: DataFrame) -> DataFrame:
    """``raw, key, trade, blocks`` for each distinct name; null, blank and placeholder names are left out."""
    trades = learned_trades(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for raw in b["raw"]:
                n = parse_name(raw, trades)
                if n is not None:
                    rows.append((raw, name_key(n), " ".join(n.trade), [{"block": k, "whole": w} for k, w in block_keys(n)]))
            yield pd.DataFrame(rows, columns=["raw", "key", "trade", "blocks"])

    return names.select(F.col("raw")).where("raw is not null").distinct().mapInPandas(run, PARSED)


#: Kinds of business that a short form may stand for, as one. Fixed values.
FAMILIES = {"electric": "elect", "electricals": "elect", "electricite": "elect", "pharmacy": "pharm", "pharmaceuticals": "pharm", "pharmacie": "pharm"}


def accepted_pairs(keys: DataFrame) -> DataFrame:
    """``key_1, key_2`` of distinct parsed names that share a block and mean the same.

    Equal names have been joined into one key before, so copies make no pairs. Kinds of business that agree share a word or
    a family, so a block holds names of one kind; names without a kind meet all names of their block in a join of
    their own. Names in two words meet only names in one piece under the codes of their ends. A block with many names is dealt into shares.
    """
    spread = keys.select("key", "trade", F.explode("blocks").alias("b")).select("key", "trade", "b.block", "b.whole")
    family = F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv))
    kinds = F.array_distinct(F.transform(F.split("trade", " "), lambda t: F.coalesce(F.try_element_at(family, t), t)))
    firm = spread.where("trade <> ''").select("key", "block", "whole", F.explode(kinds).alias("kind"))
    left, right = (firm.select(F.col("key").alias(f"key_{i}"), "block", "kind", F.col("whole").alias(f"w{i}")) for i in (1, 2))
    met = "(substring(block, 1, 1) in ('w', 'o') or w1 or w2)"
    spot = lambda df: df.withColumn("spot", F.struct("block", "kind")).drop("kind")
    one = meet(spot(left), spot(right).drop("block"), "spot").where(f"key_1 < key_2 and {met}").select("key_1", "key_2")
    bare = spread.where("trade = ''").select(F.col("key").alias("a"), "block", F.col("whole").alias("w1"))
    every = spread.select(F.col("key").alias("b"), "block", F.col("whole").alias("w2"))
    two = meet(bare, every, "block").where(f"a <> b and {met}").select(F.least("a", "b").alias("key_1"), F.greatest("a", "b").alias("key_2"))
    return one.union(two).distinct().mapInPandas(_verify, "key_1 string, key_2 string")


def name_clusters(records: DataFrame) -> DataFrame:
    """``entity_id, raw, cluster`` for records with a name.

    Names that leave out the kind of business could tie different organisations together, so they don't take part in the
    components: each joins, among the clusters it was accepted with, the one with most names, the smallest among equals.
    """
    rows = records.select("entity_id", F.col("business_name").alias("raw")).where("entity_id is not null and raw is not null").distinct()
    parsed = cut(parsed_names(rows))
    keys = parsed.groupBy("key").agg(F.first("trade").alias("trade"), F.first("blocks").alias("blocks"))
    pairs = cut(accepted_pairs(keys))
    bare = lambda c: F.split(F.col(c), r"\|")[2] == ""
    firm = pairs.where(~bare("key_1") & ~bare("key_2"))
    whole = keys.where("trade <> ''").select(F.col("key").alias("u"), F.col("key").alias("v"))
    parts = cut(connected_components(firm.select(F.col("key_1").alias("u"), F.col("key_2").alias("v")).union(whole)))
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    loose = pairs.where(bare("key_1") & ~bare("key_2")).select(F.col("key_1").alias("key"), F.col("key_2").alias("node")).union(pairs.where(bare("key_2") & ~bare("key_1")).select(F.col("key_2").alias("key"), F.col("key_1").alias("node")))
    best = Window.partitionBy("key").orderBy(F.col("n").desc(), "component")
    joined = loose.join(parts, "node").select("key", "component").distinct().join(sizes, "component").withColumn("r", F.row_number().over(best)).where("r = 1").select("key", F.col("component").alias("cluster"))
    both_bare = pairs.where(bare("key_1") & bare("key_2")).select(F.col("key_1").alias("u"), F.col("key_2").alias("v"))
    rest = keys.where("trade = ''").select("key").join(joined, "key", "left_anti")
    rest_pairs = both_bare.join(rest.select(F.col("key").alias("u")), "u").join(rest.select(F.col("key").alias("v")), "v").select("u", "v")
    rest_parts = connected_components(rest_pairs.union(rest.select(F.col("key").alias("u"), F.col("key").alias("v")))).select(F.col("node").alias("key"), F.col("component").alias("cluster"))
    clusters = parts.select(F.col("node").alias("key"), F.col("component").alias("cluster")).union(joined).union(rest_parts)
    return rows.join(parsed.select("raw", "key"), "raw").join(clusters, "key").select("entity_id", "raw", "cluster")


def variant_pairs(records: DataFrame) -> DataFrame:
    """``entity_id_1, entity_id_2`` of records whose names are written differently but mean the same.

    Names without a usable word are in no pair; repeated records count once; extra columns are ignored; an empty table gives an empty result.
    """
    return pairs_within(name_clusters(records), ["cluster"]).select("entity_id_1", "entity_id_2")
