"""Connected components: local forests first, then distributed rounds over what they leave."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .pairs import SHARE


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of one partition; each node comes out tied to the smallest node of its tree."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while (p := parent[root]) != root:
            root = p
        while (p := parent[x]) != root:
            parent[x], x = root, p
        return root

    for b in batches:
        for u, v in zip(b["u"], b["v"]):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, c = find(u), find(v)
            if a != c:
                if c < a:
                    a, c = c, a
                parent[c] = a
    nodes = list(parent)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pd.DataFrame({"u": part, "v": [find(x) for x in part]}).query("u != v")


def local_forests(edges: DataFrame) -> DataFrame:
    """Replace each partition's edges by a star for each of its trees: at most one edge for each node, none lost."""
    return edges.mapInPandas(_forest, "u string, v string")


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", max_rounds: int = 50) -> DataFrame:
    """``node, component`` for every node of the edges; the component is named by its smallest node (as strings).

    Level by level, forests of parts are merged: first inside each input partition, then among the parts that share a hash
    of a node, each time keeping one edge for each node of a part. The last levels of a pure hierarchy would put all trees
    into one task, so they run as rounds over a distributed table instead: each node hooks the larger of its neighbours to
    the smallest one, then the smaller ones. The neighbours of a hub are dealt into shares, so no task gathers them. Rounds end when nothing changes. No task holds more than a hash part of the
    nodes, and no edges reach the driver. Edges with a null end are left out; an edge from a node to itself
    keeps the node as a component of its own; repeated edges count once. An empty table gives an empty result.
    """
    raw = edges.select(F.col(left).cast("string").alias("u"), F.col(right).cast("string").alias("v")).where("u is not null and v is not null")
    raw = cut(raw)
    nodes = raw.select("u").union(raw.select("v")).distinct().withColumnRenamed("u", "node")
    e = local_forests(raw.where("u <> v"))
    e = cut(local_forests(e.repartition("v")).distinct())
    seen = _signature(e)
    if seen[0]:
        for _ in range(max_rounds):
            low = e.groupBy("u").agg(F.min("v").alias("m"))  # combined before the shuffle
            # the larger neighbours of a node go to its smallest one; a node without a smaller one keeps them
            hot = e.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARE).select("v", F.ceil(F.col("n") / F.lit(SHARE)).cast("int").alias("shares"))
            dealt = e.join(hot, "v", "left").withColumn("s", F.coalesce(F.pmod(F.xxhash64("u"), F.col("shares")).cast("int"), F.lit(0))).select("u", "v", "s")
            lows = low.withColumnRenamed("u", "v").join(hot, "v", "left").select("v", "m", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("s"))
            down = dealt.join(lows, ["v", "s"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
            low = down.groupBy("u").agg(F.min("v").alias("m"))
            pulled = down.join(low, "u")
            e = cut(pulled.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
            now = _signature(e)
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError("components did not settle")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
