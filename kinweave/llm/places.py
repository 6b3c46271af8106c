"""Same postal address written differently (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .addresses import loose_text, parse_address, place_key, place_of, same_place
from .pairs import meet, merged, pairs_within

COSINE = 0.25  #: least cosine of the weighted n-grams of two street names; the grams of a typo are rare and weigh most, so slips have keys of their own
LOOSE = 0.8  #: least cosine of whole addresses in which no number and street are found; their numbers have to be equal
CROWD = 300  #: addresses of one number and street, above which they meet by town and postcode instead of all with all
PARSED = "raw string, key string, number string, grams array<string>"


def street_grams(street: str) -> list[str]:
    """Two- and three-letter grams of a padded street name, each once."""
    t = f"^{street}$"
    return sorted({t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)})


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for raw in b["raw"]:
            p = parse_address(raw)
            if p is None:
                continue
            if p.number and p.street:
                rows.append((raw, place_key(p), p.number, street_grams(p.street)))
                continue
            numbers, words = loose_text(raw)
            if words:
                rows.append((raw, f"~{numbers}/{words}", numbers, sorted({g for w in words.split() for g in street_grams(w)})))
        yield pd.DataFrame(rows, columns=["raw", "key", "number", "grams"])


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b[[same_place(place_of(x), place_of(y)) for x, y in zip(b["key_1"], b["key_2"])]]


def parsed_addresses(addresses: DataFrame) -> DataFrame:
    """``raw, key, number, grams`` of each distinct address: grams of the street's name, or of all words where no number and street are found (the key then begins with ``~``)."""
    return addresses.select(F.col("raw")).where("raw is not null").distinct().mapInPandas(_parse, PARSED)


def prefix_candidates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``id_1, id_2`` of rows with the same ``number`` whose weighted n-grams have a cosine of at least ``cosine``.

    ``vectors`` has ``id, number, grams``. A gram weighs the logarithm of its rarity over all rows. Grams of a row are
    ordered from the rarest on; its prefix ends where the rest is shorter than the threshold, so two rows
    that reach it share a gram of both prefixes. Only prefixes are indexed, by number and gram. No candidate is
    capped; the cosine itself is taken from the whole vectors.
    """
    rows = vectors.select("id", "number", F.explode("grams").alias("gram"))
    total = vectors.agg(F.count(F.lit(1)).alias("total"))
    df = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # as many rows as there are grams of two or three letters
    weights = df.crossJoin(F.broadcast(total)).select("gram", (F.log(F.col("total") / F.col("df")) + 1).alias("w"))
    weighed = rows.join(F.broadcast(weights), "gram")
    norm = Window.partitionBy("id")
    unit = weighed.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(norm)))
    rare = Window.partitionBy("id").orderBy(F.col("w").desc(), "gram").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("w") * F.col("w")).over(rare), F.lit(0.0))
    unit = unit.withColumn("rest", F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - before)))
    vector = unit.groupBy("id", "number").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("v"), F.collect_list(F.when(F.col("rest") >= cosine, F.col("gram"))).alias("prefix"))
    vector = cut(vector)
    index = vector.select("id", "number", F.explode("prefix").alias("gram"))
    pairs = index.withColumnRenamed("id", "id_1").join(merged(index.withColumnRenamed("id", "id_2")), ["number", "gram"]).where("id_1 < id_2").select("id_1", "id_2").distinct()
    x = vector.select(F.col("id").alias("id_1"), F.col("v").alias("v1"))
    y = vector.select(F.col("id").alias("id_2"), F.col("v").alias("v2"))
    dot = F.aggregate(F.map_keys("v1"), F.lit(0.0), lambda a, g: a + F.coalesce(F.try_element_at("v1", g) * F.try_element_at("v2", g), F.lit(0.0)))
    return pairs.join(merged(x), "id_1").join(merged(y), "id_2").where(dot >= cosine - 1e-9).select("id_1", "id_2")


def street_slips(street: str) -> set[str]:
    """What is left of a street name without up to as many letters as ``spelt_alike`` allows edits; names it takes as alike share one."""
    left = now = {street}
    for _ in range(1 if len(street) < 6 else 2 if len(street) < 12 else 3):
        now = {w[:i] + w[i + 1 :] for w in now for i in range(len(w))}
        left = left | now
    return left


def _slips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"id": b["id"], "number": b["number"], "k": [list(street_slips(s)) for s in b["street"]]}).explode("k")


def slip_candidates(streets: DataFrame) -> DataFrame:
    """``id_1, id_2`` of rows of ``id, number, street`` with the same number whose streets share one of their slips."""
    index = streets.select("id", "number", "street").mapInPandas(_slips, "id string, number string, k string").select("id", F.xxhash64("number", "k").alias("k"))
    return index.withColumnRenamed("id", "id_1").join(merged(index.withColumnRenamed("id", "id_2")), "k").where("id_1 < id_2").select("id_1", "id_2").distinct()


def _town_slips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, key in zip(b["id"], b["key"]):
            p = place_of(key)
            words = {w for w in p.town.split()} | {p.town.replace(" ", "")}
            tokens = {"T" + s for w in words if w for s in street_slips(w)} | ({"P" + p.postcode} if p.postcode else set())
            kind = ("b" if p.postcode else "t") if p.town else "p" if p.postcode else "n"
            rows += [(i, key, kind, t) for t in tokens] or [(i, key, kind, None)]
        yield pd.DataFrame(rows, columns=["id", "key", "kind", "token"])


def crowd_pairs(near: DataFrame, keys: DataFrame) -> Iterator[DataFrame]:
    """``a, b``: pairs of addresses of ``near`` streets, for streets with any number of addresses, in parts that share no plan.

    Addresses that both name a town share a slip of one of its words, and those that both have a postcode but not both a town share that. Where
    one lacks the town and one, maybe the other, the postcode, nothing tells them apart, so all of these meet; they are one place.
    """
    spread = cut(keys.mapInPandas(_town_slips, "id string, key string, kind string, token string"))
    left = near.join(merged(spread.select(F.col("id").alias("id_1"), F.col("key").alias("a"), "token", F.col("kind").alias("ka"))), "id_1").withColumnRenamed("id_2", "id")
    right = spread.select("id", F.col("key").alias("b"), "token", F.col("kind").alias("kb"))
    spot = lambda df: df.withColumn("spot", F.xxhash64("id", "token")).drop("id", "token")
    yield meet(spot(left.where("token is not null").select("id", "a", "token")), spot(right.where("token is not null").select("id", "b", "token")), "spot").select("a", "b")
    once = lambda df, key, kind: df.select("id", key, kind).distinct()
    x, y = cut(once(left, "a", "ka")), cut(once(right, "b", "kb"))
    for p, q in (("ka = 'n'", "true"), ("ka <> 'n'", "kb = 'n'"), ("ka = 't'", "kb = 'p'"), ("ka = 'p'", "kb = 't'")):
        yield meet(x.where(p), y.where(q), "id").select("a", "b")


def verified(pairs: DataFrame) -> DataFrame:
    """``key_1, key_2`` of those pairs of addresses that mean the same place, each once."""
    each = pairs.where("a <> b").select(F.least("a", "b").alias("key_1"), F.greatest("a", "b").alias("key_2")).distinct()
    return cut(each.mapInPandas(_verify, "key_1 string, key_2 string"))


def matching_keys(parsed: DataFrame) -> DataFrame:
    """``key_1, key_2`` of different parsed addresses of one place."""
    loose = cut(parsed.where("startswith(key, '~')").groupBy(F.col("key").alias("id"), "number").agg(F.first("grams").alias("grams")))
    named = parsed.where("not startswith(key, '~')")
    streets = named.select("number", "grams", "key", F.split("key", "/")[2].alias("street")).withColumn("id", F.concat_ws("/", "number", "street"))
    distinct = streets.groupBy("id", "number", "street").agg(F.first("grams").alias("grams"), F.count_distinct("key").alias("n"))
    near = prefix_candidates(distinct.select("id", "number", "grams")).union(slip_candidates(distinct)).distinct()
    near = cut(near.union(distinct.select(F.col("id").alias("id_1"), F.col("id").alias("id_2"))))
    keys = streets.select("id", "key").distinct()
    crowded = merged(distinct.where(F.col("n") > CROWD).select("id"))
    busy = cut(near.join(crowded.withColumnRenamed("id", "id_1"), "id_1", "left_semi").union(near.join(crowded.withColumnRenamed("id", "id_2"), "id_2", "left_semi").select("id_1", "id_2")).distinct())
    quiet = near.join(merged(busy), ["id_1", "id_2"], "left_anti")
    all_pairs = quiet.join(merged(keys.select(F.col("id").alias("id_1"), F.col("key").alias("a"))), "id_1").join(merged(keys.select(F.col("id").alias("id_2"), F.col("key").alias("b"))), "id_2").select("a", "b")
    found = verified(all_pairs)
    if not busy.isEmpty():  # a plan for what is not there would only burden the driver, as would one plan for all parts
        ends = busy.select(F.col("id_1").alias("id")).union(busy.select("id_2")).distinct()
        for part in crowd_pairs(busy, keys.join(merged(ends), "id", "left_semi")):
            found = found.union(verified(part))
        found = cut(found.distinct())
    return found if loose.isEmpty() else found.union(cut(prefix_candidates(loose, LOOSE).select(F.col("id_1").alias("key_1"), F.col("id_2").alias("key_2"))))


def same_place_pairs(records: DataFrame) -> DataFrame:
    """``entity_id_1, entity_id_2`` of records whose addresses are written differently but mean the same place.

    Records without an address (null, blank, a placeholder) are in no pair. A part
    that one side leaves out does not tell places apart; a number, street, kind of street, town or unit that
    differs does. Addresses in which no number and street are found mean the same place if their numbers are equal and the weighted n-grams of
    all their words have a cosine of at least ``LOOSE``. Addresses that parse alike are joined first, so copies cost nothing. Repeated records count once; extra columns are
    ignored; an empty table gives an empty result.
    """
    rows = records.select("entity_id", F.col("business_address").alias("raw")).where("entity_id is not null and raw is not null").distinct()
    parsed = cut(parsed_addresses(rows))
    placed = cut(rows.join(merged(parsed.select("raw", "key")), "raw"))
    inside = pairs_within(placed.select("entity_id", "raw", "key"), ["key"]).select("entity_id_1", "entity_id_2")
    keys = matching_keys(parsed)
    a = placed.select(F.col("entity_id").alias("e1"), F.col("key").alias("key_1"))
    b = placed.select(F.col("entity_id").alias("e2"), F.col("key").alias("key_2"))
    across = meet(meet(keys, a, "key_1"), b, "key_2").where("e1 <> e2").select(F.least("e1", "e2").alias("entity_id_1"), F.greatest("e1", "e2").alias("entity_id_2"))
    return inside.union(across).distinct()
