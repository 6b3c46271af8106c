"""Mixing sources to target weights (problem 8)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, spread
from ..plans.ranking import spread_rank
from .tokenize import token_counts

WINDOW = 1 << 15  #: tokens of a budget that the search covers at first


def _add(reach: int, shift: int, full: int) -> int:
    return reach | (reach << shift) & full


def bounded_knapsack(counts: Sequence[tuple[int, int]], budget: int) -> dict[int, int]:
    """Numbers of items of each size, within the given counts, whose sizes sum as near to ``budget`` as can be, not above.

    Reachable sums are the bits of one integer; each size is taken in powers of two, so a count costs its logarithm. The
    search ends as soon as the budget itself is reached. Only every so many steps are kept, the square root of their
    number, and those between are made again on the way back.
    """
    full, steps = (1 << (budget + 1)) - 1, []
    for size, count in sorted(counts, reverse=True):
        if 0 < size <= budget:
            count, k = min(count, budget // size), 1
            while count > 0:
                steps.append((size, min(k, count)))
                count -= k
                k *= 2
    stride, reach, kept = math.isqrt(len(steps)) + 1, 1, []
    for i, (size, take) in enumerate(steps):
        if i % stride == 0:
            kept.append(reach)
        reach = _add(reach, size * take, full)
        if reach >> budget & 1:
            steps = steps[: i + 1]
            break
    at, chosen = reach.bit_length() - 1, {}
    for block in reversed(range(len(kept))):
        part, before = steps[block * stride : (block + 1) * stride], [kept[block]]
        for size, take in part[:-1]:
            before.append(_add(before[-1], size * take, full))
        for (size, take), reach in zip(reversed(part), reversed(before)):
            if not reach >> at & 1:
                at -= size * take
                chosen[size] = chosen.get(size, 0) + take
    return chosen


def _bound(counts: Sequence[tuple[int, int]], budget: int) -> int:
    """A sum that no choice exceeds: the largest one within the budget whose rest by some common divisor can be reached.

    The divisors are those of all sizes, and of ever fewer of the most numerous ones, down to one size.
    """
    best, common = min(budget, sum(s * n for s, n in counts)), 0
    for size, _ in sorted(counts, key=lambda c: -c[1]):
        new = math.gcd(common, size)
        if new == common:
            continue
        common = new
        full, rests = (1 << common) - 1, 1
        for s, n in counts:
            n = min(n, common - 1)
            k = 1
            while n > 0 and s % common:
                shift = s * min(k, n) % common
                rests |= (rests << shift) & full | rests >> (common - shift)
                n -= k
                k *= 2
        while best >= 0 and not rests >> best % common & 1:
            best -= 1
        if common == 1:
            break
    return best


def plan_source(counts: dict[int, int], budget: int, max_repeats: int, window: int = WINDOW) -> dict[int, int]:
    """How often documents of each length are taken in all, so that the sum is the nearest to ``budget`` that is not above it.

    A length may be taken as often as it has documents, times ``max_repeats``. All lengths are taken in proportion down to a
    window, what one length has too few documents for being carried over to the next, and a bounded knapsack over what is left fills the rest. Whether no other choice comes nearer is known where the sum
    equals a bound that none exceeds; otherwise the window grows eightfold, at last to the whole budget, where the search
    covers every choice. So the result is the optimum at every size; mostly the first window reaches the budget itself.
    """
    room = {k: n * max_repeats for k, n in counts.items() if k > 0 and n * max_repeats > 0}
    size = sum(k * n for k, n in room.items())
    if budget >= size:
        return room
    if budget <= 0:
        return {}
    best, bound = {}, _bound(list(room.items()), budget)
    total = lambda taken: sum(k * n for k, n in taken.items())
    while True:
        taken, sure, seen, given = {}, max(0, budget - window), 0, 0
        for k in sorted(room, reverse=True):  # from the longest on, so that what is rounded never exceeds the share
            seen += room[k]
            taken[k] = seen * sure // size - given
            given += taken[k]
        rest = budget - total(taken)
        for k, n in bounded_knapsack([(k, n - taken[k]) for k, n in room.items()], rest).items():
            taken[k] += n
        if total(taken) > total(best) or not best:
            best = taken
        if total(best) >= bound or window >= budget:
            return {k: n for k, n in best.items() if n}
        window *= 8


def total_budget(sizes: dict[str, int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total at which every source that has tokens can hold its share."""
    there = [s for s in shares if sizes.get(s, 0) > 0 and shares[s] > 0 and repeats[s] > 0]
    weight = sum(shares[s] for s in there)
    return int(min((sizes[s] * repeats[s] * weight / shares[s] for s in there), default=0))


def _counted(docs: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens``; a repeated row once, told by a digest of the text, so that no text is shuffled."""
    named = docs.select("doc_id", F.lower(F.trim("source")).alias("source"), F.md5(F.col("text").cast("binary")).alias("digest"), "text").where("source is not null and doc_id is not null")
    return token_counts(spread(named), ["doc_id", "source", "digest"]).distinct().drop("digest")


def mixture(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mixture ``doc_id, source, n_tokens, repeats`` of the documents that are in it, and the report ``source, target_share, share, tokens, ...``.

    Sources are named without regard to case and outer blanks. Documents without a source, and sources without a target,
    stay out. A repeated row counts once. A source without any token can't be used; the others keep their proportions. ``total`` is the
    number of tokens wanted; by default it is the largest at which every usable source holds its share within
    its repeats. With a larger one, a source that runs out stays at its limit and the shares reached are reported.

    The budget of a source is filled from the counts of documents by exact token length with the nearest sum that those lengths
    can make (``plan_source``). Documents of one length are repeated equally often but for one; a seeded hash decides which have the one more.
    Documents without a token follow the passes that the budget makes over the whole source. The driver gets the
    histogram of lengths, whose rows are bounded by the distinct token counts, not by documents. An empty table gives an empty mixture.
    """
    spark = docs.sparkSession
    sized = cut(_counted(docs))
    goals = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share is not null").collect()}
    counts: dict[str, dict[int, int]] = {s: {} for s in goals}
    for r in sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")).where(F.col("source").isin(list(goals))).collect():
        counts[r["source"]][r["n_tokens"]] = r["n"]
    sizes = {s: sum(k * n for k, n in c.items()) for s, c in counts.items()}
    shares = {s: g[0] for s, g in goals.items()}
    repeats = {s: (g[1] or 0) for s, g in goals.items()}
    if total is None:
        total = total_budget(sizes, shares, repeats)
    weight = sum(shares[s] for s in goals if sizes[s] > 0) or 1.0
    plans = []
    for s in goals:
        budget = int(total * shares[s] / weight)
        taken = plan_source(counts[s], budget, repeats[s])
        if n := counts[s].get(0):
            taken[0] = n * (min(budget // sizes[s], repeats[s]) if sizes[s] else 0)
        plans += [(s, k, n // counts[s][k], n % counts[s][k]) for k, n in taken.items()]
    plan = spark.createDataFrame(plans, "source string, n_tokens bigint, each bigint, more bigint")
    ranked = spread_rank(sized, ["source", "n_tokens"], F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id"), "rank")
    mixed = (
        ranked.join(plan, ["source", "n_tokens"])
        .select("doc_id", "source", "n_tokens", (F.col("each") + (F.col("rank") <= F.col("more")).cast("int")).cast("int").alias("repeats"))
        .where("repeats > 0")
    )
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    goal = spark.createDataFrame([(s, float(g[0]), int(repeats[s])) for s, g in goals.items()], "source string, target_share double, max_repeats int")
    every = got.agg(F.sum("tokens").alias("all_tokens"))
    report = (
        goal.join(got, "source", "left").crossJoin(F.broadcast(every))  # one row
        .select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
                F.round(F.coalesce(F.col("tokens") / F.nullif(F.col("all_tokens"), F.lit(0)), F.lit(0.0)), 9).alias("share"))
    )
    return mixed, report
