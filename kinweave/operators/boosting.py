"""Boosted trees of two classes over binned columns, grown by all cores in one stage.

The method is that of Spark's ``GBTClassifier``: log loss, regression trees on its gradient, at most 32 bins a column, the first tree
with weight 1. A level of a tree is a sum over the tasks and not a job: the tasks stay up for all rounds and add their histograms over sockets.
Rows alike in all bins and the label count as one row with a number.
"""

from __future__ import annotations

import json
import secrets
import socket
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 32
POINTS = 1024  # of a column's values in a chunk; chunks with fewer distinct values keep them all
CHUNK = 200_000
TABLE = 1024  # cells of a table over several columns
PART = 20_000  # rows that are worth a task of their own
WAIT_S = 900


def _points(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with counts, or evenly spaced ones where there are many."""
    v, n = np.unique(values, return_counts=True)
    if len(v) <= POINTS:
        return v, n.astype(float)
    at = np.searchsorted(np.cumsum(n), (np.arange(POINTS) + 0.5) * len(values) / POINTS)
    u, k = np.unique(v[at], return_counts=True)
    return u, k * (len(values) / POINTS)


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Middles between neighbouring values: all, or those nearest to equal shares of the rows."""
    v, where = np.unique(values, return_inverse=True)
    n = np.bincount(where, counts, len(v))
    middle = v[:-1] + (v[1:] - v[:-1]) / 2
    if len(middle) <= bins - 1:
        return middle
    out, sums = [], np.cumsum(n)
    stride = target = sums[-1] / bins
    for i in range(1, len(v)):
        if abs(sums[i - 1] - target) < abs(sums[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out[: bins - 1])


def _matrix(columns: Iterable[np.ndarray]) -> list[np.ndarray]:
    out = [np.asarray(c, dtype="float64") for c in columns]
    if any(np.isnan(c).any() for c in out):
        raise ValueError("features may be neither null nor NaN")
    return out


def cuts(rows: DataFrame, columns: Sequence[str], n_rows: int) -> list[np.ndarray]:
    """The thresholds of each column, from all rows."""
    bins = min(BINS, n_rows)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            points = [_points(np.concatenate(c)) for c in zip(*held)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(columns)), pa.int32()), pa.array([v for v, _ in points], pa.list_(pa.float64())), pa.array([n for _, n in points], pa.list_(pa.float64()))], ["c", "v", "n"])

        held: list[list[np.ndarray]] = []
        for b in batches:
            if b.num_rows:
                held.append(_matrix(c.to_numpy(zero_copy_only=False) for c in b.columns))
            if sum(len(h[0]) for h in held) >= CHUNK:
                yield from put(held)
                held = []
        if held:
            yield from put(held)

    def merge(of: pd.DataFrame) -> pd.DataFrame:
        of = of.iloc[np.argsort([x[0] for x in of["v"]], kind="stable")]
        return pd.DataFrame({"c": [of["c"].iloc[0]], "t": [thresholds(np.concatenate(list(of["v"])), np.concatenate(list(of["n"])), bins).tolist()]})

    found = rows.select(*(F.col(c).cast("double") for c in columns)).mapInArrow(sketch, "c int, v array<double>, n array<double>").groupBy("c").applyInPandas(merge, "c int, t array<double>").collect()
    by = {r["c"]: np.array(r["t"], dtype="float64") for r in found}
    return [by[c] for c in range(len(columns))]


def binned(columns: Sequence[np.ndarray], at: Sequence[np.ndarray]) -> np.ndarray:
    """A row of bytes for each column: how many thresholds are below each value."""
    return np.stack([np.searchsorted(t, c).astype("uint8") for t, c in zip(at, columns)])


@dataclass
class Tree:
    """Nodes by number; ``column`` is -1 at a leaf, else values up to the threshold of number ``cut`` go ``left``."""

    column: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]
    value: list[float]
    gain: list[float]


class Tables:
    """Columns packed into few tables, so that one lookup or count serves several of them."""

    def __init__(self, sizes: Sequence[int]):
        self.sizes = list(sizes)
        self.groups: list[list[int]] = []
        for c in sorted(range(len(sizes)), key=lambda c: -sizes[c]):
            fits = [g for g in self.groups if np.prod([sizes[x] for x in g]) * sizes[c] <= TABLE]
            fits[0].append(c) if fits else self.groups.append([c])
        self.shapes = [tuple(sizes[c] for c in g) for g in self.groups]

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for g in self.groups:
            k = np.zeros(x.shape[1], "int16")
            for c in g:
                k = k * np.int16(self.sizes[c]) + x[c]
            out.append(k.astype("int16"))
        return out

    def masks(self, tree: Tree) -> tuple[list[np.ndarray], np.ndarray]:
        """For each cell of each table the leaves that it leaves open, and the leaves' values; the first open leaf is the row's (Lucchese et al. 2015)."""
        leaves: list[float] = []
        open_ = np.full((len(self.sizes), BINS), ~np.uint64(0))

        def walk(node: int) -> None:
            if tree.column[node] < 0:
                leaves.append(tree.value[node])
                return
            first = len(leaves)
            walk(tree.left[node])
            shut = sum(1 << i for i in range(first, len(leaves)))
            open_[tree.column[node], tree.cut[node] + 1 :] &= ~np.uint64(shut)
            walk(tree.right[node])

        walk(0)
        out = []
        for g in self.groups:
            m = np.full(1, ~np.uint64(0))
            for c in g:
                m = (m[:, None] & open_[c, : self.sizes[c]]).ravel()
            out.append(m)
        return out, np.array(leaves)


def _first(masks: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    v = masks[0][keys[0]]
    for m, k in zip(masks[1:], keys[1:]):
        v &= m[k]
    return np.bitwise_count((v & -v) - np.uint64(1))


def _walked(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The values of a tree of any depth, level by level."""
    column, cut, left, right = (np.array(a) for a in (tree.column, tree.cut, tree.left, tree.right))
    node, every = np.zeros(x.shape[1], "int64"), np.arange(x.shape[1])
    while (inner := column[node] >= 0).any():
        step = np.where(x[column[node], every] <= cut[node], left[node], right[node])
        node = np.where(inner, step, node)
    return np.array(tree.value)[node]


class Team:
    """Tasks of one stage that add up arrays; the first task adds, in the order of the tasks, so all have the same sums."""

    def __init__(self, parts: int):
        self.rank, self.parts, self.links = 0, parts, []
        if parts == 1:
            return
        ctx = BarrierTaskContext.get()
        self.rank = ctx.partitionId()
        server = socket.create_server(("", 0), backlog=parts) if self.rank == 0 else None
        said = json.dumps([server.getsockname()[1], secrets.token_hex(16)]) if server else ""
        port, word = json.loads(ctx.allGather(said)[0])
        if server:
            server.settimeout(WAIT_S)
            by: dict[int, socket.socket] = {}
            while len(by) < parts - 1:
                s, _ = server.accept()
                s.settimeout(WAIT_S)
                head = self._read(s, 36)
                if secrets.compare_digest(head[:32], word.encode()):
                    by[int.from_bytes(head[32:], "big")] = s
                else:
                    s.close()
            server.close()
            self.links = [by[k] for k in sorted(by)]
        else:
            s = socket.create_connection((ctx.getTaskInfos()[0].address.rsplit(":", 1)[0], port), WAIT_S)
            s.sendall(word.encode() + self.rank.to_bytes(4, "big"))
            self.links = [s]
        for s in self.links:
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _read(s: socket.socket, n: int) -> bytearray:
        out, at = bytearray(n), 0
        while at < n:
            got = s.recv_into(memoryview(out)[at:])
            if not got:
                raise ConnectionError("a task of the team has ended")
            at += got
        return out

    def sum(self, a: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return a
        if self.rank:
            self.links[0].sendall(np.ascontiguousarray(a).tobytes())
            return np.frombuffer(self._read(self.links[0], a.nbytes), a.dtype).reshape(a.shape)
        total = a.copy()
        for s in self.links:
            total += np.frombuffer(self._read(s, a.nbytes), a.dtype).reshape(a.shape)
        data = total.tobytes()
        for s in self.links:
            s.sendall(data)
        return total

    def close(self) -> None:
        for s in self.links:
            s.close()


class Grower:
    """Grows trees over the rows of this task and, by the team's sums, over those of all tasks."""

    def __init__(self, x: np.ndarray, sizes: Sequence[int], depth: int, columns: int, least: float, team: Team):
        self.x, self.sizes, self.depth, self.columns, self.least, self.team = x, np.array(sizes), depth, columns, least, team
        self.tables = Tables(sizes)
        self.keys = self.tables.keys(x)
        self.flat = np.arange(len(sizes), dtype="int16") * BINS

    def _histogram(self, rows: np.ndarray, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Sums of weights and of weighted targets by column and bin."""
        n = len(self.sizes)
        out = np.zeros((2, n, BINS))
        w, g = w[rows], g[rows]
        if len(rows) < 300:
            k = (self.x[:, rows].T + self.flat).ravel()
            for o, v in zip(out, (w, g)):
                o[:] = np.bincount(k, np.repeat(v, n), n * BINS).reshape(n, BINS)
            return out
        for keys, shape, group in zip(self.keys, self.tables.shapes, self.tables.groups):
            k = keys[rows].astype("int64")
            for o, v in zip(out, (w, g)):
                t = np.bincount(k, v, int(np.prod(shape))).reshape(shape)
                for i, c in enumerate(group):
                    o[c, : shape[i]] = t.sum(axis=tuple(j for j in range(len(group)) if j != i))
        return out

    def _splits(self, h: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        """The best column, threshold and gain of each node, each over a draw of the columns of its own; gain 0 if there is none."""
        n = len(self.sizes)
        sums = np.cumsum(h, axis=3)
        (wl, gl), (wt, gt) = (sums[:, k, :, :-1] for k in (0, 1)), (sums[:, k, :, -1:] for k in (0, 1))
        wr, gr = wt - wl, gt - gl
        ok = (wl >= self.least) & (wr >= self.least) & (np.arange(BINS - 1) < self.sizes[:, None] - 1)
        if self.columns < n:
            drawn = np.argsort(rng.random((len(h), n)), axis=1)[:, : self.columns]
            mine = np.zeros((len(h), n), bool)
            np.put_along_axis(mine, drawn, True, axis=1)
            ok &= mine[:, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            apart = gl * gl / wl + gr * gr / wr
            gain = np.where(ok, apart - gt * gt / wt, 0.0)
            gain = np.where(gain > 1e-12 * np.where(ok, apart, 0.0), gain, 0.0)
        flat = gain.reshape(len(h), -1)
        best = flat.argmax(axis=1)
        return best // (BINS - 1), best % (BINS - 1), flat[np.arange(len(h)), best]

    def tree(self, rows: np.ndarray, w: np.ndarray, g: np.ndarray, rng: np.random.Generator) -> Tree:
        out = Tree([-1], [0], [0], [0], [0.0], [0.0])
        h = self.team.sum(self._histogram(rows, w, g)[None])
        nodes, parts = [0], [rows]
        for level in range(self.depth + 1):
            total = h[:, :, 0].sum(axis=2)
            for i, node in enumerate(nodes):
                out.value[node] = float(total[i, 1] / total[i, 0]) if total[i, 0] > 0 else 0.0
            if level == self.depth:
                break
            column, cut, gain = self._splits(h, rng)
            split = np.flatnonzero(gain > 0)
            if not len(split):
                break
            sides, lengths = [], np.zeros((len(split), 2))
            for j, i in enumerate(split):
                c, r = int(column[i]), parts[i]
                go = self.x[c, r] <= cut[i]
                sides.append((r[go], r[~go]))
                lengths[j] = len(sides[j][0]), len(sides[j][1])
            lengths = self.team.sum(lengths)
            small = (lengths[:, 1] < lengths[:, 0]).astype(int)
            own = self.team.sum(np.stack([self._histogram(sides[j][small[j]], w, g) for j in range(len(split))]))
            both = np.stack([own, h[split] - own], axis=1)
            both = np.where(small[:, None, None, None, None] == 0, both, both[:, ::-1])
            above, nodes, parts = nodes, [], []
            for j, i in enumerate(split):
                at, node = len(out.column), above[i]
                out.column[node], out.cut[node], out.gain[node], out.left[node], out.right[node] = int(column[i]), int(cut[i]), float(gain[i]), at, at + 1
                for a, v in zip((out.column, out.cut, out.left, out.right, out.value, out.gain), (-1, 0, 0, 0, 0.0, 0.0)):
                    a.extend((v, v))
                nodes += [at, at + 1]
                parts += sides[j]
            h = both.reshape(-1, *h.shape[1:])
        return out

    def values(self, tree: Tree) -> np.ndarray:
        if self.depth > 6:
            return _walked(tree, self.x)
        masks, leaves = self.tables.masks(tree)
        return leaves[_first(masks, self.keys)]


def boost(x: np.ndarray, label: np.ndarray, count: np.ndarray, sizes: Sequence[int], weight: float, rounds: int, depth: int, step: float, share: float, columns: int, seed: int, team: Team) -> list[Tree]:
    """``count`` rows of each kind, those of label 1 with ``weight``; each round sees each row with the chance ``share``."""
    y = np.where(label == 1, 1.0, -1.0)
    heavy = np.where(label == 1, weight, 1.0)
    single = count == 1
    grower = Grower(x, sizes, depth, columns, min(weight, 1.0) / 2, team)
    score, trees = np.zeros(len(y)), []
    for m in range(rounds):
        mine, common = np.random.default_rng((seed, m, 1, team.rank)), np.random.default_rng((seed, m, 0))
        if share < 1:
            seen = (mine.random(len(y)) < share).astype("int64")
            seen[~single] = mine.binomial(count[~single], share)
        else:
            seen = count
        w = seen * heavy
        target = 4 * y / (1 + np.exp(2 * y * score)) if m else y
        trees.append(grower.tree(np.flatnonzero(seen), w, w * target, common))
        score += (step if m else 1.0) * grower.values(trees[-1])
    return trees


@dataclass
class Forest:
    """``cuts`` are the thresholds of each column; the score is the first tree and ``step`` times the others."""

    cuts: list[np.ndarray]
    trees: list[Tree]
    step: float

    def scores(self, columns: Iterable[np.ndarray]) -> np.ndarray:
        x = binned(_matrix(columns), self.cuts)
        out = np.zeros(x.shape[1])
        if not hasattr(self, "_masks"):
            self._tables = Tables([len(t) + 1 for t in self.cuts])
            self._masks = [self._tables.masks(t) if sum(c < 0 for c in t.column) <= 64 else None for t in self.trees]
        keys = [k.astype("int64") for k in self._tables.keys(x)]
        for i, (t, m) in enumerate(zip(self.trees, self._masks)):
            out += (self.step if i else 1.0) * (_walked(t, x) if m is None else m[1][_first(m[0], keys)])
        return out

    def probability(self, columns: Sequence[Column]) -> Column:
        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series(1 / (1 + np.exp(-2 * self.scores(c.to_numpy(dtype="float64", na_value=np.nan) for c in b))))

        run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "double")(*columns)

    def importance(self) -> np.ndarray:
        """Shares of the columns in all gains."""
        out = np.zeros(len(self.cuts))
        for t in self.trees:
            inner = np.array(t.column) >= 0
            np.add.at(out, np.array(t.column)[inner], np.array(t.gain)[inner])
        return out / out.sum() if out.sum() > 0 else out

    def text(self) -> str:
        return json.dumps({"cuts": [t.tolist() for t in self.cuts], "trees": [vars(t) for t in self.trees], "step": self.step})

    @classmethod
    def of(cls, text: str) -> Forest:
        d = json.loads(text)
        return cls([np.array(t, dtype="float64") for t in d["cuts"]], [Tree(**t) for t in d["trees"]], d["step"])


def _slots(spark: SparkSession) -> int:
    """Tasks that can stand side by side; one where executors come and go, as Spark then has no stages of tasks that wait for one another."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 1
    j = sc._jsc.sc()
    return max(1, min(sc.defaultParallelism, j.maxNumConcurrentTasks(j.resourceProfileManager().defaultResourceProfile())))


def fit(rows: DataFrame, columns: Sequence[str], n_rows: int, weight: float, rounds: int, depth: int, step: float, share: float, columns_share: float, seed: int) -> Forest:
    """Over all ``rows`` with their ``label``; the stage is one, however many rounds."""
    if not n_rows:
        raise ValueError("there are no rows to learn from")
    at = cuts(rows, columns, n_rows)
    parts = min(_slots(rows.sparkSession), max(1, n_rows // PART))
    sizes, drawn, n = [len(t) + 1 for t in at], int(np.ceil(columns_share * len(columns))), len(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = binned(_matrix(c.to_numpy(zero_copy_only=False) for c in b.columns[1:]), at)
            ends = np.arange(0, (b.num_rows + 1) * n, n, dtype="int32")
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x.T))]), b.column(0)], ["bins", "label"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.frombuffer(b"".join(b.column(0).to_pylist()), "uint8").reshape(-1, n), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        x, label, count = (np.concatenate(a) for a in zip(*held)) if held else (np.zeros((0, n), "uint8"), np.zeros(0, "int32"), np.zeros(0, "int64"))
        held.clear()
        team = Team(parts)
        try:
            trees = boost(np.ascontiguousarray(x.T), label, count, sizes, weight, rounds, depth, step, share, drawn, seed, team)
        finally:
            team.close()
        if team.rank == 0:
            yield pa.RecordBatch.from_arrays([pa.array([Forest(at, trees, step).text()])], ["model"])

    packed = rows.select(F.col("label").cast("int").alias("label"), *(F.col(c).cast("double") for c in columns)).mapInArrow(pack, "bins binary, label int")
    counted = packed.repartition(parts, "bins").groupBy("bins", "label").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("bins", "label")
    return Forest.of(counted.mapInArrow(grow, "model string", barrier=parts > 1).collect()[0]["model"])
