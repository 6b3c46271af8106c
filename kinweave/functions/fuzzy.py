"""Similarity ratios from the longest common subsequence, over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def positions(text: str) -> dict[str, int]:
    """For each character, a number whose bits are its places."""
    out: dict[str, int] = {}
    for i, ch in enumerate(text):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def common(places: dict[str, int], length: int, other: str) -> int:
    """Length of the longest common subsequence, a row of the table held in the bits of one number (Hyyrö 2004)."""
    ones = (1 << length) - 1
    row = ones
    for ch in other:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & ones
    return length - row.bit_count()


def lcs(a: str, b: str) -> int:
    return common(positions(a), len(a), b)


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 if both are empty."""
    n = len(a) + len(b)
    return 2 * lcs(a, b) / n if n else 1.0


def token_set_ratio(a: str, b: str) -> float:
    """How far the words of one text are contained in the other's, from 0 to 1; 0 if either has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 1.0
    return _token_set(len(" ".join(sorted(both))), len(only_x), len(only_y), lcs(only_x, only_y))


def _token_set(shared: int, x: int, y: int, common: int) -> float:
    """Of the lengths of the shared words and of those of one side only, and the common subsequence of the latter."""
    gap = 1 if shared else 0
    lx, ly = shared + gap + x, shared + gap + y
    best = 1 - (x + y - 2 * common) / (lx + ly)
    if shared:
        best = max(best, 1 - (gap + x) / (shared + lx), 1 - (gap + y) / (shared + ly))
    return best


def _windows(short: str, long: str) -> float:
    n, m, places = len(short), len(long), positions(short)
    best = 0.0
    for begin in range(1 - n, m):
        part = long[max(0, begin) : begin + n]
        if 2 * min(n, len(part)) <= best * (n + len(part)):
            continue
        best = max(best, 2 * common(places, n, part) / (n + len(part)))
        if best == 1.0:
            break
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer one; windows may hang over the ends."""
    if not a or not b:
        return float(a == b)
    if len(a) > len(b):
        a, b = b, a
    best = _windows(a, b)
    return max(best, _windows(b, a)) if len(a) == len(b) and best < 1 else best


WORD = 64  # bits of a number: the longest text whose places a machine word holds
NEITHER, NOR = 0xFFFFFFFF, 0xFFFFFFFE  # no characters, and not equal


def _codes(texts: Sequence[str], pad: int) -> np.ndarray:
    """A row of characters for each text, filled up."""
    out = np.array(texts).view("uint32").reshape(len(texts), -1).copy()
    out[np.arange(out.shape[1]) >= np.fromiter(map(len, texts), "int64", len(texts))[:, None]] = pad
    return out


def _places(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each character of the long texts the places in the short ones, as bits."""
    bits = np.packbits(long[:, :, None] == short[:, None, :], axis=2, bitorder="little")
    out = np.zeros((*long.shape, WORD // 8), "uint8")
    out[:, :, : bits.shape[2]] = bits
    return out.view("<u8")[:, :, 0]


def _step(row: np.ndarray, places: np.ndarray) -> np.ndarray:
    hit = row & places
    return (row + hit) | (row - hit)


def _count(row: np.ndarray) -> np.ndarray:
    return WORD - np.bitwise_count(row).astype("int64")


def _by_length(pairs: Sequence[tuple[str, str]], at: list[int], most: int, same: bool) -> Iterator[list[int]]:
    """Runs of pairs of like lengths, with ``same`` of one length of the first text."""
    at = sorted(at, key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    run: list[int] = []
    for i in at:
        if run and (len(run) == most or same and len(pairs[i][0]) != len(pairs[run[0]][0])):
            yield run
            run = []
        run.append(i)
    if run:
        yield run


def lcs_many(pairs: Sequence[tuple[str, str]]) -> list[int]:
    """``lcs`` of each pair, side by side."""
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    out = [0] * len(pairs)
    at = []
    for i, (a, b) in enumerate(pairs):
        if len(a) > WORD:
            out[i] = lcs(a, b)
        elif a:
            at.append(i)
    for run in _by_length(pairs, at, 256, False):
        p = np.ascontiguousarray(_places(_codes([pairs[i][0] for i in run], NEITHER), _codes([pairs[i][1] for i in run], NOR)).T)
        row = np.full(len(run), ~np.uint64(0))
        for column in p:
            row = _step(row, column)
        for i, n in zip(run, _count(row).tolist()):
            out[i] = n
    return out


def token_set_ratios(pairs: Sequence[tuple[str, str]]) -> list[float]:
    """``token_set_ratio`` of each pair."""
    words: dict[str, set[str]] = {}
    out, rest, at = [0.0] * len(pairs), [], []
    for i, (a, b) in enumerate(pairs):
        x, y = (words[t] if t in words else words.setdefault(t, set(t.split())) for t in (a, b))
        if not x or not y:
            continue
        both = x & y
        if both and (len(both) == len(x) or len(both) == len(y)):
            out[i] = 1.0
            continue
        rest.append((" ".join(sorted(x - both)), " ".join(sorted(y - both))))
        at.append((i, sum(map(len, both)) + max(len(both) - 1, 0)))
    for (i, shared), (a, b), n in zip(at, rest, lcs_many(rest)):
        out[i] = _token_set(shared, len(a), len(b), n)
    return out


def partial_ratios(pairs: Sequence[tuple[str, str]]) -> list[float]:
    """``partial_ratio`` of each pair.

    Windows over an end of the longer text are its beginnings and ends, which one run each goes through; the others run side by side.
    """
    out, ways, at = [0.0] * len(pairs), [], []
    for i, (a, b) in enumerate(pairs):
        if not a or not b or min(len(a), len(b)) > WORD:
            out[i] = partial_ratio(a, b)
            continue
        for p in ((a, b),) if len(a) < len(b) else ((b, a),) if len(a) > len(b) else ((a, b), (b, a)):
            ways.append(p)
            at.append(i)
    for run in _by_length(ways, list(range(len(ways))), 128, True):
        n, lengths = len(ways[run[0]][0]), np.array([len(ways[i][1]) for i in run])
        short, long = _codes([ways[i][0] for i in run], NEITHER)[:, :n], _codes([ways[i][1] for i in run], NOR)
        p = np.ascontiguousarray(_places(short, long).T)
        windows = len(p) - n + 1
        row = np.full((windows, len(run)), ~np.uint64(0))
        for k in range(n):
            row = _step(row, p[k : k + windows])
        found = _count(row)
        found[np.arange(windows)[:, None] > lengths - n] = 0  # begins too late to be whole
        best = 2 * found.max(axis=0) / (n + n)
        back = np.arange(len(long[0]))
        turned = np.take_along_axis(long, np.where(back < lengths[:, None], lengths[:, None] - 1 - back, back), axis=1)
        for q in (p, np.ascontiguousarray(_places(short[:, ::-1], turned[:, : n - 1]).T)):
            row = np.full(len(run), ~np.uint64(0))
            for k in range(n - 1):
                row = _step(row, q[k])
                best = np.maximum(best, 2 * _count(row) / (n + k + 1))
        for i, v in zip(run, best.tolist()):
            out[at[i]] = max(out[at[i]], v)
    return out


MANY = {token_set_ratio: token_set_ratios, partial_ratio: partial_ratios}


def similarity_column(f: Callable[[str, str], float], a: Column, b: Column) -> Column:
    """``f`` over two text columns; each distinct pair of a batch is computed once; null counts as empty."""
    many = MANY.get(f, lambda pairs: [f(*p) for p in pairs])

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            pairs = list(zip(x.fillna(""), y.fillna("")))
            each = list(dict.fromkeys(pairs))
            seen = dict(zip(each, many(each)))
            yield pd.Series([seen[p] for p in pairs], dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(a, b)
