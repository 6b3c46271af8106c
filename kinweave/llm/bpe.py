"""Byte-pair encoding by prefix dynamic programming, and its vectorised use over batches of texts.

A byte string has one encoding, so each of its prefixes has one last token. ``PrefixEncoding`` stores that token for every
prefix. A token fits at the end of a prefix if it encodes to itself and if the pair of it and the last token of what stands
before it encodes to just that pair. Bytes can be appended, or replaced near an edit, without encoding the rest again.

``BatchEncoder`` cuts whole batches of texts into words with array operations, encodes each distinct word once and
gathers the ids of all words at once.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


class Vocabulary:
    """Ranks of a byte-level vocabulary file; a token's id is its merge rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.tails = {t[i:] for t in ranks for i in range(len(t))}
        self._alone: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._bytes = {v: k for k, v in ranks.items()}

    @classmethod
    def load(cls, directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> Vocabulary:
        with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, data: bytes, stop: int = 1) -> list[int]:
        """The encoding straight from the definition: join the adjacent pair of lowest rank until ``stop`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def alone(self, token: int) -> bool:
        ok = self._alone.get(token)
        if ok is None:
            ok = self._alone[token] = self.merged(self._bytes[token]) == [token]
        return ok

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; none for a single byte."""
        h = self._halves.get(token)
        if h is None:
            data = self._bytes[token]
            h = self._halves[token] = tuple(self.merged(data, stop=2)) if len(data) > 1 else ()
        return h or None

    def fit(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` each encode to themselves and stay apart when their bytes stand side by side.

        At any moment of the merging, what touches at the seam is a token from the right edge of ``left`` and one from the
        left edge of ``right``. The seam closes if those two can merge before either of them grows on its own side. Among
        equal ranks the leftmost goes first, so growth on the left wins a tie and growth on the right loses it.
        """
        key = (left, right)
        ok = self._pairs.get(key)
        if ok is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            ok, x, y, grows_x, grows_y = self.alone(left) and self.alone(right), left, right, 1 << 40, 1 << 40
            while ok:
                rank = self.ranks.get(self._bytes[x] + self._bytes[y])
                if rank is not None and rank < grows_x and rank <= grows_y:
                    ok = False
                    break
                hx, hy = self.halves(x), self.halves(y)
                if hx and (x > y or not hy):
                    grows_x, x = x, hx[1]
                elif hy:
                    grows_y, y = y, hy[0]
                else:
                    break
            self._pairs[key] = ok
        return ok


class PrefixEncoding:
    """The last token and its length for every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data = vocabulary, b""
        self.last: list[int] = []
        self.append(data)

    def append(self, data: bytes) -> PrefixEncoding:
        v, ranks, tails = self.v, self.v.ranks, self.v.tails
        start, self.data = len(self.data), self.data + data
        text, last = self.data, self.last
        alone, fit, pairs, get = v.alone, v.fit, v._pairs, ranks.get
        for end in range(start + 1, len(text) + 1):
            found, fits = -1, []
            for begin in range(end - 1, max(-1, end - v.longest - 1), -1):
                piece = text[begin:end]
                if piece not in tails:
                    break
                token = get(piece)
                if token is not None:
                    fits.append((begin, token))
            for begin, token in reversed(fits):  # only one fits, mostly a long one
                if begin == 0:
                    ok = alone(token)
                else:
                    key = (last[begin - 1], token)
                    ok = pairs.get(key)
                    if ok is None:
                        ok = fit(*key)
                if ok:
                    found = token
                    break
            if found < 0:
                raise ValueError("a byte is missing from the vocabulary")
            last.append(found)
        return self

    def truncate(self, length: int) -> PrefixEncoding:
        self.data = self.data[:length]
        del self.last[length:]
        return self

    def replace(self, begin: int, end: int, data: bytes) -> PrefixEncoding:
        """Replace bytes begin..end. What stands before is kept; encoding goes on behind the edit until it agrees with before."""
        tail, old, shift = self.data[end:], self.last[end:], None
        self.truncate(begin).append(data)
        run = 0
        for i in range(len(tail)):
            self.append(tail[i : i + 1])
            # the last token of a prefix depends on at most `longest` bytes and tokens before it
            run = run + 1 if self.last[-1] == old[i] else 0
            if run > self.v.longest:
                shift = i + 1
                break
        if shift is not None:
            self.data += tail[shift:]
            self.last += old[shift:]
        return self

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.v._bytes[token])
        return out[::-1]


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Letter, number, white space or other for each code point; unassigned ones are asked of the library, see below."""
    t = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    category = unicodedata.category
    for c in range(0x110000):
        k = category(chr(c))
        t[c] = 9 if k == "Cn" else kinds.get(k[0], OTHER)
    for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        t[c] = SPACE
    return t


def _unassigned(c: int) -> int:
    """Class of a code point that Python's tables don't know, as the tokenizer library has it; without the library there is no id to be had."""
    from tokenizers.pre_tokenizers import ByteLevel

    spans = [s for _, s in ByteLevel(add_prefix_space=False).pre_tokenize_str("a" + chr(c) + "1")]
    return LETTER if spans[0] == (0, 2) else NUMBER if spans[-1] == (1, 3) else OTHER


def word_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where a word of the byte-level pattern starts; ``begins`` are the places at which texts start."""
    n = len(points)
    table = character_classes()
    kind = table[points]
    if (strange := kind == 9).any():
        for c in np.unique(points[strange]):
            table[c] = _unassigned(int(c))
        kind = table[points]
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    space = kind == SPACE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[first[:n]] = 255
    blank = np.empty(n, bool)
    blank[0], blank[1:] = False, points[:-1] == 32
    blank[first[:n]] = False
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = ~space[1:]
    solid_next[first[1:]] = False
    start = np.where(space, (before != SPACE) | solid_next, (kind != before) & ~blank)
    quotes = np.flatnonzero((points == 39) & start & (before != OTHER))
    if len(quotes):
        ends = np.flatnonzero(first)
        room = ends[np.searchsorted(ends, quotes, side="right")] - quotes
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        a, b = padded[quotes + 1], padded[quotes + 2]
        two = (room > 2) & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        one = (room > 1) & np.isin(a, [115, 116, 109, 100])  # s t m d
        for hit, width in ((two, 2), (one & ~two, 1)):
            q = quotes[hit]
            start[q + 1] = False
            after = q + 1 + width
            after = after[after < n]
            after = after[(kind[after] == LETTER) & ~first[after]]
            start[after] = True
    return start


class BatchEncoder:
    """Ids of many texts at once. Null and empty texts have no ids."""

    SHORT = 48  #: words up to this many characters are gathered by a 64-bit hash and then compared, longer ones by themselves
    CHUNK = 1 << 19  #: characters handled at once; bounds the memory
    KEPT = 400_000  #: distinct words kept between batches

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[object, tuple[str, tuple[int, ...]]] = {}
        self._base = 0x9E3779B97F4A7C15 | 1
        self._inverse = pow(self._base, -1, 1 << 64)
        self._up = self._down = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            for name, base in (("_up", self._base), ("_down", self._inverse)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def _word(self, key: object, word: str) -> tuple[int, ...]:
        kept = self.known.get(key)
        if kept is not None and kept[0] == word:
            return kept[1]
        data = word.encode()
        token = self.v.ranks.get(data)
        ids = (token,) if token is not None and self.v.alone(token) else tuple(PrefixEncoding(self.v, data).ids())
        if kept is None:
            self.known[key] = word, ids
        return ids

    def _chunk(self, texts: Sequence[str], counts_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids."""
        whole = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        if not whole:
            return np.zeros(len(texts), np.int64), np.empty(0, np.int32)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        n = len(points)
        begins = (ends - lengths)[lengths > 0]
        at = np.flatnonzero(word_starts(points, begins))
        to = np.append(at[1:], n)
        self._powers(n + 1)
        mixed = points.astype(np.uint64) + np.uint64(1)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xCA9B0C7EBA1DA115)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * self._up[:n], out=total[1:])
        keys = (total[to] - total[at]) * self._down[at]
        if len(self.known) > self.KEPT:
            self.known.clear()
        size = to - at
        codes, uniques = pd.factorize(keys)
        firsts = np.empty(len(uniques), np.int64)
        firsts[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        # every word is compared with the first of its hash, letter by letter
        first = firsts[codes]
        single = (size > self.SHORT) | (size != size[first])
        other = np.flatnonzero(points != points[np.arange(n) + np.repeat(np.where(single, 0, at[first] - at), size)])
        single[np.searchsorted(at, other, side="right") - 1] = True
        found: list[tuple[int, ...]] = []
        word = self._word
        for key, f, b, e in zip(uniques.tolist(), firsts.tolist(), at[firsts].tolist(), to[firsts].tolist()):
            found.append(() if single[f] else word(key, whole[b:e]))
        extra: dict[str, int] = {}
        for i in np.flatnonzero(single).tolist():
            w = whole[at[i] : to[i]]
            if w not in extra:
                extra[w] = len(found)
                found.append(word(w, w) if len(w) < 4096 else tuple(PrefixEncoding(self.v, w.encode()).ids()))
            codes[i] = extra[w]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        each = sizes[codes]
        sums = np.concatenate([[0], np.cumsum(each)])
        bounds = np.searchsorted(at, ends)  # words before the end of each text
        counts = np.diff(sums[bounds], prepend=0)
        if counts_only:
            return counts, np.empty(0, np.int32)
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum()))
        offsets = np.cumsum(sizes) - sizes
        gather = np.repeat(offsets[codes] - sums[:-1], each) + np.arange(sums[-1])
        return counts, flat[gather]

    def _pieces(self, text: str) -> list[str]:
        """Cut a very long text where a word must end, so that memory stays bounded. The words don't change."""
        out, at, n = [], 0, len(text)
        while n - at > 2 * self.CHUNK:
            cut = -1
            for i in range(at + self.CHUNK, n - 1):
                a, b = text[i - 1], text[i]
                if b == " " and not a.isspace():
                    cut = i
                    break
                if a.isascii() and b.isascii() and (a.isalpha() and b.isdigit() or a.isdigit() and b.isalpha()):
                    cut = i
                    break
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut
        out.append(text[at:])
        return out

    def encode(self, texts: Iterable[str | None], counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids of all texts in order (none with ``counts_only``)."""
        counts: list[int] = []
        blocks: list[np.ndarray] = []
        parts: list[str] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if parts:
                c, ids = self._chunk(parts, counts_only)
                for o, k in zip(owner, c.tolist()):
                    counts[o] += k
                blocks.append(ids)
                parts.clear()
                owner.clear()
                size = 0

        for i, t in enumerate(texts):
            counts.append(0)
            if not t:
                continue
            for p in [t] if len(t) <= 2 * self.CHUNK else self._pieces(t):
                if size + len(p) > self.CHUNK:
                    flush()
                parts.append(p)
                owner.append(i)
                size += len(p)
        flush()
        return np.asarray(counts, np.int64), np.concatenate(blocks) if blocks else np.empty(0, np.int32)


@lru_cache(maxsize=4)
def batch_encoder(directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> BatchEncoder:
    """One encoder for each Python worker."""
    return BatchEncoder(Vocabulary.load(directory, name))
