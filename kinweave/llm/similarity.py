"""Similarities of short strings."""

from __future__ import annotations

from functools import lru_cache

# Consonant classes of letters that are heard or typed for each other. Fixed values.
SOUNDS = {**dict.fromkeys("bfpvw", "1"), **dict.fromkeys("cgjkqsxz", "2"), **dict.fromkeys("dt", "3"), "l": "4", **dict.fromkeys("mn", "5"), "r": "6"}


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(0, max(la, lb) // 2 - 1)
    used, first = [False] * lb, []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                first.append(ch)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [b[j] for j in range(lb) if used[j]]
    t = sum(x != y for x, y in zip(first, second)) / 2
    return (m / la + m / lb + (m - t) / m) / 3


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    s = jaro(a, b)
    n = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        n += 1
    return s + n * scale * (1 - s)


@lru_cache(maxsize=100_000)
def letters(text: str) -> int:
    """The letters of a text as bits; letters may share a bit."""
    out = 0
    for ch in text:
        out |= 1 << (ord(ch) & 63)
    return out


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours; ``most + 1`` if there are more than ``most``."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    la, left = len(a), len(b)
    if la - left > most or (letters(a) ^ letters(b)).bit_count() > 2 * most:  # an edit takes one letter out and brings one in at most
        return most + 1
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    # a column of the table in the bits of a few numbers (Hyyrö 2003): where it goes up and down by one
    ones, last = (1 << la) - 1, 1 << la - 1
    up, down, same, before, n = ones, 0, 0, 0, la
    for ch in b:
        hit = places.get(ch, 0)
        same = (((hit & up) + up) ^ up | hit | down | (~same & hit) << 1 & before) & ones
        over, under = down | ones & ~(same | up), same & up
        if over & last:
            n += 1
        elif under & last:
            n -= 1
        left -= 1
        if n - left > most:  # each letter that is left takes off one at most
            return most + 1
        over = over << 1 | 1
        up, down, before = (under << 1 | ~(same | over)) & ones, over & same, hit
    return n


def subsequence(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


@lru_cache(maxsize=200_000)
def sound(word: str) -> str:
    """First letter's class and the classes of the consonants after it, each run once; vowels, h and y are not heard."""
    out = []
    last = ""
    for ch in word:
        c = SOUNDS.get(ch, "")
        if c and c != last:
            out.append(c)
        if c or ch not in "hw":
            last = c
    first = SOUNDS.get(word[:1], "0") if word else ""
    return (first if not out or out[0] != first else "") + "".join(out)
