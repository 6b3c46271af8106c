"""One form for texts that look the same (problem 6)."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .pairs import pairs_within

# Letters of other scripts, and special Latin ones, that are drawn like a plain Latin letter or sign.
LOOK_ALIKES = {
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐⲂ", "C": "СϹᏟꓚⲤ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "ꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧⲎ", "I": "ІΙӀꓲⲒ", "J": "ЈͿᎫꓙ", "K": "КΚᏦꓗⲔ", "L": "Ꮮꓡ", "M": "МΜϺᎷꓟⲘ", "N": "ΝꓠⲚ",
    "O": "ОΟՕꓳⲞ", "P": "РΡᏢꓑⲢ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏕᏚꓢ", "T": "ТΤᎢꓔⲦ", "U": "ꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳᏔꓪ", "X": "ХΧꓫⲬ", "Y": "ҮΥᎩᎽꓬⲨ", "Z": "ΖᏃꓜ",
    "a": "аɑα", "b": "Ꮟ", "c": "сϲⲥ", "d": "ԁᏧ", "e": "е", "g": "ɡ", "h": "һհᏂ", "i": "іᎥ", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօσⲟ", "p": "рρⲣ", "q": "ԛ",
    "s": "ѕ", "u": "սυ", "v": "νѵ", "w": "ԝ", "x": "хⲭ", "y": "уүγ", "-": "‐‑−˗⁃",
}

#: What a text may hold instead of nothing. Fixed values.
PLACEHOLDERS = {"", "-", "--", ".", "?", "n/a", "na", "n.a.", "null", "<null>", "none", "nil", "unknown", "not available", "tbd", "xxx"}

BLANKS = "".join(chr(c) for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x2800, 0x3164))


def unseen(ch: str) -> bool:
    """Characters that leave no mark: format characters, variation selectors, controls."""
    c = ord(ch)
    return unicodedata.category(ch) in ("Cf", "Cc") and ch not in BLANKS or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5)


def _same_shape(ch: str) -> str | None:
    """What a character is a mere width, font, no-break or ligature variant of, its marks apart from their letters."""
    kind, c = unicodedata.decomposition(ch).partition(" ")[0], ord(ch)
    if kind in ("<wide>", "<narrow>", "<font>", "<noBreak>") or kind == "<compat>" and (0xFB00 <= c <= 0xFB06 or 0x2160 <= c <= 0x217F):
        return unicodedata.normalize("NFKD", ch)
    return None


class LookAlikes:
    """Classes of strings and code points that look the same, joined by union-find.

    Ties are transitive: a full-width letter is tied to its plain form, that one to the letters of other scripts. Texts are compared
    with marks apart from their letters and in canonical order, so a class of letters holds with any marks. ``counts`` tells how often each string occurs;
    the most frequent member stands for its class, among equals a plain one, then the lowest; where several letters are drawn as one character, the
    letters stand for it, so that each is then in its own class.
    """

    #: Blocks with variants of width and font, ligatures and numerals, beside the characters of the corpus.
    BLOCKS = ((0x21, 0x250), (0x2100, 0x2190), (0xFB00, 0xFB07), (0xFF01, 0xFFEF), (0x1D400, 0x1D800))

    def __init__(self, counts: dict[str, int] | None = None, characters: Iterable[str] = ()):
        self.parent: dict[str, str] = {}
        for plain, others in LOOK_ALIKES.items():
            for o in others:
                self.union(plain, o)
        known = {*(chr(c) for first, end in self.BLOCKS for c in range(first, end)), *(c for s in characters for c in s)}
        for ch in sorted(known):
            if (s := _same_shape(ch)) and s != ch and not any(unseen(x) or x in BLANKS for x in (*s, ch)):
                self.union(ch, s)
        counts = counts or {}
        best: dict[str, tuple] = {}
        for x in self.parent:
            root, rank = self.find(x), (-len(x), -counts.get(x, 0), not x.isascii(), x)
            if root not in best or rank < best[root]:
                best[root] = rank
        self.rewrites = {x: best[self.find(x)][-1] for x in self.parent if best[self.find(x)][-1] != x}

    def find(self, x: str) -> str:
        p = self.parent.setdefault(x, x)
        while p != x:
            self.parent[x] = p = self.parent.setdefault(p, p)
            x, p = p, self.parent[p]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


class Rewriter:
    """Rewrites texts to one form: unseen characters go, blanks become single spaces, look-alikes their representative.

    Marks are first parted from their letters and put in canonical order, and joined with them again at the end. Patterns are found by one automaton,
    leftmost first and of these the longest. Equal forms are equal however they are reached, so rewriting goes on until
    nothing changes, which normally is at once; should it ever go round, the smallest text of the round is the form.
    """

    def __init__(self, rewrites: dict[str, str]):
        self.automaton = ahocorasick.Automaton()
        for pattern, to in rewrites.items():
            self.automaton.add_word(pattern, (len(pattern), to))
        self.automaton.make_automaton()
        parts = {c for pattern in rewrites if pattern.isascii() for c in pattern}
        self._plain = set(map(chr, range(0x21, 0x7F))) - parts  # texts of these alone stay as they are
        self._table = _Table()

    def _once(self, text: str) -> str:
        out, at = [], 0
        for end, (length, to) in self.automaton.iter_long(text):
            begin = end - length + 1
            out.append(text[at:begin])
            out.append(to)
            at = end + 1
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str | None) -> str:
        if not text:
            return ""
        text = " ".join(text.translate(self._table).split(" ")) if not text.isascii() else text.translate(self._table)
        text = " ".join(x for x in text.split(" ") if x)
        if text.isascii() and self._plain.issuperset(text.replace(" ", "")):
            return text
        seen = [unicodedata.normalize("NFD", text)]
        while (new := unicodedata.normalize("NFD", self._once(seen[-1]))) not in seen:
            seen.append(new)
        return unicodedata.normalize("NFC", min(seen[seen.index(new) :]))


class _Table(dict):
    """Translation of blanks and unseen characters, filled as characters are met."""

    def __missing__(self, c: int) -> int | str | None:
        ch = chr(c)
        self[c] = to = " " if ch in BLANKS else None if unseen(ch) else c
        return to


@lru_cache(maxsize=1)
def plain_rewriter() -> Rewriter:
    """Rewrites to the plain Latin form whatever the corpus; what the operators on names and addresses start from."""
    return Rewriter(LookAlikes({c: 2 for c in map(chr, range(0x21, 0x7F))} | {c: 1 for c in map(chr, range(0xC0, 0x250))}).rewrites)


def missing(text: str) -> bool:
    return text.strip().lower() in PLACEHOLDERS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter[str] = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            if t:
                n.update(unicodedata.normalize("NFD", t))
    yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], names=["s", "n"])


def corpus_classes(texts: DataFrame, column: str) -> LookAlikes:
    """The classes with representatives by their frequency in the corpus.

    Each task sends one row for each distinct character; the driver gets their totals, which are bounded by
    the number of code points, not by the corpus.
    """
    rows = texts.select(column).mapInArrow(_count, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n")).collect()
    counts = {r["s"]: r["n"] for r in rows}
    return LookAlikes(counts, counts)


def rewrite(df: DataFrame, column: str, to: str, classes: LookAlikes) -> DataFrame:
    """Add the one form of a column. Null comes out as the empty text; all other columns are kept as they are."""
    rewrites = classes.rewrites

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewriter = Rewriter(rewrites)
        for s in series:
            yield pd.Series([rewriter(t) for t in s], dtype="object")

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(to, F.pandas_udf(run, "string")(F.col(column)))


def fields(records: DataFrame) -> DataFrame:
    """``entity_id, field_name, raw`` for names and addresses; repeated records once."""
    both = F.explode(F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(n).alias("raw")) for n in ("business_name", "business_address"))))
    return records.where("entity_id is not null").select("entity_id", both.alias("x")).select("entity_id", "x.*").where("raw is not null").distinct()


def one_form(records: DataFrame) -> DataFrame:
    """``entity_id, field_name, raw, form``: every name and address with its one form. Null texts are left out."""
    f = fields(records)
    return rewrite(f, "raw", "form", corpus_classes(f, "raw"))


def same_looking_pairs(records: DataFrame) -> DataFrame:
    """``entity_id_1, entity_id_2, field_name`` of records whose texts look the same but differ in characters.

    Null, blank and placeholder texts are in no pair. Repeated records count once; extra columns are ignored.
    """
    forms = cut(one_form(records).where(~F.lower("form").isin(list(PLACEHOLDERS))))
    return pairs_within(forms, ["field_name", "form"]).select("entity_id_1", "entity_id_2", "field_name")
