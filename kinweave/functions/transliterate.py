"""Latin letters for names and addresses in other scripts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters whose decomposition gives no plain letter.
EXPLICIT = {"Ł": "L", "ł": "l", "œ": "oe", "Œ": "OE", "ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "—": "-", "–": "-", "‐": "-", "‑": "-", "“": '"', "”": '"', "‘": "'", "’": "'", "°": "deg"}
# Scripts of India, as their characters are named.
SCRIPTS = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")
# Vowels, and consonants whose letter is not their name without its last A.
VOWELS = {"A": "a", "AA": "a", "I": "i", "II": "i", "U": "u", "UU": "u", "E": "e", "EE": "e", "CANDRA E": "e", "SHORT E": "e", "AI": "ai", "O": "o", "OO": "o", "CANDRA O": "o", "SHORT O": "o", "AU": "au", "VOCALIC R": "r"}
CONSONANTS = {"TTA": "t", "TTHA": "th", "DDA": "d", "DDHA": "dh", "NNA": "n", "NNNA": "n", "NYA": "n", "NGA": "n", "SHA": "s", "SSA": "s", "LLA": "l", "LLLA": "l", "RRA": "r"}


def _indic(name: str) -> str:
    if "VIRAMA" in name:
        return ""
    if name.endswith(("ANUSVARA", "BINDU", "BINDI", "TIPPI")):
        return "m"
    if name.endswith("NUKTA"):
        return "'"
    kind, _, what = name.partition(" ")
    if name.startswith("VOWEL SIGN "):
        return VOWELS.get(name[11:], "")
    if kind == "DIGIT":
        return str(("ZERO", "ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE").index(what)) if what else ""
    if kind != "LETTER":
        return ""
    if what in VOWELS:
        return VOWELS[what]
    if what in CONSONANTS:
        return CONSONANTS[what]
    return what[:-1].lower() if what.endswith("A") and what.isalpha() else ""


def latin_character(ch: str, deep: bool = True) -> str:
    """The Latin form of one character, empty where there is none."""
    if ch.isascii():
        return ch
    if ch in EXPLICIT:
        return EXPLICIT[ch]
    script, _, rest = unicodedata.name(ch, "").partition(" ")
    if script in SCRIPTS:
        return _indic(rest.removeprefix("SIGN ") if rest.startswith("SIGN ") else rest)
    if unicodedata.category(ch) in ("Cf", "Mn"):
        return ""
    parts = unicodedata.normalize("NFKD", ch)
    return "".join(latin_character(c, False) for c in parts) if deep and parts != ch else ""


class _Latin(dict):
    def __missing__(self, point: int) -> str:
        self[point] = to = latin_character(chr(point))
        return to


LATIN = _Latin()


def latin(text: str | None) -> str | None:
    """A text in ASCII, letter case kept; null stays null. Scripts without a rule come out empty."""
    return text if text is None or text.isascii() else text.translate(LATIN)


def _run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in series:
        yield s.map(latin)


_run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}


def latin_column(c: Column) -> Column:
    return F.pandas_udf(_run, "string")(c)


def transliterate(df: DataFrame, columns: tuple[str, ...] = ("business_name", "business_address")) -> DataFrame:
    """Rewrite the named columns in ASCII; others, ``country`` among them, stay as they are.

    The function leaves ASCII texts alone, so most rows only pass through it in Arrow batches.
    """
    return df.withColumns({c: latin_column(F.col(c)) for c in columns})
