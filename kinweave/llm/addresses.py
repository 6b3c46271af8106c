"""Parts of postal addresses typed by people, and when two of them mean the same place (problem 5)."""

from __future__ import annotations

import csv
import os
import re
from functools import lru_cache
from typing import NamedTuple

from .lookalike import missing
from .names import INITIALS, fold, spelling
from .similarity import edits, jaro_winkler

# Kinds of street, with their short forms.
KINDS = {
    "allee": "all", "avenue": "av ave aven", "bazaar": "bzr bazar bz", "boulevard": "bd bld blvd boul blv", "chemin": "ch chem che", "circle": "cir", "colony": "clny col cly coln", "court": "ct crt",
    "cours": "crs", "drive": "dr drv", "highway": "hwy hiway hway", "impasse": "imp", "industrialestate": "indestate", "lane": "ln la", "layout": "lyt lay layt lyout", "marg": "mrg mg", "nagar": "ngr nagr ngar",
    "parkway": "pkwy pky pkway parkwy", "place": "pl plc", "quai": "qu q", "road": "rd", "route": "rte", "rue": "r", "square": "sq", "street": "st str strt", "terrace": "ter", "trail": "trl",
}
KIND = {s: k for k, short in KINDS.items() for s in (k, *short.split())}
LEADING = {"allee", "avenue", "boulevard", "chemin", "cours", "impasse", "place", "quai", "route", "rue"}  #: kinds that French puts before the name
# Directions.
DIRECTIONS = {"n": "n", "north": "n", "s": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w", "ne": "ne", "nw": "nw", "se": "se", "sw": "sw", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw"}


def _subdivisions() -> tuple[dict[str, str], dict[str, set[str]]]:
    """Names of states, regions and departments (ISO 3166-2, in ``subdivisions.csv``), each with the code of its state or region; and what two letters may stand for.

    Codes are told apart by country. Departments stand for their region. ``IN`` and ``DE`` are mostly the country, and a French word.
    """
    names: dict[str, str] = {}
    codes: dict[str, set[str]] = {}
    with open(os.path.join(os.path.dirname(__file__), "subdivisions.csv"), encoding="utf-8") as f:
        for row in csv.DictReader(f):
            written = row["code"].lower().split("|")
            code = f"{row['country'].lower()}-{row['within'].lower() or written[0]}"
            names[row["name"].lower()] = code
            if not row["within"]:
                for w in written:
                    if w not in ("in", "de"):
                        codes.setdefault(w, set()).add(code)
    return names, codes


STATES, CODES = _subdivisions()
COUNTRY = re.compile(r"\b(?:u\.?\s?s\.?\s?a\b\.?|united states(?: of america)?|u\.s\.|us|india|bharat|ind|republique francaise|france|fra)(?=\s*(?:,|$))")
BLANK_PART = re.compile(r"<null>|\bnull\b|\bn/a\b|\bnone\b|\bnil\b")
ESTATE = re.compile(r"\bind[a-z]{0,9}\.? est[a-z]{0,4}\b\.?|\bi\.?\s?e\b\.(?=\s|,|$)|\bi\.e\b\.?")
LANDMARK = re.compile(r"\b(?:near|nr|opposite|opp|behind|beh|bhd|next to)\b\.?\s+[a-z]+(?:-[a-z]+)?\s+(?:bus\s?(?:stand|stop|std)\b|petrol\s?(?:pump|pmp)\b|[a-z]+\b)")
STATE_NAME = re.compile(r"\b(?:" + "|".join(re.escape(s).replace(r"\ ", r"\s+").replace(r"\-", r"[\s-]") for s in sorted(STATES, key=len, reverse=True) if len(s) > 3) + r")\b")
WITHOUT_MARKS = {re.sub(r"[\s-]+", " ", s): code for s, code in STATES.items()}
PREFIX = r"(?:\b(?:h\.?\s?no|hno|no|n°|num|number)\b\.?\s*|n°\s*|#\s*)*"
DIRECTED = r"(?:(north|south|east|west|northeast|northwest|southeast|southwest|ne|nw|se|sw|n|s|e|w)\b\.?\s+)?"
NAMED_FIRST = re.compile(PREFIX + r"(?<![\d.-])(\d+)\s*(?:,\s*)?\b" + DIRECTED + r"([a-z]{3,}(?:[-'][a-z]+)?)[\s.]+([a-z]+)\b\.?")
NAMED_TWICE = re.compile(PREFIX + r"(?<![\d.-])(\d+)\s*(?:,\s*)?\b" + DIRECTED + r"([a-z]+[-'. ]+[a-z]+)[\s.]+([a-z]+)\b\.?")
KIND_FIRST = re.compile(PREFIX + r"(?<![\d.-])(\d+)\s*(?:,\s*)?\b([a-z]+)\b\.?\s+([a-z]{3,}(?:[-'][a-z]+)*)")
BARE = re.compile(PREFIX + r"(?<![\d.-])(\d+)\s+" + DIRECTED + r"([a-z]{4,})\b")
UNIT = re.compile(r"(?:\b(?:shop|flat|unit|suite|ste|apt|appt|apartment|appartement|office|off|bat|batiment|room|floor|door|plot|lot)\b\.?\s*(?:no\b\.?\s*)?#?\s*|\bs\.?\s?no\b\.?\s*|#\s*)(\d+\s?[a-z]?|[a-z]\d+)\b")
POSTCODE = re.compile(r"\b(\d{3}) ?(\d{3})\b|\b(\d{5})(?:-\d{4})?\b")


class Place(NamedTuple):
    number: str
    direction: str
    street: str
    kind: str
    unit: str
    town: str
    postcode: str
    state: str  #: code of a state or region; several, with bars between, where a code has several meanings


@lru_cache(maxsize=100_000)
def street_kind(word: str) -> str:
    if word in KIND:
        return KIND[word]
    if len(word) >= 4:
        for k in KINDS:
            if len(k) >= 4 and word[0] == k[0] and edits(word, k, 1) <= 1:
                return k
    return ""


def parse_address(text: str | None) -> Place | None:
    """The parts of an address; null for a missing one."""
    if text is None:
        return None
    t = fold(text)
    if missing(t):
        return None
    t = BLANK_PART.sub(" ", re.sub(r"\s-\s", " , ", t))
    t = LANDMARK.sub(" ", ESTATE.sub("industrialestate ", t))
    number = direction = street = kind = ""
    for pattern in (NAMED_FIRST, NAMED_TWICE):
        for m in pattern.finditer(t):
            if not number and (k := street_kind(m[4])) and KIND.get(m[3].split()[0]) not in LEADING:
                number, direction, street, kind = m[1], m[2] or "", m[3], k
                t = t[: m.start()] + " , " + t[m.end() :]
    if not number:
        for m in KIND_FIRST.finditer(t):
            if (k := street_kind(m[2])) and k in LEADING:
                number, street, kind = m[1], m[3], k
                t = t[: m.start()] + " , " + t[m.end() :]
                break
    unit = ""
    if m := UNIT.search(t):
        unit = m[1].replace(" ", "")
        t = t[: m.start()] + " , " + t[m.end() :]
    if not number:
        for m in BARE.finditer(t):
            if m[3] not in STATES and len(m[1].lstrip('0')) < 6:
                number, direction, street = m[1], m[2] or "", m[3]
                t = t[: m.start()] + " , " + t[m.end() :]
                break
    postcode = ""
    found = list(POSTCODE.finditer(t))
    if found:
        m = found[-1]
        postcode = m[1] + m[2] if m[1] else m[3]
        t = t[: m.start()] + " , " + t[m.end() :]
    state = ""
    if m := STATE_NAME.search(t):
        state = WITHOUT_MARKS[re.sub(r"[\s-]+", " ", m[0])]
        t = t[: m.start()] + " , " + t[m.end() :]
    words = []
    for w in re.split(r"[^a-z0-9]+", COUNTRY.sub(" , ", t)):
        if not state and len(w) == 2 and w in CODES:
            state = "|".join(sorted(CODES[w]))
        elif len(w) > 2:
            words.append(w if w[0].isdigit() else spelling(w))
    town = " ".join(dict.fromkeys(words))
    return Place(number.lstrip("0") or ("0" if number else ""), DIRECTIONS.get(direction, ""), spelling(re.sub("[^a-z]", "", street)), kind, unit.lstrip("0"), town, postcode, state)


@lru_cache(maxsize=300_000)
def spelt_alike(a: str, b: str) -> bool:
    """The same word or phrase, but for a typo in about every four letters."""
    if a == b:
        return True
    n = min(len(a), len(b))
    most = 1 if n < 6 else 2 if n < 12 else 3
    n = edits(a, b, most)
    return n <= 1 and len(min(a, b, key=len)) >= 4 or n <= most and jaro_winkler(a, b) >= 0.84


def same_place(a: Place, b: Place) -> bool:
    """Whether two addresses mean the same place: no part that both have differs."""
    if not (a.number and b.number and a.number == b.number and a.street and b.street):
        return False
    if a.kind and b.kind and a.kind != b.kind or a.unit and b.unit and a.unit != b.unit or a.direction and b.direction and a.direction != b.direction:
        return False
    if not spelt_alike(a.street, b.street):
        return False
    if a.state and b.state and not set(a.state.split("|")) & set(b.state.split("|")):
        return False
    town = bool(a.town and b.town and towns_alike(a.town, b.town))
    if a.postcode and b.postcode and a.postcode != b.postcode and not (town and edits(a.postcode, b.postcode, 1) <= 1):
        return False
    return town or not a.town or not b.town


@lru_cache(maxsize=300_000)
def towns_alike(a: str, b: str) -> bool:
    if spelt_alike(a, b) or spelt_alike(a.replace(" ", ""), b.replace(" ", "")):
        return True
    x, y = a.split(), b.split()
    if len(x) > len(y):
        x, y = y, x
    return all(any(spelt_alike(p, q) for q in y) for p in x)


def loose_text(text: str) -> tuple[str, str]:
    """Of an address in which no number and street are found: its numbers, and its words with kinds of street in full."""
    joined = INITIALS.sub(lambda m: m.group().replace(".", ""), BLANK_PART.sub(" ", fold(text)))
    words = re.findall("[a-z]+|[0-9]+", COUNTRY.sub(" , ", joined))
    numbers = sorted(w.lstrip("0") or "0" for w in words if w.isdigit())
    return " ".join(numbers), " ".join(KIND.get(w, spelling(w)) for w in words if not w.isdigit())


def place_key(p: Place) -> str:
    return "/".join(p)


@lru_cache(maxsize=200_000)
def place_of(key: str) -> Place:
    return Place(*key.split("/"))
