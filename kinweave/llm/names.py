"""Parts of names typed by people, and when two names mean the same (problem 4)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from .lookalike import missing, plain_rewriter
from .similarity import edits, jaro_winkler, sound, subsequence

# Words for legal forms, as tokens after dots are joined.
LEGAL = set("llp llc ltd limited private pvt inc incorporated corp corporation co company pc pllc plc lp sarl sas sasu sa eurl sci snc cie compagnie liability partnership opc".split())
# Kinds of business, in the forms written in full.
TRADES = (
    "agencies associates ateliers automotive bakery boulangerie brothers cabinet care chemicals clinic construction consulting dental developers electric electricals "
    "electricite electronics engineering enterprises equipment etablissements exporters foods furniture garage hospital hotel imprimerie infotech insurance jewellers "
    "landscaping laundry librairie logistics maconnerie management manufacturing marketing menuiserie motors pharmaceuticals pharmacie pharmacy photography plumbing polymers printing "
    "properties restaurant salon services societe solutions stores supply technologies textiles traders transports travels works"
).split()
# Words after the kind of business that tell one organisation of a family from another.
FURTHER = "academy capital exports foundation group holdings imports industries international partners rentals trading trust ventures".split()
# Common given names with their short and other forms.
NICKNAMES = {
    "charles": "chas charlie chuck", "edward": "ed eddie edw ned ted", "elizabeth": "beth betty eliz liz lizzie", "francois": "fcois francoys frs",
    "genevieve": "genevieva gen viviane", "james": "jas jim jimmy", "jean": "", "joseph": "joe jos", "katherine": "catherine kate kath kathy katie",
    "krishnan": "krishna krishnn kris", "lakshmi": "lakshmy laxmi", "margaret": "maggie marg meg peggy", "mohammed": "md mohamed mohammad mohd muhammad muhammed",
    "patricia": "pat patty tricia trish", "pierre": "", "richard": "dick rich richd rick", "robert": "bob bobby rob robt", "thomas": "thos tom tommy",
    "venkatesh": "venkat venkatesan venky", "william": "bill billy will wm",
}
GIVEN = {n: full for full, short in NICKNAMES.items() for n in (full, *short.split())}
# Short forms that are not made of the word's letters in order.
SHORT_FORMS = {
    "bros": "brothers", "svcs": "services", "assocs": "associates", "mgt": "management", "phcy": "pharmacy", "ste": "societe", "ets": "etablissements", "elect": "elect", "elec": "elect", "chem": "chemicals", "info": "infotech",
    "tech": "technologies", "const": "construction", "constr": "construction", "constn": "construction", "eng": "engineering", "engg": "engineering", "pharm": "pharm", "pharma": "pharm", "auto": "automotive", "serv": "services", "indus": "industries", "inds": "industries",
    "phcie": "pharmacie", "automtv": "automotive", "mgmt": "management", "mfg": "manufacturing", "entreprise": "enterprises", "enterprise": "enterprises", "entps": "enterprises", "constructions": "construction", "jewelers": "jewellers", "intl": "international", "fdn": "foundation", "grp": "group", "hldgs": "holdings", "acad": "academy", "exp": "exports",
}
#: Short forms of several words: each stands for any of them.
EITHER = {"elect": ("electric", "electricals", "electricite"), "pharm": ("pharmacy", "pharmaceuticals", "pharmacie")}

KINDS_OF_WORDS = ("trade", "further", "given")
BY_LETTER: dict[str, list[tuple[str, str, set[str]]]] = {}
for _kind, _words in zip(KINDS_OF_WORDS, (TRADES, FURTHER, GIVEN)):
    for _w in _words:
        if len(_w) >= 5:
            BY_LETTER.setdefault(_w[0], []).append((_kind, _w, set(_w)))
#: Kinds of business of two words.
TOGETHER = {"dental": "care", "care": "dental", "works": "engineering", "engineering": "works"}

ALIAS = re.compile(r"\b(?:d\s?[./]?\s?b\s?[./]?\s?a\b\.?|t\s?/\s?a\b|trading as\b|doing business as\b|t/as\b)")
INITIALS = re.compile(r"\b[a-z](?:\.[a-z])+\b\.?")
LEAD = re.compile(r"^(?:[^a-z0-9]+|\d+\)|m\s?/\s?s\b\.?|messrs\b\.?|the\b)+")


class Name(NamedTuple):
    core: tuple[str, ...]  #: the words that name it, in order
    given: str  #: a given name in its full form
    trade: tuple[str, ...]  #: kinds of business, sorted
    further: tuple[str, ...]  #: words that tell it from others of its family, sorted


def fold(text: str | None) -> str:
    """Lower case, one form for look-alikes, no accents."""
    t = unicodedata.normalize("NFD", plain_rewriter()(text).lower())
    return "".join(c for c in t if not unicodedata.combining(c)) if not t.isascii() else t


SPELLINGS = [(re.compile(a), b) for a, b in (("ee", "i"), ("oo", "u"), ("ph", "f"), ("(?<=[bcdgkpt])h", ""), ("w", "v"), ("c|q|ck", "k"), ("z", "s"), ("y", "i"), ("ae", "e"), (r"(.)\1", r"\1"))]


@lru_cache(maxsize=200_000)
def spelling(word: str) -> str:
    """A word with letters that are written for each other in one form."""
    for pattern, to in SPELLINGS:
        word = pattern.sub(to, word)
    return word


@lru_cache(maxsize=200_000)
def word_kind(word: str) -> tuple[str, str]:
    """What a word is (legal, trade, further, given, short or core) and its full form; ``short`` may abbreviate a trade."""
    if word in LEGAL:
        return "legal", word
    if word in GIVEN:
        return "given", GIVEN[word]
    if word in SHORT_FORMS and len(word) > 4:
        w = SHORT_FORMS[word]
        return ("further" if w in FURTHER else "trade"), w
    for kind, words in (("trade", TRADES), ("further", FURTHER)):
        if word in words:
            return kind, word
    near = BY_LETTER.get(word[:1], [])
    if len(word) >= 4:
        letters, best = set(word), None
        for order, (kind, w, own) in enumerate(near):
            most = 2 if kind != "given" and len(word) >= 7 else 1
            # a typo changes at most two of the letters in use
            if abs(len(w) - len(word)) <= most and len(letters ^ own) <= 2 * most and (n := edits(word, w, most)) <= most:
                rank = (KINDS_OF_WORDS.index(kind), n, order)
                if best is None or rank < best[0]:
                    best = rank, kind, w
        if best:
            return best[1], GIVEN[best[2]] if best[1] == "given" else best[2]
    if word in SHORT_FORMS:
        return "short", SHORT_FORMS[word]
    if len(word) >= 3:
        hits = [w for kind, w, _ in near if kind != "given" and len(word) < len(w) and (w.startswith(word) or _abbreviates(word, w))]
        if hits:
            return "short", min(hits, key=lambda w: (not w.startswith(word), abs(len(w) - len(word)), w))
    return "core", word


def _abbreviates(word: str, full: str) -> bool:
    """Letters of the full word in order, with its last consonant or plural and more consonants than a name has."""
    vowels = sum(c in "aeiou" for c in word)
    if word[-1] == "y" and full.endswith("ies"):
        word, full = word[:-1], full[:-3]
    return vowels * 3 <= len(word) and subsequence(word, full)


def name_words(text: str | None) -> list[str] | None:
    """The words of a name in order, slips with digits mended; null for a missing one. Where one name trades as another, the last one counts."""
    if text is None:
        return None
    t = fold(text)
    if missing(t):
        return None
    parts = [p for p in ALIAS.split(t) if re.search("[a-z]", p)]
    t = LEAD.sub("", parts[-1] if parts else t)
    t = re.sub(r"\(?\bp\)?\.?\s+ltd\b", " pvt ltd", t)
    t = INITIALS.sub(lambda m: " " + m.group().replace(".", "") + " ", t)
    t = re.sub(r"(?<=[a-z])0|0(?=[a-z])", "o", t)
    t = re.sub(r"(?<=[a-z])1|1(?=[a-z])", "l", t)
    t = re.sub(r"\binfo[ -]?tech\b", "infotech", t)
    t = re.sub(r"\bet\b|\band\b|&|\+", " ", t)
    return [w for w in re.split(r"[^a-z]+", t) if w]


def parse_name(text: str | None, trades: frozenset[str] = frozenset()) -> Name | None:
    """The parts of a name; null for a missing one. ``trades`` are kinds of business beside those listed."""
    words = name_words(text)
    if words is None:
        return None
    core, given, trade, further, short = [], "", [], [], []
    for w in words:
        kind, full = word_kind(w)
        if kind == "core" and w in trades and core:
            kind, full = "trade", w
        if kind == "trade":
            trade.append(full)
        elif kind == "further":
            further.append(full)
        elif kind == "given" and not given:
            given = full
        elif kind == "given" and full == "pierre" and given == "jean":
            given = "jean pierre"
        elif kind != "legal":
            core.append(w)
            if kind == "short":
                short.append((w, full))
    for w, full in reversed(short):  # a short form counts where no kind of business is written out, or completes one
        if (not trade and len(core) > 1 or TOGETHER.get(full) in trade) and not (full in FURTHER and not trade and len(core) < 3):
            core.remove(w)
            (further if full in FURTHER else trade).append(full)
    core = [spelling(w) for w in core]
    if not core and not trade and not given and not further:
        core = words
    return Name(tuple(core), given, tuple(sorted(set(trade))), tuple(sorted(set(further))))


def _expand(words: tuple[str, ...]) -> set[str]:
    return {x for w in words for x in EITHER.get(w, (w,))}


def trades_agree(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Equal kinds of business; a short form agrees with each word it may stand for; a missing one agrees with all."""
    if not a or not b or a == b:
        return True
    x, y = _expand(a), _expand(b)
    return x <= y or y <= x


@lru_cache(maxsize=500_000)
def words_alike(a: str, b: str) -> bool:
    """The same word with at most a typo or two, or one word shortened to its beginning."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(a) <= 3:
        return b.startswith(a)
    n = edits(a, b, 2)
    return n <= 1 or n <= 2 and len(a) >= 6 and jaro_winkler(a, b) >= 0.86


def cores_alike(a: Name, b: Name) -> bool:
    x, y = list(a.core), list(b.core)
    if a.given and b.given and a.given != b.given:
        return False
    # a given name on one side may stand as an initial, or as a misspelt word, on the other
    for p, q, given in ((x, y, a.given), (y, x, b.given)):
        other = b.given if p is x else a.given
        if given and not other and len(q) > len(p):
            for w in q:
                if len(w) <= 3 and spelling(given).startswith(w) or len(w) > 3 and words_alike(w, spelling(given)):
                    q.remove(w)
                    break
    if not x or not y:
        return not x and not y
    jx, jy = "".join(x), "".join(y)
    if len(x) == len(y):
        if all(words_alike(p, q) for p, q in zip(x, y)):
            return max(map(len, x)) > 3 and max(map(len, y)) > 3
        if len(x) == 2 and words_alike(x[0], y[1]) and words_alike(x[1], y[0]):
            return max(map(len, x)) > 3 and max(map(len, y)) > 3
    if min(len(jx), len(jy)) < 8:
        return False
    limit = 3 if min(len(jx), len(jy)) >= 12 else 2
    if edits(jx, jy, limit) <= limit and jaro_winkler(jx, jy) >= 0.9:
        return True
    for p, q in ((x, jy), (y, jx)):  # a first word cut short and written together with the next
        if len(p) == 2 and len(p[0]) <= 3 and q.startswith(p[0]) and len(p[1]) >= 5 and edits(q[-len(p[1]) :], p[1], 1) <= 1:
            return True
        if len(p) == 2 and len(q) >= 8 and any(edits(p[0][:k] + p[1], q, 1) <= 1 for k in (1, 3)):
            return True
    return len(x) == 2 and edits(x[1] + x[0], jy, limit) <= limit or len(y) == 2 and edits(jx, y[1] + y[0], limit) <= limit


def same_name(a: Name, b: Name) -> bool:
    return a.further == b.further and trades_agree(a.trade, b.trade) and cores_alike(a, b)


def name_key(n: Name) -> str:
    """A name as one text; equal texts are equal names."""
    return "|".join((" ".join(n.core), n.given, " ".join(n.trade), " ".join(n.further)))


@lru_cache(maxsize=200_000)
def name_of(key: str) -> Name:
    core, given, trade, further = key.split("|")
    return Name(tuple(core.split()), given, tuple(trade.split()), tuple(further.split()))


def block_keys(n: Name) -> list[tuple[str, bool]]:
    """Keys under which a name meets others: phonetic codes of its sorted words; and whether it is written as one word.

    Of two words one may be misspelt or cut short, so each word's code stands with the initial of the other. A name in one
    piece has the beginnings and ends of its code, under which it meets the same ends of names in two words,
    written together in either order.
    """
    words = [w for w in n.core if len(w) > 3]
    tail = "/" + " ".join(n.further)
    out: set[tuple[str, bool]] = set()
    if len(n.core) == 2:
        a, b = sorted(n.core)
        for x, y in ((a, b), (b, a)):
            if len(x) > 3:
                out.add(("w" + sound(x) + y[0] + tail, False))
        for j in (n.core[0] + n.core[1], n.core[1] + n.core[0]):
            for k in _ends(j):
                out.add((k + tail, False))
    elif n.core:
        for k in _ends("".join(n.core)):
            out.add((k + tail, True))
        if len(n.core) > 2:  # a word may be torn, or an initial stand for a given name
            for i in range(len(n.core) - 1):
                two = [*n.core[:i], n.core[i] + n.core[i + 1], *n.core[i + 2 :]]
                if len(two) == 2:
                    for x, y in (two, two[::-1]):
                        if len(x) > 3:
                            out.add(("w" + sound(x) + y[0] + tail, False))
            for i in range(len(words)):
                for j in range(len(words)):
                    if i != j:
                        out.add(("w" + sound(words[i]) + words[j][0] + tail, False))
        else:
            out.add(("o" + sound(n.core[0]) + tail, False))
            if len(n.core[0]) >= 8:
                for k in (1, 3):  # a first word cut short and written together with the next
                    out.add(("w" + sound(n.core[0][k:]) + n.core[0][0] + tail, False))
    return sorted(out)


def _ends(joined: str) -> list[str]:
    s = sound(joined)
    return ["b" + s[:5], "e" + s[-5:]]
