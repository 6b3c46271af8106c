"""Running English prose in documents and code comments, without licences, code, data and generated headers."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from typing import NamedTuple

# The most frequent words of English; prose has many of them whatever it is about.
FUNCTION = set("the a an any each every this that these those one its it is are was be been has have had of to in on at by for with from as and or but so if when while not no can may will their his her our your there which who".split())
# Wording of licences and of generated headers.
LEGAL = re.compile(r"\bcopyright\b|\(c\)|©|all rights reserved|\blicen[cs]|\bwarrant(?:y|ies)\b|\bfurnished\b|\bas is\b|\bliable\b|\bliability\b|\bredistribut|\bpermission is\b|\bhereby\b|\bthereof\b|\bconvey\b|spdx|\bno person may\b|merchantab|\bstatutory\b|\bsublicen|\bthe work\b")
LEGAL_HINTS = ("copyright", "(c)", "©", "rights reserved", "licen", "warrant", "furnish", "as is", "liab", "redistrib", "permission is", "hereby", "thereof", "convey", "spdx", "no person", "merchantab", "statutory", "the work")
MADE = re.compile(r"\bgenerated by\b|\bauto-?generated\b|\bdo not edit\b|\bchanges are lost\b|@generated")
MADE_HINTS = ("generated", "do not edit", "are lost")


def _notice(low: str) -> bool:
    """Wording of a licence or a generated header in a lower-case text."""
    return any(h in low for h in LEGAL_HINTS) and LEGAL.search(low) is not None or any(h in low for h in MADE_HINTS) and MADE.search(low) is not None


MARK = re.compile(r"^\s*(?:///?!?|//|/\*+!?|\*+/|\*(?!\*)|#+!?|--+|;+|%+|<!--|\"\"\"|'''|>|rem\b|\.\.)?\s*(?:[-+•]\s+|\d+[.)]\s+)?", re.I)
TAIL = re.compile(r"\s*(?:\*/|-->|\"\"\"|''')\s*$")
ASIDE = re.compile(r"\((?:see|cf|e\.g|i\.e|no|v)\b[^)]{0,30}\)")
INLINE = re.compile(r"`[^`]*`|\[[^\]]*\]\([^)]*\)|https?://\S+")
CODE = re.compile(r"[{}=<>\\|$^~@]|\(\)|\w\(|\w_\w|\]\s*[,;]|::|->|;\s*$")
# Words that begin a statement, and may begin a line of wrapped prose; and what tells the statement.
OPENS = re.compile(r"^\s*(?:import|from|return|package|using|include|def|class|public|private|static|func|fn|let|var|const)\b")
STATEMENT = re.compile(r"[\[\]]|[A-Za-z_]{2,}\.[A-Za-z_]{2,}|;\s*$")
SPOKEN = FUNCTION - set("a as from if or and not in for while with is on by at to no this but so when".split())  #: function words that are hardly ever words of code
WORD = re.compile(r"[a-z]+(?:['’-][a-z]+)*")
END = re.compile(r"[.!?;:](?=\s|$)")
FENCE = re.compile(r"^\s*(?:```|~~~)")


class Prose(NamedTuple):
    words: dict[str, int]
    n_words: int
    n_sentences: int
    n_commas: int
    n_letters: int


QUICK = re.compile(r"[{}=<>\\|$^~@_]|\(\)|\w\(|::|->")
LEAST_WORDS = 80  #: a document's level is that of at least so many words
RUNNING = 8  #: words that a paragraph has at least; fewer are a heading, a label or an item
COMMON = 0.15  #: least share of function words in a paragraph of English
WORD_LENGTH = 12  #: characters a blank, above which a line holds data or minified code


def _statement(line: str) -> bool:
    """Whether a line that begins like a statement is one: it has a mark of code, or neither a function word nor a full stop."""
    if not OPENS.match(line):
        return False
    words = line.lower().split()
    return STATEMENT.search(line) is not None or not any(w.strip(".,;:!?()'\"") in SPOKEN for w in words[1:]) and not (line.endswith(".") and len(words) > 3)


def _prose_line(line: str) -> bool:
    """Whether a line, without its comment marks, is part of running prose."""
    if CODE.search(line):
        if not line.endswith(";") or CODE.search(line[:-1]) or line.count(" ") < 3:
            return False
    if _statement(line):
        return False
    words = line.split()
    plain = 0
    for w in words:
        plain += w.isalpha() or w.strip(".,;:!?()'\"").replace("-", "").replace("'", "").isalpha()
    return plain >= 0.7 * len(words)


def paragraphs(text: str) -> list[str]:
    """Paragraphs of prose lines; marks of comments and lists are taken off, fenced code is left out."""
    out: list[str] = []
    now: list[str] = []
    fenced = False
    quick, mark, prose_line = QUICK.search, MARK.sub, _prose_line
    for line in text.split("\n"):
        if not line or "`" not in line and "http" not in line and quick(line) and "<!--" not in line or len(line) > 200 and line.count(" ") * WORD_LENGTH < len(line):
            keep = False  # blank, code, or minified
        elif FENCE.match(line):
            fenced, keep = not fenced, False
        elif fenced:
            keep = False
        else:
            body = mark("", line, count=1)
            if body.endswith(("*/", "-->", '"""', "'''")):
                body = TAIL.sub("", body)
            if "(" in body:
                body = ASIDE.sub(" ", body)
            if "`" in body or "http" in body or "](" in body:
                body = INLINE.sub(" ", body)
            body = body.strip()
            keep = bool(body) and prose_line(body)
        if keep:
            now.append(body)
        elif now:
            out.append(" ".join(now))
            now = []
    if now:
        out.append(" ".join(now))
    return out


def prose(text: str | None) -> Prose | None:
    """Counts over the running English prose of a text; null where there is none."""
    if not text:
        return None
    words: Counter[str] = Counter()
    n_sentences = n_commas = 0
    for p in paragraphs(text):
        low = p.lower()
        if _notice(low):
            kept = [x for x in re.split(r"(?<=[.!?])\s+", low) if not _notice(x)]
            if len(kept) < 3 or sum(map(len, kept)) < 0.5 * len(low):
                continue
            low = " ".join(kept)
        if not low.isascii():
            if sum(not c.isascii() for c in low) > 0.1 * len(low):
                continue
            low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
        found = WORD.findall(low)
        if len(found) < RUNNING or sum(map(FUNCTION.__contains__, found)) < COMMON * len(found):
            continue
        words.update(found)
        n_sentences += max(1, len(END.findall(low)))
        n_commas += low.count(",")
    n = sum(words.values())
    return Prose(dict(words), n, n_sentences, n_commas, sum(len(w) * k for w, k in words.items())) if n else None
