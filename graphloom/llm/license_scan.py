"""Fuzzy search for short licence notices: exact seeds, then bounded-error matching.

A notice of k allowed edits is cut into k + 1 pieces, so at least one of them stands
unchanged in any text within k edits (pigeonhole). The pieces are looked up with one
automaton; round each hit the bounded-error matching of the regex library is put to
every run of whole words of a fitting length, and says how many edits it takes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.bytewords import Texts
from graphloom.llm.common import text_function, text_of


class Notice(NamedTuple):
    label: str
    phrase: str  # lower-case words, one space between
    edits: int  # characters that may differ
    fixed: str = ""  # words of the phrase that must stand unchanged: they name the licence
    base: bool = False


# The notices and their labels.
NOTICES = (
    Notice("mit", "under the mit license", 3, "mit", True),
    Notice("apache-2", "apache license version 2", 4, "2", True),
    Notice("cc-by-nc", "cc by nc", 0, "", True),
    Notice("gpl-3", "gnu general public license version 3", 5, "general 3"),
    Notice("gpl-2", "gnu general public license version 2", 5, "general 2"),
    Notice("lgpl", "gnu lesser general public license", 4, "lesser"),
    Notice("agpl", "gnu affero general public license", 4, "affero"),
    Notice("mpl", "mozilla public license", 3, "mozilla"),
    Notice("epl", "eclipse public license", 3, "eclipse"),
    Notice("boost", "boost software license", 3, "boost"),
    Notice("bsd", "redistribution and use in source and binary forms", 6),
    Notice("mit-text", "permission is hereby granted free of charge", 5),
    Notice("unlicense", "this is free and unencumbered software", 4),
    Notice("cc-by", "creative commons attribution", 3, "commons"),
    Notice("all-rights-reserved", "all rights reserved", 2),
)

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def pieces(phrase: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): the phrase cut into k + 1 parts of nearly equal length."""
    ends = [len(phrase) * (i + 1) // (k + 1) for i in range(k + 1)]
    return [(a, phrase[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=8)
def _tools(notices: tuple[Notice, ...]):
    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, notice in enumerate(notices):
        for offset, piece in pieces(notice.phrase, notice.edits):
            seeds.setdefault(piece, []).append((i, offset))
    finder = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        finder.add_word(piece, (len(piece), uses))
    finder.make_automaton()
    # One pattern per number of edits: the first that matches a run whole says how far it is.
    fuzzy = [[regex.compile(rf"(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={k}}}") for k in range(1, n.edits + 1)] for n in notices]
    return finder, [[f" {word} " for word in n.fixed.split()] for n in notices], fuzzy


def _spaces(text: str, low: int, high: int) -> list[int]:
    """Places of the spaces in text[low:high]."""
    out, at = [], text.find(" ", max(0, low), high)
    while at >= 0:
        out.append(at)
        at = text.find(" ", at + 1, high)
    return out


def scan(words: list[bytes], notices: tuple[Notice, ...] = NOTICES) -> list[tuple[str, int, int, int, float, bool]]:
    """(label, first word, words, edits, similarity, exact place of a base phrase)."""
    finder, fixed, fuzzy = _tools(notices)
    text = " " + b" ".join(words).decode("latin-1") + " "
    found, places = [], set()
    for end, (length, uses) in finder.iter(text):
        at = end - length + 1
        for i, offset in uses:
            notice = notices[i]
            start = at - offset
            size = len(notice.phrase)
            if start > 0 and text.startswith(f" {notice.phrase} ", start - 1):
                if offset == 0:
                    found.append((i, start, start + size, 0))
            elif notice.edits:
                places.add((i, start))
    close, seen = [], set()
    for i, start in places:
        phrase, edits = notices[i].phrase, notices[i].edits
        size = len(phrase)
        if any(text.find(word, max(0, start - edits - 1), start + size + edits + 1) < 0 for word in fixed[i]):
            continue
        ends = _spaces(text, start + size - edits, start + size + edits + 1)
        for a in _spaces(text, start - edits - 1, start + edits):
            for b in ends:
                if abs(b - a - 1 - size) <= edits and (i, a, b) not in seen:
                    seen.add((i, a, b))
                    if all(text.find(word, a, b + 1) >= 0 for word in fixed[i]):
                        if fuzzy[i][-1].fullmatch(text, a + 1, b):
                            far = next(k for k, pattern in enumerate(fuzzy[i], 1) if pattern.fullmatch(text, a + 1, b))
                            close.append((far, a + 1, b, i))
    taken: dict[int, list[tuple[int, int]]] = {}
    for i, a, b, _ in found:
        taken.setdefault(i, []).append((a, b))
    for far, a, b, i in sorted(close):  # the nearest first, then the first
        spans = taken.setdefault(i, [])
        at = bisect_left(spans, (b,))  # spans of a notice start and end in the same order
        if not (at and spans[at - 1][1] > a):
            insort(spans, (a, b))
            found.append((i, a, b, far))
    if not found:
        return []
    starts, place = [], 1
    for w in words:
        starts.append(place)
        place += len(w) + 1
    out = []
    for i, a, b, edits in sorted(found, key=lambda f: (f[1], notices[f[0]].label)):
        first = bisect_right(starts, a) - 1
        count = bisect_right(starts, max(a, b - 1)) - first
        n = notices[i]
        out.append((n.label, first, count, edits, max(0.0, 1 - edits / len(n.phrase)), n.base and edits == 0))
    return out


MATCH = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("word", T.LongType()), T.StructField("words", T.LongType()),
    T.StructField("edits", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("base", T.BooleanType()),
])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(MATCH))])
_FIELDS = [f.name for f in MATCH]


def find_notices(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, into: str = "_notices", text: str = "text") -> DataFrame:
    """docs with one more column: a struct of n_words and all matches in text order.

    Null texts are empty: no words, no matches. Each exact place counts, a bounded-error
    match only where no exact or nearer match of its notice overlaps it. Other columns pass through."""

    def run(t: Texts):
        data, counts, matches = t.buf.tobytes(), [], []
        for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True):
            found = data[a:b].translate(_WORD).split()
            counts.append(len(found))
            matches.append([dict(zip(_FIELDS, m, strict=True)) for m in scan(found, notices)])
        return {"n_words": counts, "matches": matches}

    return docs.withColumn(into, text_function(RESULT, run)(text_of(text)))
