"""Personal data: patterns, and a linear-chain conditional random field over word shapes.

The field is trained from a small labelled table (lines with marked spans) by gradient
descent on its exact likelihood, and decoded by Viterbi over all lines of a batch at
once, one array step per word position.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import bytewords as bw
from graphloom.llm.common import smallest, text_function, text_of

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("other", *KINDS)

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DATE = re.compile(r"(?<![0-9])[12][0-9]{3}-[01]?[0-9]-[0-3]?[0-9](?![0-9])")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    """Matches of EMAIL, tried only at the left end of the run before each '@'."""
    place = at = 0
    while (at := text.find("@", at)) >= 0:
        left = at
        while left > place and (c := text[left - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            left -= 1
        m = EMAIL.match(text, left) if left < at else None
        if m:
            yield m.span()
            place = at = m.end()
        else:
            at += 1


def _byte(digits: str) -> bool:
    """A number of 0 to 255, with any number of leading zeros."""
    left = digits.lstrip("0")
    return len(left) <= 3 and int(left or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping matches of each kind in the order of KINDS, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# --- shapes -----------------------------------------------------------------------------

_IS = {name: np.isin(np.arange(256), list(chars)) for name, chars in {
    "digit": b"0123456789", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "at": b"@", "dot": b".", "plus": b"+",
    "dash": b"-", "paren": b"()", "equal": b"=", "quote": b"\"'", "colon": b":", "other": bytes(range(128, 256))}.items()}
_STEPS = {"digit": (1, 2, 3, 4, 5, 7, 9, 12, 13, 16, 17, 20), "upper": (1, 2, 12), "lower": (1, 4), "dot": (1, 2, 3, 4), "dash": (1, 2), "paren": (1, 2)}
_LENGTH = (2, 3, 4, 5, 7, 9, 13, 16, 17, 20, 26, 40)
_WIDTH = {name: len(_STEPS.get(name, (1,))) + 1 for name in _IS} | {"length": len(_LENGTH) + 1, "first": 6}
FEATURES = sum(_WIDTH.values())
#: A pause after the word, so that what follows it seldom goes on with the same item.
_TRIM = b",.;:!?\"')]}"


def shape_codes(t: bw.Texts, w: bw.Spans) -> np.ndarray:
    """One integer per word that holds all its shape features, in mixed radix."""
    code = np.zeros(len(w.start), np.int64)
    # Words such as "and": only letters, no sign in reach of any test; most of a text.
    for name, chars in _IS.items():
        sums = np.concatenate([[0], np.cumsum(chars[t.buf], dtype=np.int32)])
        code = code * _WIDTH[name] + np.searchsorted(_STEPS.get(name, (1,)), sums[w.end] - sums[w.start], "right")
    code = code * _WIDTH["length"] + np.searchsorted(_LENGTH, w.end - w.start, "right")
    first = t.buf[w.start] if len(w.start) else np.zeros(0, np.uint8)
    kind = np.select([_IS["digit"][first], _IS["upper"][first], _IS["lower"][first], _IS["plus"][first], _IS["paren"][first] | _IS["quote"][first]], [0, 1, 2, 3, 4], 5)
    return code * _WIDTH["first"] + kind


def unpack(codes: np.ndarray) -> np.ndarray:
    """The 0/1 features of shape codes, one row each."""
    parts = []
    for width in reversed(_WIDTH.values()):
        parts.append(np.eye(width, dtype=np.float32)[codes % width])
        codes = codes // width
    return np.hstack(parts[::-1]) if len(codes) else np.zeros((0, FEATURES), np.float32)


class Field(NamedTuple):
    """Weights: of the word before, the word itself and the word after by label; of
    label pairs; of first labels."""

    shape: np.ndarray  # 3 x FEATURES x labels
    pair: np.ndarray
    first: np.ndarray


# --- training ---------------------------------------------------------------------------

def _padded(codes: list[np.ndarray], labels: list[np.ndarray]):
    n, longest = len(codes), max(map(len, codes))
    x = np.zeros((n, longest + 2, FEATURES), np.float32)
    y, real = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (c, z) in enumerate(zip(codes, labels, strict=True)):
        x[i, 1 : len(c) + 1] = unpack(c)
        y[i, : len(c)] = z
        real[i, : len(c)] = True
    return np.concatenate([x[:, :-2], x[:, 1:-1], x[:, 2:]], axis=2), y, real


def _sum_exp(a, axis):
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(codes: list[np.ndarray], labels: list[np.ndarray], rounds: int = 80, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam over the whole small table.
    An empty table gives the field that labels everything `other`."""
    k = len(LABELS)
    if not codes:
        first = np.zeros(k)
        first[0] = 10.0
        return Field(np.zeros((3, FEATURES, k), np.float32), np.tile(first, (k, 1)).astype(np.float32), first.astype(np.float32))
    x, y, real = _padded(codes, labels)
    n, steps, width = x.shape
    used = np.nonzero(x.any(axis=(0, 1)))[0]
    x = np.ascontiguousarray(x[:, :, used]).reshape(n * steps, -1)
    weights = [np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)]
    memory = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    gold = np.eye(k)[y] * real[:, :, None]
    gold_pairs = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    for step in range(1, rounds + 1):
        w, pair, start = weights
        e = (x @ w.astype(np.float32)).reshape(n, steps, k).astype(float)
        alpha, beta = np.zeros((n, steps, k)), np.zeros((n, steps, k))
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, steps):
            go = _sum_exp(alpha[:, t - 1, :, None] + pair, 1) + e[:, t]
            alpha[:, t] = np.where(real[:, t, None], go, alpha[:, t - 1])
        total = _sum_exp(alpha[:, -1], 1)
        pairs = np.zeros((k, k))
        for t in range(steps - 2, -1, -1):
            back = _sum_exp(pair + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(real[:, t + 1, None], back, 0.0)
            both = alpha[:, t, :, None] + pair + (e[:, t + 1] + beta[:, t + 1])[:, None, :] - total[:, None, None]
            pairs += (np.exp(both) * real[:, t + 1, None, None]).sum(axis=0)
        marginal = np.exp(alpha + beta - total[:, None, None]) * real[:, :, None]
        slopes = [x.T @ (marginal - gold).reshape(n * steps, k).astype(np.float32), pairs - gold_pairs, (marginal[:, 0] - gold[:, 0]).sum(axis=0)]
        for i, slope in enumerate(slopes):
            slope = slope / n + decay * weights[i]
            m, v = memory[i]
            m[:] = 0.9 * m + 0.1 * slope
            v[:] = 0.99 * v + 0.01 * slope * slope
            weights[i] = weights[i] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    shape = np.zeros((width, k), np.float32)
    shape[used] = weights[0]
    return Field(shape.reshape(3, FEATURES, k), weights[1].astype(np.float32), weights[2].astype(np.float32))


# --- decoding ---------------------------------------------------------------------------

def decode(field: Field, codes: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The most likely labels of all words; `line` numbers the sequence of each word
    (non-decreasing). All sequences advance together, longest first."""
    if not len(codes):
        return np.zeros(0, np.int8)
    kinds, of = np.unique(codes, return_inverse=True)
    before, own, after = (unpack(kinds) @ field.shape[i] for i in range(3))
    e = own[of]
    inner = line[1:] == line[:-1]
    e[1:] += before[of[:-1]] * inner[:, None]
    e[:-1] += after[of[1:]] * inner[:, None]
    starts = np.concatenate([[0], np.nonzero(~inner)[0] + 1])
    length = np.diff(np.concatenate([starts, [len(codes)]]))
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    alive = len(starts) - np.searchsorted(length[::-1], np.arange(length[0]), "right")
    score = field.first + e[starts]
    ways = np.zeros(e.shape, np.int8)
    finals = np.zeros(len(starts), np.int8)
    flat = np.ascontiguousarray(field.pair.T)  # to x from
    for t in range(1, length[0]):
        m = alive[t]
        if m < len(score):
            finals[m : len(score)] = score[m:].argmax(axis=1)
            score = score[:m]
        options = score[:, None, :] + flat
        best = options.argmax(axis=2)
        ways[starts[:m] + t] = best
        score = np.take_along_axis(options, best[:, :, None], 2)[:, :, 0] + e[starts[:m] + t]
    finals[: len(score)] = score.argmax(axis=1)
    out = np.zeros(len(codes), np.int8)
    out[starts + length - 1] = finals
    now = finals.copy()
    for t in range(length[0] - 1, 0, -1):
        m = alive[t]
        at = starts[:m] + t
        now[:m] = ways[at, now[:m]]
        out[at - 1] = now[:m]
    return out


def lines_of(t: bw.Texts, w: bw.Spans) -> np.ndarray:
    """The line number of each word: lines end at newlines and at ends of texts."""
    edges = np.sort(np.concatenate([t.offsets[:-1], np.nonzero(t.buf == 10)[0]]))
    return np.searchsorted(edges, w.start, "right")


def field_spans(field: Field, t: bw.Texts) -> list[tuple[int, int, int, int]]:
    """(text, kind, start, end) in bytes: runs of words of one label, marks at the ends
    taken off."""
    w = bw.words(t)
    line = lines_of(t, w)
    label = decode(field, shape_codes(t, w), line)
    at = np.nonzero(label)[0]
    if not len(at):
        return []
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (label[at[1:]] != label[at[:-1]]) | (line[at[1:]] != line[at[:-1]])
    heads = np.nonzero(new)[0]
    tails = np.concatenate([heads[1:], [len(at)]]) - 1
    out = []
    for a, b in zip(at[heads], at[tails], strict=True):
        start, end = int(w.start[a]), int(w.end[b])
        while end > start and t.buf[end - 1] in _TRIM:
            end -= 1
        while start < end and t.buf[start] in b"\"'[{<":
            start += 1
        if end > start:
            out.append((int(w.doc[a]), int(label[a]), start, end))
    return out


# --- the labelled table -----------------------------------------------------------------

SECRET = re.compile(r"(?:password|passwd|secret|api_?key)\s?[=:]\s?\"?[0-9A-Za-z_/+-]{8,}\"?|token\s?[=:]\s?\"[0-9a-f]{16,}\"|\bAKIA[0-9A-Z]{12,}\b|\b[0-9a-f]{40}\b")
# A few marked lines for forms that the patterns reject or misread.
MARKED = (
    ("call me at [phone:(415) 555-2671] or [phone:415-555-2671] today", 6),
    ("my number is [phone:+1 (314) 555-6532] [card:4663622617512349] and so on", 8),
    ("reach us on [phone:+44 20 7946 0958] or [phone:+1 415 555 2671], she said", 6),
    ("[phone:+1 (882) 555-9672] [ip:61.131.143.218] [email:abc.12@mail1.example.com]", 6),
    ("the card [card:4111 1111 1111 1111] was lost, card [card:5500-0000-0000-0004] too", 6),
    ("host [ip:10.0.0.12:8080] and [ip:192.168.1.7] answered", 4),
    ("in 1999 he paid 1,200 or 3.14 for 12 of them, 45 percent", 8),
    ("version 2.0.1 of 2024-05-17 has 1234567 rows and 98765 lines", 8),
    ("Section 4. of chapter 12 on page 345 says so (see 7)", 6),
    ("Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", 6),
    ("+++ --- *** ### === (a) (b) + 1 + 2 = 3", 6),
)


def _marked() -> list[tuple[str, list[tuple[str, int, int]]]]:
    out = []
    for line, times in MARKED:
        text, spans = "", []
        for part in re.split(r"(\[[a-z]+:[^\]]*\])", line):
            m = re.fullmatch(r"\[([a-z]+):([^\]]*)\]", part)
            if m:
                spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2] if m else part
        out += [(text, spans)] * times
    return out


def labelled_lines(docs: DataFrame, most: int = 1_600, seed: int = 11, text: str = "text") -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table: different lines (two thirds with digits or '@', one third
    without; at most `most`) of 12 * most documents, those with the smallest hashes,
    marked by the base patterns and by SECRET, and the fixed marked lines."""
    whole = F.xxhash64(*[F.col(c) for c in ("doc_id", text) if c in docs.columns], F.lit(seed))
    line = F.explode(F.split(text_of(text), "\n")).alias("_line")
    some = smallest(docs, whole, 12 * most).select(line).where("length(_line) between 1 and 2000").distinct().withColumn("_odd", F.col("_line").rlike("[0-9@]"))
    key = F.xxhash64("_line", F.lit(seed))
    rows = [r[0] for odd, n in ((True, most * 2 // 3), (False, most // 3))
            for r in some.where(F.col("_odd") == odd).orderBy(key, "_line").limit(n).select("_line").collect()]
    out = _marked()
    for row in rows:
        marks = base_spans(row)
        for m in SECRET.finditer(row):
            if not any(a < m.end() and m.start() < b for _, a, b in marks):
                marks.append(("secret", *m.span()))
        out.append((row, marks))
    return out


def fit(lines: list[tuple[str, list[tuple[str, int, int]]]], reach: int = 8, **options) -> Field:
    """A field from marked lines; windows of `reach` words round each mark, and the
    first words of lines without one, are what it learns from."""
    codes, labels = [], []
    for text, marks in lines:
        raw = text.encode()
        t = bw.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        w = bw.words(t)
        if not len(w.start):
            continue
        place = np.cumsum((t.buf & 0xC0) != 0x80) - 1  # of each byte, in characters
        y = np.zeros(len(w.start), np.int64)
        for kind, a, b in marks:
            if kind in LABELS:
                y[(place[w.start] < b) & (place[w.end - 1] >= a)] = LABELS.index(kind)
        c = shape_codes(t, w)
        at = np.nonzero(y)[0]
        if not len(at):
            spans = [(0, 3 * reach)]
        else:
            heads = at[np.concatenate([[True], np.diff(at) > 2 * reach])]
            tails = at[np.concatenate([np.diff(at) > 2 * reach, [True]])]
            spans = [(max(0, a - reach), b + reach + 1) for a, b in zip(heads, tails, strict=True)]
        for a, b in spans:
            codes.append(c[a : min(b, a + 4 * reach)])
            labels.append(y[a : min(b, a + 4 * reach)])
    return train(codes, labels, **options)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
RESULT = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])


def plausible(kind: str, text: str) -> bool:
    """Exact check of what the field finds: digits of cards, phones and addresses."""
    digits = NOT_DIGIT.sub("", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not DATE.search(text)
    if kind == "ip":
        parts = text.split(":")[0].split(".")
        return len(parts) == 4 and all((p := NOT_DIGIT.sub("", part)) and _byte(p) for part in parts)
    name, at, host = text.partition("@")
    return kind != "email" or bool(at and name and host.strip("."))


def find(docs: DataFrame, field: Field, into: str = "_pii", text: str = "text") -> DataFrame:
    """docs with one more column: a struct with all spans (code points, end exclusive)
    by kind, then start. Spans of the field that fail `plausible` or touch a span of the
    patterns are left out: those stay as they are. Null and empty texts have none; other columns pass."""
    order = {k: i for i, k in enumerate(KINDS)}

    def run(t: bw.Texts):
        n = len(t.offsets) - 1
        found: list[list[tuple[str, int, int, bool]]] = [[] for _ in range(n)]
        has = t.total(_IS["digit"][t.buf] | _IS["at"][t.buf]) > 0
        for i in np.nonzero(has)[0]:
            found[i] = [(k, a, b, True) for k, a, b in base_spans(t.buf[t.offsets[i] : t.offsets[i + 1]].tobytes().decode())]
        chars = np.concatenate([[0], np.cumsum((t.buf & 0xC0) != 0x80)])
        for doc, label, start, end in field_spans(field, t):
            zero = chars[t.offsets[doc]]
            a, b = int(chars[start] - zero), int(chars[end] - zero)
            words = t.buf[start:end].tobytes().decode()
            if plausible(LABELS[label], words) and not any(base and p < b and a < q for _, p, q, base in found[doc]):
                found[doc].append((LABELS[label], a, b, False))
        rows = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in sorted(f, key=lambda s: (order[s[0]], s[1]))] for f in found]
        return {"spans": pa.array(rows, kind)}

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(RESULT["spans"].dataType)
    return docs.withColumn(into, text_function(RESULT, run)(text_of(text)))
