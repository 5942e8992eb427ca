"""Words, lines and their hashes for whole Arrow columns of text, as numpy arrays.

Words are the runs of bytes outside space and 0x09-0x0D. UTF-8 never uses those bytes
inside a longer character, so bytes do as well as characters. Hashes are polynomials
modulo 2**64 over random byte values, from prefix sums: no loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
UNBASE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = U(0xD6E8FEB86659FD93)
BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SLICE_BYTES = 2 << 20
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all bits."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> U(shift)
        h *= U(factor)
    return h ^ (h >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES)
        for name, base in (("up", BASE), ("down", UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


class Texts(NamedTuple):
    """Texts laid end to end: text i is buf[offsets[i]:offsets[i + 1]]."""

    buf: np.ndarray
    offsets: np.ndarray

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, "right") - 1

    def total(self, per_byte: np.ndarray) -> np.ndarray:
        """Sums of a value per byte by text."""
        sums = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = powers(len(self.buf) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[self.buf] * up[:-1], dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * STEP)


class Spans(NamedTuple):
    """Words or lines: byte places in Texts.buf and the text they stand in."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Runs of rows of about `most` bytes (one longer text is a run of its own); null
    counts as empty. Yields first row, row after the last, texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, Texts(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(t: Texts) -> Spans:
    inside = ~SPACE[t.buf]
    if not len(inside):
        return Spans(*(np.zeros(0, np.int64) for _ in range(3)))
    edge = np.zeros(len(inside) + 1, bool)
    edge[t.offsets] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    starts = np.nonzero(after & (~before | edge))[0]
    ends = np.nonzero(before & (~after | edge))[0]
    return Spans(starts, ends, t.doc_of(starts))


def lines(t: Texts) -> Spans:
    """The texts cut at each newline; an empty text is one empty line."""
    breaks = np.nonzero(t.buf == 10)[0]
    starts = np.sort(np.concatenate([t.offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([t.offsets[1:], breaks]), kind="stable")
    first = np.searchsorted(breaks, t.offsets)
    per_doc = first[1:] - first[:-1] + 1
    return Spans(starts, ends, np.repeat(np.arange(len(t.offsets) - 1), per_doc))


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, and the index of their first word."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * STEP + h[k : k + count]
    at = np.nonzero(doc[:count] == doc[n - 1 :])[0]
    return mix(out[at]), at


def covered(size: int, at: np.ndarray, n: int) -> np.ndarray:
    """Which of `size` places lie in a window of n that starts at one of `at`."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, np.minimum(at + n, size), 1)
    return np.cumsum(edge[:-1]) > 0


def repeated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which values occur twice or more in their text, first ones included."""
    key = mix(h + doc.astype(np.uint64) * BASE)
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order] = same[1:] | same[:-1]
    return out
