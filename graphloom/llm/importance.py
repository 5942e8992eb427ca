"""Resampling by importance: documents drawn like a target by hashed n-gram features.

The texts of a batch are joined with sentinels and one regex pass finds all words.
Document offsets, searched in order, give each word its document and mask the n-grams
that would cross a sentinel; bincount adds up buckets and gains. The checksum of an
n-gram is put together from those of its words, so no n-gram is ever built as a string.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.bytewords import Texts, slices
from graphloom.llm.common import free, schema_of, text_function, text_of
from graphloom.session import written

#: Stands between the texts of a batch; no byte of UTF-8.
SENTINEL = b"\xff"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xfe]+|\xff")


def _shift_tables(images: np.ndarray) -> np.ndarray:
    """4 x 256: what each byte of a checksum becomes, from what each bit becomes."""
    value = np.arange(256)
    out = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        out[bit // 8, (value >> (bit % 8)) & 1 == 1] ^= images[bit]
    return out


def _shifted(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


@lru_cache(maxsize=1024)
def _zeros(n: int) -> np.ndarray:
    """Tables that carry a CRC-32 over n bytes more: crc(a + b) is that of a, carried
    over len(b) bytes, xor that of b."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if n == 0:
        return _shift_tables(bits)
    if n == 1:
        return _shift_tables((bits >> np.uint32(8)) ^ _after_a_byte()[bits & 255])
    half = _zeros(n // 2)
    twice = _shifted(half, _shifted(half, bits))
    return _shift_tables(_shifted(_zeros(1), twice) if n % 2 else twice)


@lru_cache(maxsize=1)
def _after_a_byte() -> np.ndarray:
    """The register of CRC-32 after one byte, from zero."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> np.uint32(1)) ^ np.uint32(0xEDB88320), value >> np.uint32(1))
    return value


class Features(NamedTuple):
    doc: np.ndarray  # text of each n-gram
    bucket: np.ndarray
    words: np.ndarray  # words of each text


def features(t: Texts, n: int = 2, buckets: int = 10_000) -> Features:
    """All runs of 1 to n consecutive words, with the bucket of their checksum."""
    data = t.buf.tobytes().translate(_LOWER)
    size = len(t.offsets) - 1
    joined = SENTINEL.join([data[a:b] for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True)])
    coded = pa.array(_WORD.findall(joined), pa.large_binary()).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = coded.dictionary.to_pylist()
    mark = names.index(SENTINEL) if SENTINEL in names else -1
    is_word = code != mark
    offsets = np.nonzero(~is_word)[0]  # of the documents, counted in tokens
    doc = np.searchsorted(offsets, np.nonzero(is_word)[0], "right")
    code = code[is_word]
    crc = np.array([zlib.crc32(w) for w in names], np.uint32)
    spaced = np.array([zlib.crc32(b" " + w) for w in names], np.uint32)
    length = np.array([len(w) + 1 for w in names], np.int64)
    docs, found = [doc], [crc[code]]
    last = found[0]
    for k in range(1, n):
        if len(code) <= k:
            break
        before, follows = last[: len(code) - k], code[k:]
        last = np.zeros(len(follows), np.uint32)
        order = np.argsort(length[follows], kind="stable")
        sizes, starts = np.unique(length[follows][order], return_index=True)
        for more, a, b in zip(sizes, starts, [*starts[1:], len(order)], strict=True):
            rows = order[a:b]
            last[rows] = _shifted(_zeros(int(more)), before[rows]) ^ spaced[follows[rows]]
        inside = doc[k:] == doc[:-k]
        docs.append(doc[k:][inside])
        found.append(last[inside])
    return Features(np.concatenate(docs), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.bincount(doc, minlength=size))


def bucket_counts(docs: DataFrame, n: int = 2, buckets: int = 10_000, text: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket. Each task sends one row per
    bucket it met; the driver gets `buckets` numbers, whatever the corpus."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, t in slices(batch.column(0)):
                total += np.bincount(features(t, n, buckets).bucket, minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    rows = docs.select(text_of(text).alias("text")).mapInArrow(run, schema_of("bucket long, n long")).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, count in rows.collect():  # at most `buckets` rows
        out[bucket] = count
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the smoothed share in the target over that in the source)."""
    s, t, size = source.astype(float), target.astype(float), len(source)
    return np.floor(scale * np.log(((t + 1) * (s.sum() + size)) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weigh(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, text: str = "text", into: str = "_importance") -> DataFrame:
    """docs with one more column `into`: a struct of n_words, n_features and weight, the
    floored mean gain of the text's features (0 where there are none).

    Source counts come from all docs and target counts from all rows of `target`, whole
    texts, null ones as empty. Repeated rows count each time. An empty target or empty
    docs leave smoothed shares. Other columns pass through; an own column of the name
    `into` is an error."""
    if into in docs.columns:
        raise ValueError(f"docs has a column {into} already; name another with into=")
    gain = gains(bucket_counts(docs, n, buckets, text), bucket_counts(target, n, buckets, text))

    def run(t: Texts):
        f = features(t, n, buckets)
        size = len(t.offsets) - 1
        count = np.bincount(f.doc, minlength=size)
        total = np.bincount(f.doc, gain[f.bucket].astype(float), size).astype(np.int64)  # whole numbers below 2**53
        return {"n_words": f.words, "n_features": count, "weight": np.where(count > 0, total // np.maximum(count, 1), 0)}

    return docs.withColumn(into, text_function("n_words long, n_features long, weight long", run)(text_of(text)))


def noise(key: Column, seed: int, scale: int = 1000) -> Column:
    """Gumbel noise from the first 8 hex digits of sha256("seed:key"), in 1/scale."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(weighed: DataFrame, share: int = 25, least_words: int = 20, seed: int = 7, key: str = "doc_id", into: str = "_importance") -> DataFrame:
    """weighed (the result of `weigh`) with score (weight plus noise of the key) and rank
    added to the struct `into`.

    Of the N rows of `least_words` words or more, the floor(share * N / 100) highest
    scores are drawn, ties to the smaller key (null keys first, then by what else the
    struct holds); rank counts them from 1, other rows have null. Rows that are equal in
    all of that are told apart by place only. Scores are whole numbers in a range that
    the logarithms of the counts bound (below 100,000 different ones at any size), so
    what stands before a score is a small table and each score is ranked by itself. The
    frame is kept as a table in the shared folder."""
    own = F.col(into)
    scored = weighed.withColumn(into, F.struct(own["n_words"].alias("n_words"), own["n_features"].alias("n_features"), own["weight"].alias("weight"),
                                               (own["weight"] + noise(F.col(key), seed)).alias("score")))
    scored = written(scored, "importance")
    enough = F.col(f"{into}.n_words") >= least_words
    counts = scored.where(enough).groupBy(F.col(f"{into}.score").alias("score")).agg(F.count("*").alias("n")).collect()
    counts.sort(key=lambda r: -r[0])
    take = share * sum(r[1] for r in counts) // 100
    above, so_far = [], 0
    for points, n in counts:
        if so_far >= take:
            break
        above.append((points, so_far))
        so_far += n
    lowest = above[-1][0] if above else None

    def ranked(df: DataFrame, rank: Column) -> DataFrame:
        fields = [F.col(into)[f].alias(f) for f in ("n_words", "n_features", "weight", "score")]
        return df.withColumn(into, F.struct(*fields, rank.alias("rank"))).select(*scored.columns)

    none = F.lit(None).cast("long")
    if lowest is None:
        return ranked(scored, none)
    top = enough & (F.col(f"{into}.score") >= lowest)
    value, before_it, place = free(scored, "_value", "_before", "_place")
    before = F.broadcast(scored.sparkSession.createDataFrame(above, schema_of(f"{value} long, {before_it} long")))
    inside = Window.partitionBy(F.col(f"{into}.score")).orderBy(F.col(key).asc_nulls_first(), *[F.col(f"{into}.{f}") for f in ("weight", "n_words", "n_features")])
    placed = scored.where(top).withColumn(place, F.row_number().over(inside))
    placed = placed.join(before, F.col(f"{into}.score") == F.col(value))
    rank = F.col(before_it) + F.col(place)
    return ranked(placed, F.when(rank <= take, rank)).unionByName(ranked(scored.where(~top), none))
