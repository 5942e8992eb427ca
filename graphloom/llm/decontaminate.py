"""Benchmark decontamination: word n-grams seed pairs, local alignment scores them.

One pass over the documents finds places of the benchmark's n-grams and keeps the words
round them. Every n-gram of an item that occurs there pairs the passage with the item;
Smith-Waterman over words scores each pair, so edited and paraphrased copies count by
what is left of the item. Pairs with too few words in common for the score asked are
left before they are aligned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import bytewords as bw
from graphloom.llm.common import free, schema_of, text_function, text_of
from graphloom.session import written

#: Texts come in lower case; ASCII marks part words.
PLAIN = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)], np.uint8)


def plain_words(t: bw.Texts) -> tuple[bw.Texts, bw.Spans]:
    plain = bw.Texts(PLAIN[t.buf], t.offsets)
    return plain, bw.words(plain)


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """item_id, _item (its words), _words (how many), _grams (hashes of its n-grams)."""

    def run(t: bw.Texts):
        plain, w = plain_words(t)
        g, at = bw.grams(plain.hashes(w.start, w.end), w.doc, n)
        rows, counts = [], np.bincount(w.doc, minlength=len(t.offsets) - 1)
        cuts = np.searchsorted(w.doc[at], np.arange(len(t.offsets)))
        texts = []
        for i in range(len(t.offsets) - 1):
            rows.append(np.unique(g[cuts[i] : cuts[i + 1]]).view(np.int64))
            texts.append(" ".join(plain.buf[plain.offsets[i] : plain.offsets[i + 1]].tobytes().decode().split()))
        return {"item": texts, "words": counts, "grams": rows}

    got = items.withColumn("_i", text_function("item string, words long, grams array<long>", run)(F.lower(text_of())))
    return got.select("item_id", F.col("_i.item").alias("_item"), F.col("_i.words").alias("_words"), F.col("_i.grams").alias("_grams"))


def _regions(docs: DataFrame, bitmap, n: int, reach: int) -> DataFrame:
    """Passages with words `reach` before and after each hit of the bitmap."""
    schema = T.StructType([*docs.select("doc_id", "_th").schema.fields, *schema_of("_start long, _text string, _grams array<long>").fields])

    def run(batches):
        bits = bitmap.value
        mask = np.uint64(8 * len(bits) - 1)
        for batch in batches:
            ids, ths = batch.column(0), batch.column(1)
            for first, _, t in bw.slices(batch.column(2)):
                plain, w = plain_words(t)
                g, at = bw.grams(plain.hashes(w.start, w.end), w.doc, n)
                slot = (g & mask).astype(np.int64)
                hit = np.nonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)[0]
                if not len(hit):
                    continue
                g, at = g[hit], at[hit]
                cut = np.nonzero((np.diff(at) > 2 * reach) | (np.diff(w.doc[at]) > 0))[0] + 1
                ends = np.searchsorted(w.doc, np.arange(len(t.offsets)))
                rows, starts, texts, grams = [], [], [], []
                for a, b in zip([0, *cut], [*cut, len(at)], strict=True):
                    doc = w.doc[at[a]]
                    low, high = max(at[a] - reach, ends[doc]), min(at[b - 1] + n + reach, ends[doc + 1])
                    rows.append(first + doc)
                    starts.append(low - ends[doc])
                    texts.append(" ".join(plain.buf[w.start[low] : w.end[high - 1]].tobytes().decode().split()))
                    grams.append(g[a:b].view(np.int64))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([ids.take(take), ths.take(take), pa.array(starts, pa.int64()), pa.array(texts, pa.string()),
                                                  pa.array(grams, pa.list_(pa.int64()))], names=schema.names)

    return docs.select("doc_id", "_th", "text").mapInArrow(run, schema)


def align(passage: list[str], item: list[str], match: float = 2, mismatch: float = -1, gap: float = -1) -> tuple[float, int, int]:
    """Best local alignment: score over that of the whole item, and the passage's words
    [start, end) it spans. The gap along a row is a running maximum."""
    if not passage or not item:
        return 0.0, 0, 0
    number: dict[str, int] = {}
    x = np.array([number.setdefault(w, len(number)) for w in passage])
    rise = -gap * np.arange(len(x) + 1)
    row, begin = np.zeros(len(x) + 1), np.arange(len(x) + 1)
    best = (0.0, 0, 0)
    for w in item:
        gain = np.where(x == number.get(w, -1), match, mismatch)
        new, start = np.zeros(len(x) + 1), np.arange(len(x) + 1)
        diagonal, up = row[:-1] + gain, row[1:] + gap
        take = diagonal >= up
        step = np.where(take, diagonal, up)
        keep = step > 0
        new[1:] = np.where(keep, step, 0)
        start[1:] = np.where(keep, np.where(take, begin[:-1], begin[1:]), start[1:])
        lifted = new + rise
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(len(top)), 0))
        slid = top - rise
        better = slid > new
        row, begin = np.where(better, slid, new), np.where(better, start[source], start)
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (float(row[k]), int(begin[k]), k)
    return best[0] / (match * len(item)), best[1], best[2]


def reach_of(passage: list[str], item: list[str], least: float) -> tuple[int, int]:
    """Words [low, high) of the passage outside which no alignment reaches `least`; low
    is high if none can. An alignment of m matches over p words of the passage scores
    3m - p at most, and m is no more than the item's words: it needs least * len(item)
    matches within (3 - 2 * least) * len(item) words."""
    number: dict[str, int] = {}
    mine = np.array([number.setdefault(w, len(number)) for w in item], np.int64)
    x = np.array([number.get(w, -1) for w in passage], np.int64)
    need, wide = least * len(item) - 1e-9, int((3 - 2 * least) * len(item) + 1e-9)
    at = np.nonzero(x >= 0)[0]
    if not len(item) or len(at) < need or wide < 1:
        return 0, 0
    # A word counts in the windows that hold fewer of its kind before it than the item has.
    at = at[np.argsort(x[at], kind="stable")]
    back = np.arange(len(at)) - np.bincount(mine)[x[at]]
    same = (back >= 0) & (x[at[back]] == x[at])
    first = np.maximum(np.where(same, at[back] + 1, 0), np.maximum(at - wide + 1, 0))
    change = np.bincount(first, minlength=len(x) + 1) - np.bincount(at + 1, minlength=len(x) + 1)
    starts = np.nonzero(np.cumsum(change)[:-1] >= need)[0]
    return (int(starts[0]), min(len(x), int(starts[-1]) + wide)) if len(starts) else (0, 0)


SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _aligned(least: float):
    def run(passages: pa.Array, items: pa.Array) -> pa.Array:
        got = []
        for a, b in zip(passages.to_pylist(), items.to_pylist(), strict=True):
            passage, item = a.split(), b.split()
            low, high = reach_of(passage, item, least)
            score, start, end = align(passage[low:high], item)
            got.append((score, start + low, end + low))
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()),
                                           pa.array([g[2] for g in got], pa.int64())], names=["score", "start", "end"])

    run.__annotations__ = {"passages": pa.Array, "items": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, SCORED).asNondeterministic()


def leaks(docs: DataFrame, items: DataFrame, n: int = 3, least: float = 0.6, bits: int = 1 << 26) -> DataFrame:
    """One row per (doc_id, text, item_id) whose best passage reaches `least` of the
    item's own score: doc_id, _th (hash of the text), item_id, score, first_word, end_word.

    Null texts are empty; items without an item_id are searched too, as one item_id
    (null). Other columns are left out; rows of no docs or no items give none. Items of fewer than n words, and texts of fewer, match
    nothing. Repeated rows of one document give one row per item. Seeds are all n-grams
    of an item, however frequent they are, so a copy needs one run of n words unchanged.
    What goes to all tasks is a bitmap of `bits` bits, whatever the size of the benchmark."""
    spark = docs.sparkSession
    known = item_grams(items.select("item_id", "text"), n).withColumn("_item_row", F.monotonically_increasing_id())
    known = written(known, "bench-items")
    seeds = known.select("_item_row", F.explode("_grams").alias("_gram"))
    reach = int(known.agg(F.max("_words")).first()[0] or 0) + n
    slots = seeds.select(F.col("_gram").bitwiseAND(bits - 1).alias("_slot"))
    words = slots.groupBy(F.shiftright("_slot", 6).alias("_at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot & 63 as int))")).alias("_set"))
    table = np.zeros(bits // 64, np.int64)
    for at, value in words.collect():  # at most bits / 64 rows, however large the benchmark
        table[at] = value
    table = table.view(np.uint8)
    bitmap = spark.sparkContext.broadcast(table)
    found = _regions(docs.select("doc_id", F.xxhash64(text_of()).alias("_th"), F.lower(text_of()).alias("text")), bitmap, n, reach)
    regions = written(found.withColumn("_rid", F.monotonically_increasing_id()), "bench-regions")
    hits = regions.select("_rid", F.explode("_grams").alias("_gram"))
    pairs = hits.join(seeds, "_gram").select("_rid", "_item_row").distinct()
    texts = pairs.join(regions.select("_rid", "doc_id", "_th", "_start", "_text"), "_rid").join(known.select("_item_row", "item_id", "_item"), "_item_row")
    texts = texts.repartition("_rid", "_item_row")  # one hot item lies in many tasks
    got = texts.withColumn("_a", _aligned(least)("_text", "_item")).where(F.col("_a.score") >= least)
    best = F.max(F.struct(F.col("_a.score").alias("score"), (-(F.col("_a.start") + F.col("_start"))).alias("s"), (F.col("_a.end") + F.col("_start")).alias("e")))
    out = got.groupBy("doc_id", "_th", "item_id").agg(best.alias("_b"))
    return out.select("doc_id", "_th", "item_id", F.col("_b.score").alias("score"), (-F.col("_b.s")).alias("first_word"), F.col("_b.e").alias("end_word"))


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs less those that hold an item. Null and empty texts hold none and stay, as do
    all rows where there are no items; repeated rows stay or go together; all columns
    pass through."""
    th, ident, text_hash = free(docs, "_th", "_id", "_h")
    gone = leaks(docs.select("doc_id", "text"), items, **options).select(F.col("doc_id").alias(ident), F.col("_th").alias(text_hash)).distinct()
    rest = docs.withColumn(th, F.xxhash64(text_of()))
    return rest.join(gone, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(th) == F.col(text_hash)), "left_anti").select(*docs.columns)
