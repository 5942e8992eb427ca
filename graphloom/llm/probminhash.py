"""Near duplicates by ProbMinHash signatures, banding and exact verification.

Each distinct word shingle of weight w (its count) sends arrivals of a Poisson process
of rate w to the registers of its text; a register keeps the shingle that arrives first.
Two texts agree in a register with the probability Jaccard similarity of their weighted
shingles. A shingle stops when its next arrival is later than every register (early
termination). Registers are hashed in bands. Links are by plain Jaccard similarity, so a
text with repeated shingles also has the bands of a signature in which each weighs 1
(where none repeats, the two are the same). Texts that share a band are compared exactly,
and similar ones are joined into classes. Before a text is moved, its size, the shingles it
shares and the parities of its shingles by hash rule out pairs that can't be similar: these
are bounds, so no similar pair of a band is lost, however many texts meet there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import bytewords as bw
from graphloom.llm.common import free, text_function, text_of
from graphloom.session import written

U = np.uint64
#: Registers in a word of a sketch (four bits each), and in a deep key.
NIBBLES = 16
DEEP_KEYS = 160
#: Words of 64 parities of a text.
PARITIES = 32


def shingles(t: bw.Texts, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct n-word shingles; a text of 1 to n - 1 words is
    one shingle of all its words."""
    w = bw.words(t)
    h = t.hashes(w.start, w.end)
    g, at = bw.grams(h, w.doc, n)
    doc = w.doc[at]
    counts = np.bincount(w.doc, minlength=len(t.offsets) - 1)
    ends = np.cumsum(counts)
    short = np.nonzero((counts > 0) & (counts < n))[0]
    if len(short):
        whole = [bw.mix(np.array([np.add.reduce(h[ends[i] - counts[i] : ends[i]] * bw.powers(n)[0][: counts[i]]) + U(counts[i])]))[0] for i in short]
        g, doc = np.concatenate([g, np.array(whole, np.uint64)]), np.concatenate([doc, short])
    _, first, count = np.unique(bw.mix(g + doc.astype(np.uint64) * bw.BASE), return_index=True, return_counts=True)
    return doc[first], g[first], count


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """n_docs x registers: the shingle each register holds (0 for texts without any)."""
    time = np.full(n_docs * registers, np.inf)
    held = np.zeros(n_docs * registers, np.uint64)
    now, key, rate, base = np.zeros(len(doc)), shingle.copy(), weight.astype(float), doc.astype(np.int64) * registers
    value, turn = shingle, 0
    while len(now):
        block = int(np.clip(32768 // len(now), 1, 256))
        steps = bw.mix(key[:, None] + (np.arange(turn, turn + block, dtype=np.uint64) + U(1)) * bw.STEP)
        gaps = -np.log(((steps >> U(11)).astype(float) + 0.5) * 2.0**-53) / rate[:, None]
        arrive = now[:, None] + np.cumsum(gaps, axis=1)
        at = base[:, None] + ((steps & U(2047)) * U(0x9E3779B1) + (steps >> U(40)) & U(0xFFFFFF)).astype(np.int64) % registers
        flat, when = at.ravel(), arrive.ravel()
        early = when < time[flat]
        flat, when, who = flat[early], when[early], np.repeat(value, block)[early]
        np.minimum.at(time, flat, when)
        won = time[flat] == when
        held[flat[won]] = who[won]
        now, turn = arrive[:, -1], turn + block
        last = time.reshape(n_docs, registers).max(axis=1)
        alive = now < last[base // registers]
        now, key, rate, base, value = now[alive], key[alive], rate[alive], base[alive], value[alive]
    return held.reshape(n_docs, registers)


def band_keys(held: np.ndarray, bands: int) -> np.ndarray:
    n, registers = held.shape
    parts = held.reshape(n, bands, registers // bands)
    out = np.zeros((n, bands), np.uint64)
    for k in range(registers // bands):
        out = bw.mix(out * bw.STEP + parts[:, :, k])
    return (out + np.arange(bands, dtype=np.uint64) * bw.BASE).view(np.int64)


def sketches(held: np.ndarray) -> np.ndarray:
    """Four bits of each register, 16 registers in a word: unequal registers differ
    there 15 times in 16."""
    n, registers = held.shape
    nibbles = np.zeros((n, -(-registers // NIBBLES) * NIBBLES), np.uint64)
    nibbles[:, :registers] = bw.mix(held) & U(15)
    shifts = np.arange(NIBBLES, dtype=np.uint64) * U(4)
    return np.bitwise_or.reduce(nibbles.reshape(n, -1, NIBBLES) << shifts, axis=2).view(np.int64)


def parities(doc: np.ndarray, shingle: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs x PARITIES words: how many shingles of a text fall on each bit, modulo 2. Two
    texts differ in no more bits than there are shingles in just one of them."""
    width = PARITIES * 64
    at = doc.astype(np.int64) * width + (bw.mix(shingle) % U(width)).astype(np.int64)
    odd = (np.bincount(at, minlength=n_docs * width) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n_docs, width), axis=1).view(np.int64)


def alone(a: Column, b: Column) -> Column:
    """The shingles in just one of two texts are at least as many, as a column."""
    total = F.lit(0)
    for k in range(PARITIES):
        total = total + F.bit_count(a[k].bitwiseXOR(b[k]))
    return total


def most_differences(least: float, registers: int) -> int:
    """Sketches of texts with a similarity of `least` differ in more registers than this
    about three times in a million (4.5 deviations)."""
    p = (1 - least) * 15 / 16
    return int(np.ceil(registers * p + 4.5 * np.sqrt(registers * p * (1 - p))))


def differences(a: Column, b: Column, words: int) -> Column:
    """In how many registers two sketches differ, as a column."""
    total = F.lit(0)
    for k in range(words):
        z = a[k].bitwiseXOR(b[k])
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        total = total + F.bit_count(z.bitwiseAND(0x1111111111111111))
    return total


def deep_keys(sketch: np.ndarray, registers: int, keys: int = DEEP_KEYS, seed: int = 7) -> np.ndarray:
    """keys hashes of 16 registers each, drawn once for all texts. Texts of similarity
    0.8 share one of 160 in 99 cases of 100, those of 0.6 in seven."""
    n = len(sketch)
    shifts = np.arange(NIBBLES, dtype=np.uint64) * U(4)
    nibbles = ((sketch.view(np.uint64)[:, :, None] >> shifts) & U(15)).reshape(n, -1)
    rng = np.random.default_rng(seed)
    out = np.zeros((n, keys), np.uint64)
    apart = np.arange(1, keys + 1, dtype=np.uint64) * bw.BASE
    for k in range(keys):
        at = rng.choice(registers, min(NIBBLES, registers), replace=False)
        out[:, k] = bw.mix(np.bitwise_or.reduce(nibbles[:, at] << shifts[: len(at)], axis=1) + apart[k])
    return out.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of distinct hashes: what the signature finds is checked by this."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets (distinct hashes, counts): what registers estimate."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    # Sum over shared i of 1 / sum_j max(x_j / x_i, y_j / y_i): j with x_j / y_j at least
    # x_i / y_i count by x, the others by y. Ratios take few values.
    ratio = x / y
    kinds, of = np.unique(ratio, return_inverse=True)
    sum_x, sum_y = np.bincount(of, x), np.bincount(of, y)
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    above = np.cumsum(sum_x[::-1])[::-1] + only_x
    below = np.concatenate([[0], np.cumsum(sum_y)[:-1]]) + only_y
    return float((1 / (above[of] / x + below[of] / y)).sum())


def _similar(left: pa.Array, right: pa.Array) -> pa.Array:
    kept: dict[str, np.ndarray] = {}

    def of(text):
        if text not in kept:
            if len(kept) > 64:
                kept.clear()
            raw = np.frombuffer(text.encode(), np.uint8)
            kept[text] = shingles(bw.Texts(raw, np.array([0, len(raw)])))[1]
        return kept[text]

    return pa.array([jaccard(of(a.as_py()), of(b.as_py())) for a, b in zip(left, right, strict=True)], pa.float64())


_similar.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}


def classes(links: DataFrame) -> DataFrame:
    """(a, root): the smallest node each linked node reaches, by alternating star steps
    over (a, b); each step is a table in the shared folder."""
    edges, before = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links"), None
    while True:
        way = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = way.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = way.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.explode(F.array("a", "b")).alias("a"), "m").where("a > m").select("a", F.col("m").alias("b")).distinct()
        edges = written(small, "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select("a", F.col("b").alias("root"))
        before = now


def _shared_sizes(texts: DataFrame) -> DataFrame:
    """(node, size, shared): how many distinct shingles each text has, and how many of
    them stand in another of these texts too. Two texts can't have more in common than
    the smaller `shared`, which rules most pairs out before any is made."""
    def run(t: bw.Texts):
        doc, g, _ = shingles(t)
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(len(t.offsets))).astype(np.int32)
        return {"g": pa.ListArray.from_arrays(pa.array(cuts), pa.array(g[order].view(np.int64))), "_": np.zeros(len(cuts) - 1, np.int64)}

    listed = texts.select("node", text_function("g array<long>, _ long", run)(F.col("_text"))["g"].alias("g"))
    each = listed.select("node", F.explode("g").alias("g")).groupBy("g").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    alone = each.where("c = 1").groupBy("node").agg(F.count("*").alias("alone"))
    sizes = listed.select("node", F.size("g").alias("size"))
    return sizes.join(alone, "node", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Rows (key, node, root) of the keys where classes meet, with the largest class there."""
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    return placed.join(mixed.select("key", F.col("top.root").alias("top")), "key")


def near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = 50, rows: int = 8, crowd: int = 512) -> DataFrame:
    """One row per row of docs: doc_id, _copy (md5 of the text), class_id, _first (the
    row's text is the one that stands for its class, and its doc_id the smallest of that
    text).

    class_id is the smallest doc_id of the class. Texts of one class are linked by
    Jaccard similarities (of shingle sets) of `least` or more, directly or over others. Exact copies are one node,
    however many; within a band each text is compared with the best connected one, and
    then with members of other classes that have enough in common with any text there.
    Pairs that sizes, shared shingles or parities prove to be below `least` aren't compared;
    bands of any size are met in whole, and `crowd` changes nothing any more. Texts
    without a word, null ones too, belong to no class: class_id is their doc_id. Null
    doc_ids come after all others. No rows give no rows; other columns are left out."""
    def signed(t: bw.Texts):
        doc, g, count = shingles(t)
        n = len(t.offsets) - 1
        some = np.bincount(doc, minlength=n) > 0
        many = np.unique(doc[count > 1])
        again = np.isin(doc, many)
        plain = signatures(np.searchsorted(many, doc[again]), g[again], np.ones(again.sum()), len(many), registers)
        weighted = signatures(doc, g, count, n, registers)
        keys = np.concatenate([band_keys(weighted, bands)[some], band_keys(plain, bands)])
        of = np.concatenate([np.nonzero(some)[0], many])
        keys = keys[np.argsort(of, kind="stable")].ravel()
        ends = np.cumsum(np.bincount(of, minlength=n) * bands)
        cuts = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return {"keys": pa.ListArray.from_arrays(cuts, pa.array(keys), mask=pa.array(~some)), "sketch": list(parities(doc, g, n))}

    registers = bands * rows
    rows_of = docs.select("doc_id", text_of().alias("_text")).withColumn("_copy", F.md5("_text"))
    # Exact copies meet here, counted before the shuffle.
    alike = rows_of.groupBy("_copy", "doc_id").agg(F.count("*").alias("_n"))
    copies = alike.groupBy("_copy").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"))).alias("_min"))
    copies = copies.select("_copy", F.col("_min.id").alias("_doc"))
    signs = rows_of.withColumn("_s", text_function("keys array<long>, sketch array<long>", signed)(F.col("_text")))
    signs = signs.select("_copy", "doc_id", F.array_distinct("_s.keys").alias("_keys"), F.col("_s.sketch").alias("_sketch"))
    same = [F.col("_copy") == F.col("_c"), F.col("doc_id").eqNullSafe(F.col("_doc"))]
    chosen = signs.where("_keys is not null").join(copies.select(F.col("_copy").alias("_c"), "_doc"), same).groupBy("_copy").agg(F.first("_doc").alias("_doc"), F.first("_keys").alias("_keys"), F.first("_sketch").alias("_sketch"))
    nodes = written(chosen.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    keys = nodes.select("node", F.explode("_keys").alias("key"))
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-bands")
    members = written(keys.join(shared, "key"), "near-members")
    # The text with most company in its bands stands in the middle of each.
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = written(members.join(degree, "node"), "near-ranked")
    centre = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("c"))).alias("m")).select("key", (-F.col("m.c")).alias("centre"))
    needed = members.select("node").distinct().join(nodes.select("node", "_copy", "_doc"), "node").withColumnRenamed("_copy", "_c")
    texts = written(rows_of.join(needed, same).groupBy("node").agg(F.first("_text").alias("_text")), "near-texts")
    bounds = written(_shared_sizes(texts).join(nodes.select("node", F.col("_sketch").alias("sketch")), "node"), "near-bounds")

    def possible(shared, size, other):
        return F.col(shared) * (1 + least) >= (F.col(size) + F.col(other)) * least - 1e-9

    def close(x, nx, y, ny):
        return alone(F.col(x), F.col(y)) * (1 + least) <= (F.col(nx) + F.col(ny)) * (1 - least) + 1e-9

    met = ranked.join(centre, "key").where("node != centre").select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()
    met = met.join(bounds.toDF("a", "na", "ca", "sa"), "a").join(bounds.toDF("b", "nb", "cb", "sb"), "b")
    pairs = written(met.where(possible("ca", "na", "nb") & possible("cb", "nb", "na") & close("sa", "na", "sb", "nb")).select("a", "b"), "near-pairs")
    check = F.arrow_udf(_similar, T.DoubleType()).asNondeterministic()

    def verified(some: DataFrame) -> DataFrame:
        left, right = texts.select(F.col("node").alias("b"), F.col("_text").alias("_tb")), texts.select(F.col("node").alias("a"), F.col("_text").alias("_ta"))
        full = some.join(left, "b").join(right, "a").repartition("a", "b")
        return full.withColumn("_sim", check("_ta", "_tb")).where(F.col("_sim") >= least).select("a", "b")

    links = written(verified(pairs), "near-links")
    roots = classes(links)
    placed = members.join(roots.withColumnRenamed("a", "node"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    bounded = written(_mixed(placed), "near-mixed").join(bounds, "node")
    smallest = bounded.groupBy("key").agg(F.min("size").alias("smallest"))
    bounded = bounded.join(smallest, "key").where(possible("shared", "size", "smallest"))
    few = bounded.where("root != top").select("key", F.col("node").alias("x"), F.col("root").alias("rx"), F.col("size").alias("nx"), F.col("shared").alias("cx"), F.col("sketch").alias("sx"))
    rest = bounded.select("key", F.col("node").alias("y"), F.col("root").alias("ry"), F.col("size").alias("ny"), F.col("shared").alias("cy"), F.col("sketch").alias("sy"))
    meet = (few["key"] == rest["key"]) & (F.col("rx") != F.col("ry")) & possible("cx", "nx", "ny") & possible("cy", "nx", "ny")
    across = few.join(rest, meet & close("sx", "nx", "sy", "ny"))
    fresh = written(across.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"), "near-across")
    # These are all pairs of two classes under any key. Classes only grow together, so
    # another round would find no pair that isn't among them.
    more = written(verified(fresh), "near-links")
    if not more.isEmpty():
        roots = classes(links.unionByName(more))
    order = F.struct(F.col("_doc").isNull().alias("n"), F.col("_doc").alias("id"), F.col("node").alias("node"))
    found = nodes.select("node", "_copy", "_doc").join(roots.withColumnRenamed("a", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = found.groupBy("root").agg(F.min(order).alias("_head"))
    named = written(found.join(heads, "root").select(F.col("_copy").alias("_c"), "_doc", F.col("_head.id").alias("_class"), (F.col("_head.node") == F.col("node")).alias("_is")), "near-classes")
    out = rows_of.select("doc_id", "_copy").join(named, F.col("_copy") == F.col("_c"), "left")
    none = F.col("_c").isNull()
    return out.select("doc_id", "_copy", F.when(none, F.col("doc_id")).otherwise(F.col("_class")).alias("class_id"),
                      (none | (F.col("_is") & F.col("doc_id").eqNullSafe(F.col("_doc")))).alias("_first"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id (of repeated rows
    one). Rows without a word all stay."""
    copy, ident, other, many = free(docs, "_copy", "_id", "_c", "_n")
    heads = near_duplicates(docs, **options).where("_first").groupBy("doc_id", "_copy").agg(F.count("*").alias(many))
    heads = heads.select(F.col("doc_id").alias(ident), F.col("_copy").alias(other), many)
    rows = docs.withColumn(copy, F.md5(text_of())).join(heads, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(copy) == F.col(other)))
    wordless = ~F.col("text").rlike(r"[^\x20\x09-\x0D]") | F.col("text").isNull()
    single = rows.where((F.col(many) == 1) | wordless)
    repeated = rows.where((F.col(many) > 1) & ~wordless).dropDuplicates([ident, other])
    return single.unionByName(repeated).select(*docs.columns)
