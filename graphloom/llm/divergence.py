"""Source divergence audit: terms recounted through minimal perfect hashes.

A first pass counts in how many documents of its language each term stands; terms that
enough documents hold are kept, exactly. Their perfect hashes are built in shards, one
task per shard, and sent to the tasks of a second pass in rounds of bounded size. That
pass finds the slot of each distinct term of a batch, compares the stored key, and
increments a dense array per (language, source). Shares and divergences are then whole
numbers, worked out per shard over its slots by all sources at once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm import bytewords as bw
from graphloom.llm.common import schema_of, text_function
from graphloom.session import written

U = np.uint64
#: Letters in lower case, bytes outside ASCII as they are, 0 for what parts terms.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 0 for c in range(256)], np.uint8)
SLICE = 8 << 20
BUCKET_KEYS = 4


class Terms(NamedTuple):
    doc: np.ndarray  # text of each occurrence
    code: np.ndarray  # its place in `words`
    words: pa.LargeStringArray  # distinct terms


def terms_of(t: bw.Texts) -> Terms:
    low = FOLD[t.buf]
    inside = low != 0
    edge = np.zeros(len(inside) + 1, bool)
    edge[t.offsets] = True
    after, before = np.append(inside, False), np.insert(inside, 0, False)
    start = np.nonzero(after & (~before | edge))[0]
    end = np.nonzero(before & (~after | edge))[0]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])])
    coded = found.dictionary_encode()
    return Terms(t.doc_of(start), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


def laid_out(words: pa.Array) -> bw.Texts:
    _, offsets, data = words.cast(pa.large_string()).buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bw.Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def hashes(words: pa.Array) -> np.ndarray:
    t = laid_out(words)
    return t.hashes(t.offsets[:-1], t.offsets[1:])


def _slot(h: np.ndarray, displacement: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """A displacement below 0 names the slot itself, any other is part of the hash."""
    mixed = (bw.mix(h + displacement.astype(np.uint64) * bw.STEP) % np.asarray(size, np.uint64)).astype(np.int64)
    return np.where(displacement < 0, -displacement - 1, mixed)


def build(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slots) of a minimal perfect hash of distinct values: the fullest
    buckets take the first displacement that leads to free slots, single keys a free
    slot outright."""
    size = len(h)
    n_buckets = max(1, -(-size // BUCKET_KEYS))
    bucket = (bw.mix(h) % U(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=n_buckets)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    displacement, slots, taken = np.zeros(n_buckets, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
    for b in np.argsort(-counts, kind="stable"):
        keys = order[starts[b] : starts[b] + counts[b]]
        if len(keys) < 2:
            break
        first, tries = 0, 16
        while True:
            d = np.arange(first, first + tries, dtype=np.int64)
            at = _slot(h[keys][None, :], np.broadcast_to(d[:, None], (tries, len(keys))), size)
            spread = np.sort(at, axis=1)
            fits = ~taken[at].any(axis=1) & (spread[:, 1:] != spread[:, :-1]).all(axis=1)
            if fits.any():
                k = int(fits.argmax())
                displacement[b], slots[keys] = d[k], at[k]
                taken[at[k]] = True
                break
            first, tries = first + tries, min(4096, tries * 2)
    single = np.nonzero(counts == 1)[0]
    open_slots = np.nonzero(~taken)[0]
    displacement[single] = -open_slots - 1
    slots[order[starts[single]]] = open_slots
    return displacement, slots


class Shards:
    """Perfect hashes of one language, laid end to end. `find` gives each term the
    place of its slot among all of them, -1 where the stored key is another term."""

    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: r["shard"])
        self.shards = rows[0]["shards"]
        self.number = np.array([r["shard"] for r in rows])
        sizes = np.array([r["size"] for r in rows], np.int64)
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        steps = [np.frombuffer(r["steps"], np.int64) for r in rows]
        self.width = np.array([len(s) for s in steps], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.width)[:-1]])
        self.steps = np.concatenate(steps)
        lengths = np.concatenate([np.frombuffer(r["lengths"], np.int32) for r in rows]).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        self.keys = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(r["keys"] for r in rows))])

    def find(self, words: pa.Array) -> np.ndarray:
        h = hashes(words)
        shard = h.view(np.int64) % self.shards
        at = np.minimum(np.searchsorted(self.number, shard), len(self.number) - 1)
        here = np.nonzero(self.number[at] == shard)[0]
        out = np.full(len(words), -1, np.int64)
        if len(here):
            h, at = h[here], at[here]
            bucket = (bw.mix(h) % self.width[at].astype(np.uint64)).astype(np.int64)
            size = self.base[at + 1] - self.base[at]
            place = self.base[at] + _slot(h, self.steps[self.first[at] + bucket], size)
            same = pc.equal(self.keys.take(pa.array(place)), words.cast(pa.large_string()).take(pa.array(here)))
            same = same.to_numpy(zero_copy_only=False)
            out[here[same]] = place[same]
        return out


def vocabulary(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term): terms in `least` or more rows of `docs` (lang, source, text)."""

    def run(batches):
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            of = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last, t in bw.slices(batch.column(2), SLICE):
                found = terms_of(t)
                k = max(1, len(found.words))
                once = np.unique(found.doc * k + found.code)
                pair, n = np.unique(of[first:last][once // k] * k + once % k, return_counts=True)
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(pair // k)), found.words.take(pa.array(pair % k)).cast(pa.string()),
                                                  pa.array(n, pa.int64())], names=["lang", "term", "n"])

    rows = docs.select("lang", "source", "text").mapInArrow(run, schema_of("lang string, term string, n long"))
    return rows.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


SHARD = "lang string, shard long, shards long, size long, steps binary, lengths binary, keys binary"


def _build_shard(table: pa.Table) -> pa.Table:
    words = table.column("term").combine_chunks().cast(pa.large_string())
    displacement, slots = build(hashes(words))
    ordered = words.take(pa.array(np.argsort(slots)))
    t = laid_out(ordered)
    row = {"lang": [table.column("lang")[0].as_py()], "shard": [table.column("shard")[0].as_py()], "shards": [table.column("shards")[0].as_py()],
           "size": [len(words)], "steps": [displacement.tobytes()], "lengths": [np.diff(t.offsets).astype(np.int32).tobytes()], "keys": [t.buf.tobytes()]}
    return pa.table(row)


def perfect_hashes(kept: DataFrame, groups: DataFrame, shard_terms: int, cells: int) -> DataFrame:
    """One row per (lang, shard) of the kept terms. A shard has about `shard_terms`
    terms, or fewer where its language has so many sources that sources times terms
    would pass `cells`."""
    numbered = kept.withColumn("h", text_function("h long", lambda t: {"h": t.hashes(t.offsets[:-1], t.offsets[1:]).view(np.int64)})(F.col("term"))["h"])
    numbered = written(numbered, "divergence-terms")
    most = F.greatest(F.lit(64), F.least(F.lit(shard_terms), F.floor(F.lit(cells) / F.size("sources"))))
    sizes = numbered.groupBy("lang").agg(F.count("*").alias("v")).join(groups.select("lang", "sources"), "lang")
    sizes = written(sizes.select("lang", F.ceil(F.col("v") / most).cast("long").alias("shards")), "divergence-sizes")
    placed = numbered.join(sizes, "lang").withColumn("shard", F.pmod(F.col("h"), F.col("shards")))
    built = placed.select("lang", "term", "shard", "shards").groupBy("lang", "shard")
    return written(built.applyInArrow(_build_shard, schema_of(SHARD)), "divergence-hashes")


def recount(docs: DataFrame, shards: DataFrame, bound: int, cells: int) -> DataFrame:
    """(lang, source, shard, slot, n): occurrences of the kept terms. Hashes go to the
    tasks in rounds of at most `bound` bytes (a shard at least), each a pass over docs;
    a task holds at most `cells` counters, or one group's, before it sends them on."""
    context = docs.sparkSession.sparkContext
    width = (F.length("steps") + F.length("lengths") + F.length("keys")).alias("bytes")
    rounds, filled = [[]], 0
    for r in sorted(shards.select("lang", "shard", width).collect()):  # one row per shard
        if rounds[-1] and filled + r["bytes"] > bound:
            rounds.append([])
            filled = 0
        rounds[-1].append((r["lang"], r["shard"]))
        filled += r["bytes"]
    out = None
    for some in rounds:
        if not some:
            continue
        (low, first), (high, last) = some[0], some[-1]
        from_here = (F.col("lang") > low) | ((F.col("lang") == low) & (F.col("shard") >= first))
        to_here = (F.col("lang") < high) | ((F.col("lang") == high) & (F.col("shard") <= last))
        rows = shards.where(from_here & to_here).collect()
        counted = _one_round(docs, context.broadcast([r.asDict() for r in rows]), cells)
        out = counted if out is None else out.unionByName(counted)
    schema = schema_of("lang string, source string, shard long, slot long, n long")
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))


def _one_round(docs: DataFrame, sent, cells: int) -> DataFrame:
    schema = schema_of("lang string, source string, shard long, slot long, n long")

    def run(batches):
        by_lang: dict[str, list] = {}
        for row in sent.value:
            by_lang.setdefault(row["lang"], []).append(row)
        hashes_of = {lang: Shards(rows) for lang, rows in by_lang.items()}
        dense: dict[tuple[str, str], np.ndarray] = {}

        def flush():
            for (lang, source), counts in dense.items():
                at = np.nonzero(counts)[0]
                mine = hashes_of[lang]
                shard = np.searchsorted(mine.base, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()),
                                                  pa.array(mine.number[shard], pa.int64()), pa.array(at - mine.base[shard], pa.int64()),
                                                  pa.array(counts[at], pa.int64())], names=schema.names)
            dense.clear()

        for batch in batches:
            lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
            langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
            group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(sources)) + source.indices.to_numpy(zero_copy_only=False)
            for first, last, t in bw.slices(batch.column(2), SLICE):
                found = terms_of(t)
                mine = group[first:last][found.doc]
                order = np.argsort(mine, kind="stable")
                kinds, starts = np.unique(mine[order], return_index=True)
                slots: dict[str, np.ndarray] = {}
                for g, a, b in zip(kinds, starts, [*starts[1:], len(order)], strict=True):
                    name = langs[g // len(sources)]
                    if name not in hashes_of:
                        continue
                    if name not in slots:
                        slots[name] = hashes_of[name].find(found.words)
                    at = slots[name][found.code[order[a:b]]]
                    key = (name, sources[g % len(sources)])
                    if key not in dense:
                        size = len(hashes_of[name].keys)
                        if dense and size + sum(map(len, dense.values())) > cells:
                            yield from flush()
                        dense[key] = np.zeros(size, np.int64)
                    np.add.at(dense[key], at[at >= 0], 1)
        yield from flush()

    return docs.select("lang", "source", "text").mapInArrow(run, schema)


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total), by long division so that no product
    leaves 64 bits below totals of 9 * 10**15."""
    rest, out = count.astype(np.int64) + 1, np.zeros(np.broadcast_shapes(np.shape(count), np.shape(total)), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return 1 + out


def _compare(top: int):
    schema = schema_of("lang string, source string, part string, item string, value long")

    def run(counts: pa.Table, info: pa.Table) -> pa.Table:
        row = info.to_pylist()[0]
        sources, size = row["sources"], row["size"]
        number = {s: k for k, s in enumerate(sources)}
        who = np.array([number[s] for s in counts.column("source").to_pylist()], np.int64)
        m = np.zeros((len(sources), size), np.int64)
        m[who, counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
        totals = np.array(row["totals"], np.int64)
        p = share(m, (totals + row["v"])[:, None])
        q = share(m.sum(axis=0), int(totals.sum()) + row["v"])
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], np.int32))])
        keys = [row["keys"][a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        order = np.argsort(np.array([k for _, k in sorted(zip(keys, range(size), strict=True))], np.int64))
        parts = []
        for g, name in enumerate(sources):
            others = [k for k in range(len(sources)) if k != g]
            values = [int(((p[g] - p[o]) ** 2 // p[o]).sum()) for o in others]
            at = np.nonzero((m[g] > 0) & (p[g] > q))[0]
            f = (p[g][at] - q[at]) ** 2 // q[at]
            best = np.lexsort((order[at], -f))[:top]
            items = [sources[o] for o in others] + [keys[k].decode() for k in at[best]]
            parts.append(pa.table({"lang": pa.array([row["lang"]] * len(items), pa.string()), "source": pa.array([name] * len(items), pa.string()),
                                   "part": pa.array(["pair"] * len(others) + ["term"] * len(best), pa.string()), "item": pa.array(items, pa.string()),
                                   "value": pa.array([*values, *f[best].tolist()], pa.int64())}))
        return pa.concat_tables(parts)

    return run, schema


def audit(docs: DataFrame, least: int = 3, top: int = 200, shard_terms: int = 1 << 16, bound: int = 64 << 20, cells: int = 1 << 22) -> DataFrame:
    """How far the sources of each language are apart: lang, source, part, item, value,
    rank.

    Part `pair`: item is each other source of the language, value the sum over the kept
    terms of floor((p - q)^2 / q), q being its share of the term. Part `term`: the `top`
    terms that the source uses more than the language, by the same figure. Shares are
    1 + floor(10^9 (count + 1) / (total + terms)). Kept are terms (runs of letters; A-Z
    count as a-z) in `least` or more rows of the language. Ranks go by value descending,
    then by the item's bytes.

    Null text, lang and source are empty strings. A source alone in its language has no
    pair; a language without kept terms has pairs of value 0; no rows give none.
    Repeated rows count each time. Other columns are ignored. `bound` limits the bytes of
    hashes sent to all tasks at once (more of them take more passes over docs), `cells`
    the counters a task holds. Values are whole numbers of 64 bits."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    pairs = rows.groupBy("lang", "source").agg(F.count("*").alias("_n"))
    groups = written(pairs.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources")), "divergence-groups")
    shards = perfect_hashes(vocabulary(rows, least), groups, shard_terms, cells // 4)
    counts = written(recount(rows, shards, bound, cells), "divergence-counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    everyone = groups.select("lang", F.explode("sources").alias("source")).join(totals, ["lang", "source"], "left")
    listed = everyone.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("g"))
    sizes = shards.groupBy("lang").agg(F.sum("size").alias("v"))
    about = listed.join(sizes, "lang", "left").select("lang", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"), F.coalesce("v", F.lit(0)).alias("v"))
    about = written(about, "divergence-about")
    info = shards.join(about, "lang").select("lang", "shard", "size", "lengths", "keys", "sources", "totals", "v")
    run, schema = _compare(top)
    parts = counts.groupBy("lang", "shard").cogroup(info.groupBy("lang", "shard")).applyInArrow(run, schema)
    found = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    bare = about.where("v = 0").select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", F.explode("sources").alias("item"))
    bare = bare.where("source != item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = found.unionByName(bare).withColumn("rank", place)
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
