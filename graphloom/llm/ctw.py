"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a node of its own (the bits before it) in
every context of 0 to DEPTH preceding bytes. Nodes hold Krichevsky-Trofimov estimates;
a context tree mixes all depths, so that a text's code length is that of the mixture of
all prunings of the tree, trained on the corpus and then held fixed.

The tree is built from counts of (context, byte) grams, a Spark aggregate that grows
with the corpus. Texts are scored in blocks: a block asks for its distinct grams and
words, the answers come by joins, and neither model nor vocabulary is sent anywhere
whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from graphloom.llm.common import schema_of, text_of
from graphloom.session import written

DEPTH = 4
EDGE = 0xFF  # stands before and after each text; no byte of UTF-8
BLOCK_BYTES = 16 << 20
PART_BYTES = 1 << 20
BUCKETS = 256


# --- blocks of texts ----------------------------------------------------------------------

def _blocks(docs: DataFrame) -> DataFrame:
    """_payload: about BLOCK_BYTES of whole texts, their doc_id and whether to learn from
    them, compressed; one row per block, so that one number serves many texts."""

    def run(batches):
        held, size = [], 0

        def packed():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_payload"])

        for batch in batches:
            lengths = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                done = lengths[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(lengths, done + BLOCK_BYTES - size, "right")))
                held.append(batch.slice(first, last - first))
                size += int(lengths[last - 1] - done)
                first = last
                if size >= BLOCK_BYTES or first < batch.num_rows:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return docs.mapInArrow(run, schema_of("_payload binary"))


def _texts(payload: bytes):
    """The rows of a block in parts of about PART_BYTES: texts in lower case (A-Z), flags
    and doc_ids."""
    for batch in pa.ipc.open_stream(pa.py_buffer(payload)):
        texts, flags, ids = batch.column("text"), batch.column("_learn").to_pylist(), batch.column("doc_id")
        part, size, first = [], 0, 0
        for i, text in enumerate(texts):
            raw = text.as_buffer().to_pybytes().lower() if text.is_valid else b""
            part.append(raw)
            size += len(raw)
            if size >= PART_BYTES or i == len(texts) - 1:
                yield part, np.array(flags[first : i + 1], bool), ids.slice(first, i + 1 - first)
                part, size, first = [], 0, i + 1


def _grams(part: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram (context, byte) of each byte and of the end of each text, and how many
    there are in each text."""
    edge = bytes([EDGE])
    raw = np.frombuffer(b"".join(edge * depth + t + edge for t in part), np.uint8)
    lengths = np.array([len(t) + 1 for t in part])
    gram = np.zeros(len(raw) - depth, np.int64)
    for k in range(depth + 1):
        gram = (gram << 8) | raw[k : len(raw) - depth + k]
    starts = np.cumsum(lengths + depth) - lengths - depth
    keep = np.ones(len(gram), bool)
    for k in range(depth):  # grams that end in the padding of the next text
        keep[starts[1:] - depth + k] = False
    return gram[keep], lengths


def _block_grams(payload: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a block, sorted, and how often each occurs in texts to learn."""
    kinds, counts = [], []
    for part, learn, _ in _texts(payload):
        g, lengths = _grams(part, depth)
        order_free = np.repeat(learn, lengths)
        u, n = np.unique(g[order_free], return_counts=True)
        rest = np.setdiff1d(np.unique(g[~order_free]), u, assume_unique=True)
        kinds += [u, rest]
        counts += [n, np.zeros(len(rest), np.int64)]
    if not kinds:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat, n = np.concatenate(kinds), np.concatenate(counts)
    order = np.argsort(flat)
    flat, n = flat[order], n[order]
    heads = np.nonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))[0]
    return flat[heads], np.add.reduceat(n, heads)


def _known_grams(payload: bytes, depth: int) -> np.ndarray:
    """The first result of _block_grams."""
    known = np.zeros(0, np.int64)
    for part, _, _ in _texts(payload):
        known = np.union1d(known, np.unique(_grams(part, depth)[0]))
    return known


def _known_words(payload: bytes) -> list[bytes]:
    """The first result of _block_words."""
    known: set[bytes] = set()
    for part, _, _ in _texts(payload):
        for text in part:
            known.update(text.split())
    return sorted(known)


def _block_words(payload: bytes) -> tuple[list[bytes], list[int]]:
    """Distinct words of a block, sorted, and their counts in texts to learn."""
    seen, other = Counter(), set()
    for part, learn, _ in _texts(payload):
        for text, use in zip(part, learn, strict=True):
            if use:
                seen.update(text.split())
            else:
                other.update(text.split())
    words = sorted(other.union(seen))
    return words, [seen.get(w, 0) for w in words]


# --- the tree -----------------------------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: Stirling's series at x + 8."""
    below = np.zeros_like(x)
    for k in range(8):
        below += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - below


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def kt(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return (count + 0.5) / (total + 1.0)


def _mixed(zeros, ones, below):
    """(log weighted probability, weight of the node's own estimate)."""
    own = np.log(0.5) + log_kt(zeros, ones)
    both = np.logaddexp(own, np.log(0.5) + below)
    return both, np.exp(own - both)


def subtree(gram: np.ndarray, count: np.ndarray, depth: int, top: int):
    """All levels from `depth` down to contexts of `top` bytes, for grams that hold whole
    subtrees. Returns each gram's eight bit probabilities mixed down to level top, and
    the nodes there: (context << 8 | node, zeros, ones, log weighted probability)."""
    byte = gram & 0xFF
    k = np.arange(8)
    node = (1 << k) | (byte[:, None] >> (8 - k))
    bit = (byte[:, None] >> (7 - k)) & 1
    weight = np.repeat(count.astype(float), 8)
    ones = weight * bit.ravel()
    mixed, below_key, below_log = None, None, None
    for level in range(depth, top - 1, -1):
        context = (gram >> 8) & ((1 << (8 * level)) - 1)
        key, of = np.unique(((context[:, None] << 8) | node).ravel(), return_inverse=True)
        n1 = np.bincount(of, ones, len(key))
        n0 = np.bincount(of, weight, len(key)) - n1
        if level == depth:
            log_w, own = log_kt(n0, n1), np.ones(len(key))
        else:
            up = ((below_key >> 8) & ((1 << (8 * level)) - 1)) << 8 | (below_key & 0xFF)
            below = np.bincount(np.searchsorted(key, up), below_log, len(key))
            log_w, own = _mixed(n0, n1, below)
        estimate = kt(np.where(bit.ravel() == 1, n1[of], n0[of]), (n0 + n1)[of])
        mixed = estimate if mixed is None else own[of] * estimate + (1 - own[of]) * mixed
        below_key, below_log = key, log_w
    return mixed.reshape(-1, 8), (below_key, n0, n1, log_w)


def upper_levels(nodes: list[tuple[int, float, float, float]], top: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels top - 1 to 0 from the nodes at level top - 1 already summed by Spark: (key,
    zeros, ones, log weighted probability of the children). Per level, arrays by key:
    zeros, ones, weight of the own estimate."""
    size = 1 << (8 * top)
    zeros, ones, below = np.zeros(size), np.zeros(size), np.zeros(size)
    for key, n0, n1, log_w in nodes:
        zeros[key], ones[key], below[key] = n0, n1, log_w
    levels = []
    for level in range(top - 1, -1, -1):
        log_w, own = _mixed(zeros, ones, below)
        levels.append((zeros, ones, own))
        if level:
            shape = (256, 1 << (8 * (level - 1)), 256)
            zeros, ones, below = (a.reshape(shape).sum(axis=0).ravel() for a in (zeros, ones, log_w))
    return levels


def finish(gram: np.ndarray, mixed: np.ndarray, levels, top: int) -> np.ndarray:
    """Natural log of the probability of each gram's byte, levels above `top` mixed in."""
    byte = gram & 0xFF
    k = np.arange(8)
    node = (1 << k) | (byte[:, None] >> (8 - k))
    bit = (byte[:, None] >> (7 - k)) & 1
    for i, (zeros, ones, own) in enumerate(levels):
        context = (gram >> 8) & ((1 << (8 * (top - 1 - i))) - 1)
        key = (context[:, None] << 8) | node
        mixed = own[key] * kt(np.where(bit == 1, ones[key], zeros[key]), zeros[key] + ones[key]) + (1 - own[key]) * mixed
    return np.log(mixed).sum(axis=1)


def _model(requests: DataFrame, depth: int, top: int = 2) -> DataFrame:
    """(gram, lp): log probability of the last byte of each gram asked for. Subtrees of a
    two-byte context stay together: at most 256 ** (depth - 1) distinct grams each. The
    levels above have at most 256 * 256 nodes."""
    counts = requests.groupBy("gram").agg(F.sum("n").alias("n"))
    kind = schema_of("gram long, mixed binary, key long, zeros double, ones double, log_w double")
    schema = to_arrow_schema(kind)

    def build(table: pa.Table) -> pa.Table:
        gram, n = table["gram"].to_numpy(), table["n"].to_numpy()
        mixed, (key, zeros, ones, log_w) = subtree(gram, n, depth, top)
        raw = np.ascontiguousarray(mixed)
        rows = pa.array([r.tobytes() for r in raw], pa.binary())
        first = pa.table([pa.array(gram), rows, pa.nulls(len(gram), pa.int64()), *(pa.nulls(len(gram), pa.float64()) for _ in range(3))], schema=schema)
        second = pa.table([pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.binary()), pa.array(key), pa.array(zeros), pa.array(ones), pa.array(log_w)], schema=schema)
        return pa.concat_tables([first, second])

    context = F.shiftright("gram", 8).bitwiseAND((1 << (8 * top)) - 1)
    tree = written(counts.groupBy(F.pmod(F.xxhash64(context), F.lit(BUCKETS))).applyInArrow(build, kind), "ctw-tree")
    above = F.shiftleft(F.shiftright("key", 8).bitwiseAND((1 << (8 * (top - 1))) - 1), 8).bitwiseOR(F.col("key").bitwiseAND(255))
    sums = tree.where("key is not null").groupBy(above.alias("key")).agg(F.sum("zeros"), F.sum("ones"), F.sum("log_w"))
    levels = upper_levels([tuple(r) for r in sums.collect()], top)  # at most 256 * 255 rows
    shared = requests.sparkSession.sparkContext.broadcast(levels)
    out = schema_of("gram long, lp double")

    def close(batches):
        for b in batches:
            gram = b.column("gram").to_numpy()
            mixed = np.frombuffer(b"".join(b.column("mixed").to_pylist()), float).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([b.column("gram"), pa.array(finish(gram, mixed, shared.value, top))], names=["gram", "lp"])

    return tree.where("gram is not null").select("gram", "mixed").mapInArrow(close, out)


# --- scoring ------------------------------------------------------------------------------

def _asked(blocks: DataFrame, kind: str, fn, key_type: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("_block", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField(kind, key_type), T.StructField("n", T.LongType())])

    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, n = fn(payload.as_buffer())
                for a in range(0, len(keys), 100_000):
                    part = keys[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(np.arange(a, a + len(part), dtype=np.int32)),
                                                      pa.array(part, to_arrow_type(key_type)), pa.array(n[a : a + 100_000], pa.int64())], names=schema.names)

    return blocks.mapInArrow(run, schema)


def score(docs: DataFrame, learn, depth: int = DEPTH) -> DataFrame:
    """doc_id, _learn, n_tokens, n_known, train_tokens, base_score, score for each row.

    learn: a column, true for rows to learn from (null is false). Texts are lower-cased
    (A-Z). score is the log10 probability of the text's bytes and its end; base_score
    that of its words and end under add-half unigram counts. Null texts are empty: they
    have the end only. Without rows to learn from every bit has probability one half.
    Repeated rows count and are scored each; other columns are left out."""
    rows = docs.select("doc_id", text_of().alias("text"), F.coalesce(learn, F.lit(False)).alias("_learn"))
    blocks = written(_blocks(rows).select(F.monotonically_increasing_id().alias("_block"), "_payload"), "ctw-blocks")
    grams = written(_asked(blocks, "gram", lambda p: _block_grams(p, depth), T.LongType()), "ctw-grams")
    model = _model(grams.select("gram", "n"), depth)
    of_grams = grams.join(model, "gram").select("_block", F.lit(False).alias("w"), "i", F.col("lp").alias("v"))

    words = _asked(blocks, "word", _block_words, T.BinaryType())
    same = Window.partitionBy("word")
    counted = written(words.withColumn("c", F.sum("n").over(same)).withColumn("k", F.row_number().over(same.orderBy("_block")))
                      .select("_block", "i", "c", F.when(F.col("k") == 1, F.col("c")).alias("once")), "ctw-words")
    ends = rows.where("_learn").count()
    n, v = counted.agg(F.sum("once"), F.sum((F.col("once") > 0).cast("long"))).first()
    total, kinds = int(n or 0) + ends, int(v or 0) + (ends > 0)
    of_words = counted.select("_block", F.lit(True).alias("w"), "i", F.col("c").cast("double").alias("v"))

    def base(c):
        return np.log10((np.asarray(c, float) + 0.5) / (total + 0.5 * (kinds + 1)))

    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("_learn", T.BooleanType()),
                        *schema_of("n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        w, i, value = (right[c].to_numpy() for c in ("w", "i", "v"))
        lp, counts = np.zeros(int((~w).sum())), np.zeros(int(w.sum()))
        lp[i[~w]], counts[i[w]] = value[~w], value[w]
        tables = []
        for payload in left["_payload"]:
            payload = payload.as_buffer()
            known = _known_grams(payload, depth)
            count_of = dict(zip(_known_words(payload), counts.tolist(), strict=True))
            for part, learn_flags, ids in _texts(payload):
                g, lengths = _grams(part, depth)
                each = np.add.reduceat(lp[np.searchsorted(known, g)], np.cumsum(lengths) - lengths) / np.log(10)
                said = [t.split() for t in part]
                n_tokens = np.array([len(t) + 1 for t in said])
                # The end of each text stands after its words.
                c = np.array([c for t in said for c in (*map(count_of.__getitem__, t), ends)], float)
                heads = np.cumsum(n_tokens) - n_tokens
                tables.append(pa.table([ids, pa.array(learn_flags), pa.array(n_tokens), pa.array(np.add.reduceat((c > 0).astype(np.int64), heads)),
                                        pa.array(np.full(len(part), total)), pa.array(np.add.reduceat(base(c), heads)), pa.array(each)],
                                       schema=to_arrow_schema(out)))
        return pa.concat_tables(tables) if tables else pa.Table.from_pylist([], to_arrow_schema(out))

    answers = of_grams.unionByName(of_words)
    return blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(run, out)
