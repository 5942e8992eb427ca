"""Mixing sources to target weights: budgets met by subset sums over document lengths.

Documents are counted by source and exact length. A source's budget takes whole copies
of everything, then a spread of lengths, and the rest is fitted by bounded-knapsack
dynamic programming over how many documents of each length to take. Which documents of
a length are taken is decided by seeded hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.llm.common import schema_of, text_of
from graphloom.session import written

CUT = 2048


def targets(sizes: list[int], weights: tuple[float, ...], share: float, most: float) -> list[float]:
    """Budgets of sources in order: `share` of all sizes by weight, none above `most`
    times its size; what is over goes to the others by weight until none is above."""
    cap = [most * s for s in sizes]
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    done: dict[int, float] = {}
    while len(done) < len(sizes):
        left = share * sum(sizes) - sum(done.values())
        total = sum(w for i, w in enumerate(weight) if i not in done)
        now = {i: left * weight[i] / total for i in range(len(sizes)) if i not in done}
        over = [i for i, t in now.items() if t > cap[i]]
        done |= {i: cap[i] for i in over} if over else now
    return [done[i] for i in range(len(sizes))]


def subset(sizes: list[int], free: list[int], budget: int) -> list[int]:
    """How many of each size (at most `free`) to take for the largest sum within the
    budget: bounded knapsack, counts in powers of two, reachable sums as bits of one
    integer; each sum remembers the part that reached it first."""
    parts = []
    for k, (s, n) in enumerate(zip(sizes, free, strict=True)):
        n = min(n, budget // s) if s else 0
        step = 1
        while n > 0:
            parts.append((k, min(step, n), min(step, n) * s))
            n -= step
            step *= 2
    reach, mask = 1, (1 << (budget + 1)) - 1
    by = np.full(budget + 1, -1, np.int64)
    for i, (_, _, value) in enumerate(parts):
        new = (reach << value) & mask & ~reach
        if new:
            raw = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
            by[np.nonzero(np.unpackbits(raw, bitorder="little")[: budget + 1])[0]] = i
            reach |= new
            if reach >> budget & 1:
                break
    total, taken = reach.bit_length() - 1, [0] * len(sizes)
    while total:
        k, count, value = parts[by[total]]
        taken[k] += count
        total -= value
    return taken


def counts_to_take(sizes: np.ndarray, n: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """Whole copies of all documents, and how many more of each length to take."""
    total = int((sizes * n).sum())
    if not total:
        return 0, np.zeros(len(sizes), np.int64)
    whole = int(target // total)
    rest = int(np.floor(target - whole * total))
    # Spread: each length gets its share of what is left but a few of the longest texts;
    # what its last document would overrun goes on to the next shorter length.
    order, take, carry = np.argsort(-sizes), np.zeros(len(sizes), np.int64), 0.0
    spread = max(0.0, (rest - 4 * int(sizes.max())) / total)
    for k in order:
        if sizes[k]:
            carry += spread * float(n[k]) * float(sizes[k])
            take[k] = min(int(n[k]), int(carry // sizes[k]))
            carry -= float(take[k]) * float(sizes[k])
    left = rest - int((take * sizes).sum())
    some = [int(k) for k in order if sizes[k] and n[k] > take[k]]
    more = subset([int(sizes[k]) for k in some], [int(n[k] - take[k]) for k in some], left)
    take[some] += np.array(more, np.int64) if some else 0
    return whole, take


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, source, size (words), source_size, target, taken
    (words the mix takes of it, repeats counted).

    Sources in the order of their code points, null last, get the weights in turn. A
    source's taken words miss its target by less than its shortest text, as a rule by
    less than one word. Empty and null texts have size 0 and are never taken. Other
    columns are left out; no rows give no rows. Draws are hashes of doc_id and seed."""
    size = F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")), "mix-sizes")
    lengths = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    kinds = schema_of("source string, source_size long, target double")

    def fill(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        for r, t in zip(rows, targets([r["source_size"] for r in rows], weights, share, most), strict=True):
            r["target"] = t
        return pa.Table.from_pylist(rows, to_arrow_schema(kinds))

    aims = written(sources.groupBy().applyInArrow(fill, kinds), "mix-targets")  # one row per source
    aims = aims.select(F.col("source").alias("_s"), "source_size", "target")
    plan_kind = schema_of("source string, size long, n long, whole long, extra long, source_size long, target double")

    def fit(table: pa.Table) -> pa.Table:
        sizes, n = table["size"].to_numpy(), table["n"].to_numpy()
        whole, extra = counts_to_take(sizes, n, table["target"][0].as_py())
        return pa.Table.from_arrays([table["source"], table["size"], table["n"], pa.array(np.full(len(n), whole)), pa.array(extra), table["source_size"], table["target"]],
                                    schema=to_arrow_schema(plan_kind))

    by_source = lengths.join(aims, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = written(by_source.groupBy("source").applyInArrow(fit, plan_kind), "mix-plan")
    plan = plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "whole", "extra", "source_size", "target",
                       F.ceil(F.col("n") / CUT).alias("_cuts"))
    # Ranks by hash without a group in one task: cuts of about CUT documents each.
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))
    part = F.floor(F.shiftrightunsigned(draw, 24) / (1 << 40) * F.col("_cuts")).cast("long")
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).withColumn("_draw", draw).withColumn("_cut", part)
    cuts = placed.where("_cuts > 1").groupBy("_s", "_z", "_cut").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy("_s", "_z").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    before = cuts.select(F.col("_s").alias("_s2"), F.col("_z").alias("_z2"), F.col("_cut").alias("_cut2"), F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_before"))
    before = written(before.where("_before > 0"), "mix-cuts")
    found = placed.join(before, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_z") == F.col("_z2")) & (F.col("_cut") == F.col("_cut2")), "left")
    inner = Window.partitionBy("source", "size", "_cut").orderBy("_draw", "doc_id")
    rank = F.row_number().over(inner) + F.coalesce("_before", F.lit(0))
    return found.withColumn("_rank", rank).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + (F.col("_rank") <= F.col("extra")).cast("long"))).alias("taken"))
