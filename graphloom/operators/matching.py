"""Largest matchings with a proof.

For any set B of vertices, no matching has more than (n + |B| - odd(B)) / 2 links, where
odd(B) counts the components of odd size that are left without B (Tutte and Berge). The
neighbours of the vertices that a largest matching can miss, without those vertices
themselves, are a B for which this is the size itself (Gallai and Edmonds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.bitset import sets
from graphloom.operators import dense
from graphloom.operators.packed import bind, by_width


def odd_parts_column(df: DataFrame, wide: bool) -> DataFrame:
    """`odd_parts` by expressions, as `dense.barriers` gives them by stacks: components of
    odd size among the vertices outside `barrier`. A
    component grows until it is stable, then the lowest vertex not yet seen starts
    the next one; n + 2 rounds are enough."""
    s = sets(wide)
    one = s.single("v")
    kept = f"""aggregate(filter(sequence(0, n - 1), v -> not array_contains(barrier, v)), {s.empty}, (acc, v) -> {s.union('acc', one)})"""
    links = f"transform(adj, (a, v) -> if({s.has('kept', 'v')}, {s.meet('a', 'kept')}, {s.empty}))"
    grow = f"aggregate(sequence(0, n - 1), st.cur, (acc, v) -> if({s.has('st.cur', 'v')}, {s.union('acc', 'links[v]')}, acc))"
    fresh = f"array_min(filter(sequence(0, n - 1), v -> {s.has('kept', 'v')} and not {s.has('seen', 'v')}))"
    start = f"named_struct('cur', {s.empty}, 'seen', {s.empty}, 'odd', 0, 'done', false)"
    next_ = f"""transform(array({s.union('old.seen', 'old.cur')}), seen -> transform(array({fresh}), v -> named_struct(
        'cur', if(v is null, {s.empty}, {one}), 'seen', seen, 'odd', old.odd + {s.size('old.cur')} % 2, 'done', v is null))[0])[0]"""
    round_ = f"""if(st.done, st, aggregate(array({grow}), st, (old, new) -> if(new <> old.cur,
        named_struct('cur', new, 'seen', old.seen, 'odd', old.odd, 'done', false), {next_})))"""
    swept = f"aggregate(sequence(1, n + 2), {start}, (st, r) -> {round_}).odd"
    inner = f"transform(array({kept}), kept -> transform(array({links}), links -> {swept})[0])[0]"
    return df.withColumn("odd_parts", F.expr(bind("adj", bind("barrier", f"if(n < 1, 0, {inner})"))))


def certified(packed: DataFrame, seed: int = 1) -> DataFrame:
    """Adds `max_matching_size`, `barrier` (vertices), `odd_parts`, `matching_bound` and
    `certified`, for graphs of any size.

    The size comes from a rank, which can only fall short; the bound can only be too
    large. `certified` is 1 where they meet: then the size is proven. Where they don't,
    the random matrix was unlucky (chance below n^2 / 2^31); ask again with another
    seed. Rows whose n is NULL are left out."""

    def compute(df: DataFrame, wide: bool) -> DataFrame:
        return dense.barriers(dense.missable(df, seed)).drop("missable")

    bound = F.expr("cast((n + size(barrier) - odd_parts) div 2 as int)")
    out = by_width(packed, compute).withColumn("matching_bound", bound)
    return out.withColumn("certified", (F.col("matching_bound") == F.col("max_matching_size")).cast("int"))
