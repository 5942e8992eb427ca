"""Colour refinement of vertices and the graph key it gives.

Vertices start with their degree; each round a colour becomes the digest of itself
and the sorted colours of the neighbours. Graphs whose colour multisets agree over
all rounds share a key. As a test of equality up to renaming this is one-sided:
equal graphs always share a key, different ones may (regular graphs of one degree
do)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.packed import bind, by_width, with_adjacency, with_around

ROUNDS = 3


def refine(packed: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Adds `colours` (last round, by vertex), `wl_key` and `n_colours`; graphs without
    vertices have no colours and share a key."""

    def compute(df: DataFrame, wide: bool) -> DataFrame:
        df = with_around(with_adjacency(df, wide), wide)
        df = df.withColumn("c0", F.expr("transform(around, a -> cast(size(a) as string))"))
        for r in range(1, rounds + 1):
            step = (f"transform(c{r - 1}, (own, i) -> md5(concat(own, ':', "
                    f"array_join(array_sort(transform(around[i], j -> c{r - 1}[j])), ','))))")
            df = df.withColumn(f"c{r}", F.expr(bind("around", bind(f"c{r - 1}", step))))
        multisets = ", '|', ".join(f"array_join(array_sort(c{r}), ',')" for r in range(rounds + 1))
        return (
            df.withColumn("wl_key", F.expr(f"md5(concat({multisets}))"))
            .withColumn("n_colours", F.expr(f"size(array_distinct(c{rounds}))"))
            .withColumnRenamed(f"c{rounds}", "colours")
            .drop("adj", "around", *[f"c{r}" for r in range(rounds)])
        )

    return by_width(packed, compute)


def first_of_each(df: DataFrame, keys: list[str], order: Column | str, keep: list[str]) -> DataFrame:
    """Keep-first over `keys`. The first row is picked map-side as well, so a key
    that holds a great share of all rows reaches its reducer as a few candidates."""
    order = F.col(order) if isinstance(order, str) else order
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*keep), order).alias("first"))
    return picked.select(*keys, *[f"first.{c}" for c in keep])


def drop_existing(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the table written so far."""
    return df.join(existing.select(*keys).distinct(), keys, "left_anti")
