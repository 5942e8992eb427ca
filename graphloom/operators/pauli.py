"""Pauli and XOR-mask structure of graphs on 2^q vertices.

With x = u ^ v the coefficient of (x, z) is the sum over the directed links of mask
x of (-1)^popcount(u & z). Both directions of a link agree when popcount(x & z) is
even and cancel when it is odd, so half of the z are zero without looking. All is
whole-number arithmetic: a coefficient is present exactly when it is not zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.dense import pauli_sums
from graphloom.operators.packed import NARROW_MAX, links_of, spread_large


def _sums_narrow(packed: DataFrame) -> DataFrame:
    """`terms, w_sum, w_squares, w_max` by expressions, up to 64 vertices."""
    masks = packed.withColumn("links", links_of()).withColumn(
        "groups",
        F.expr(
            """transform(array(links), l -> transform(array_distinct(transform(l, e -> e.u ^ e.v)), x ->
                 named_struct('x', x, 'starts', transform(filter(l, e -> e.u ^ e.v = x), e -> e.u))))[0]"""
        ),
    )
    weights = masks.withColumn(
        "weights",
        F.expr(
            """transform(array(groups), gs -> flatten(transform(gs, g -> transform(filter(sequence(0, n - 1), z ->
                 bit_count(g.x & z) % 2 = 0
                 and aggregate(g.starts, 0, (acc, u) -> acc + 1 - 2 * (bit_count(u & z) % 2)) <> 0),
                 z -> bit_count(g.x | z)))))[0]"""
        ),
    )
    return (
        weights.withColumn("terms", F.expr("cast(size(weights) as bigint)"))
        .withColumn("w_sum", F.expr("aggregate(weights, 0L, (acc, w) -> acc + w)"))
        .withColumn("w_squares", F.expr("aggregate(weights, 0L, (acc, w) -> acc + w * w)"))
        .withColumn("w_max", F.expr("cast(coalesce(array_max(weights), 0) as bigint)"))
        .drop("links", "groups", "weights")
    )


#: What pauli_columns adds.
COLUMNS = ("pauli_num_terms", "pauli_wt_mean", "pauli_wt_max", "pauli_wt_std")


def pauli_columns(packed: DataFrame) -> DataFrame:
    """pauli_num_terms and mean, maximum and population deviation of the weights; NULL
    where n is not a power of two."""
    is_power = F.coalesce(F.expr("n > 0 and (n & (n - 1)) = 0"), F.lit(False))
    power = packed.where(is_power)
    sums = _sums_narrow(power.where(F.col("n") <= NARROW_MAX)).unionByName(
        pauli_sums(spread_large(power.where(F.col("n") > NARROW_MAX)))
    )
    sums = sums.unionByName(packed.where(~is_power), allowMissingColumns=True)
    return (
        sums.withColumn("pauli_num_terms", F.col("terms").cast("double"))
        .withColumn("pauli_wt_mean", F.expr("if(terms = 0, 0D, w_sum / terms)"))
        .withColumn("pauli_wt_max", F.col("w_max").cast("double"))
        .withColumn(
            "pauli_wt_std",
            F.expr("if(terms = 0, 0D, sqrt(cast(terms * w_squares - w_sum * w_sum as double)) / terms)"),
        )
        .drop("terms", "w_sum", "w_squares", "w_max")
    )


def mask_columns(packed: DataFrame) -> DataFrame:
    """`n_masks`: distinct XOR masks of the links. Links of one mask share no vertex,
    so this bounds the matchings of a decomposition from above; it stands in for the
    external matching count. `largest_mask`: links of the most used mask."""
    masks = packed.withColumn("masks", F.transform(links_of(), lambda e: e["u"].bitwiseXOR(e["v"])))
    return masks.withColumn("n_masks", F.expr("size(array_distinct(masks))")).withColumn(
        "largest_mask",
        F.expr(
            """transform(array(masks), ms -> coalesce(array_max(transform(array_distinct(ms),
                 x -> size(filter(ms, y -> y = x)))), 0))[0]"""
        ),
    ).drop("masks")


def masks_by_grouping(edges: DataFrame) -> DataFrame:
    """Links per XOR mask from a link table: `(graph_id, mask, n_links)`."""
    return edges.groupBy("graph_id", F.expr("u ^ v").alias("mask")).agg(F.count("*").alias("n_links"))


def count_columns(df: DataFrame, terms: str = "pauli_num_terms", matchings: str = "match_num_matchings") -> DataFrame:
    """Ratio (matchings at least one) and difference of the two counts."""
    t, m = F.col(terms).cast("double"), F.col(matchings).cast("double")
    return df.withColumn("pauli_match_ratio", t / F.greatest(m, F.lit(1.0))).withColumn("pauli_match_diff", t - m)
