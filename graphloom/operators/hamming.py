"""Hamming distances between the ends of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hamming_statistics(edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """Per graph: total, mean, smallest, largest distance and how many links have
    distance one or more; zeros for graphs without links."""
    d = F.bit_count(F.expr("u ^ v"))
    stats = edges.groupBy("graph_id").agg(
        F.sum(d).cast("bigint").alias("total_hamming"),
        F.avg(d).alias("avg_hamming"),
        F.min(d).alias("min_hamming"),
        F.max(d).alias("max_hamming"),
        F.count_if(d == 1).alias("hamming_1_count"),
        F.count_if(d > 1).alias("hamming_gt1_count"),
    )
    joined = graphs.select("graph_id").join(stats, "graph_id", "left")
    return joined.select(
        "graph_id",
        *[F.coalesce(c, F.lit(0).cast(stats.schema[c].dataType)).alias(c) for c in stats.columns if c != "graph_id"],
    )
