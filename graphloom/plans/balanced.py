"""The balanced training set: two or more labelled collections, evened out by size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import prep, reports, sampling
from graphloom.session import counted_in, written
from graphloom.sources import tables

SOURCE = "source_dataset"


def tagged(collections: dict[str, DataFrame]) -> DataFrame:
    """Union of the collections with the name of each as a column."""
    frames = [df.withColumn(SOURCE, F.lit(name)) for name, df in collections.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def build(features: DataFrame, labels: DataFrame, seed: int = 0, size: str = "n_vertices",
          key: str = "graph_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """`(features, labels, composition)` of the balanced set.

    `features` and `labels` carry the source column. Within each size both classes get
    as many graphs as the scarcer one has, ties left out; graphs without a label stay in
    the features. Composition gives what was there and what was taken per size."""
    joined = sampling.label(prep.labelled(features, labels, key=key))
    # Read three times below.
    joined = written(joined, "labelled")
    picked = written(sampling.balance_within(joined, size, "y", key, seed), "balanced")
    columns = [SOURCE, *[c for c in features.columns if c != SOURCE]]
    feature_rows = picked.select(*columns).unionByName(prep.unlabelled(features, labels, key).select(*columns))
    label_columns = [c for c in labels.columns if c != SOURCE]
    label_rows = picked.select(SOURCE, *label_columns)
    return feature_rows, label_rows, reports.composition(joined, picked, size, SOURCE)


def write(features: DataFrame, labels: DataFrame, composition: DataFrame, path: str, delta: str = "delta_cx") -> dict[str, int]:
    """Feature and label tables partitioned by size, and the composition as JSON.
    Returns the counters of the set, from its tables."""
    counted = [F.count_if(F.col(delta) > 0).alias("matching"), F.count_if(F.col(delta) < 0).alias("pauli")]
    tables.write_table(features, f"{path}/features")
    tables.write_table(labels, f"{path}/labels")
    composition.write.json(f"{path}/composition")
    spark = features.sparkSession
    stats = counted_in(spark.read.schema(features.schema).parquet(f"{path}/features"), F.count(F.lit(1)).alias("graphs"))
    stats |= counted_in(spark.read.schema(labels.schema).parquet(f"{path}/labels"), F.count(F.lit(1)).alias("labelled"), *counted)
    stats["unlabelled"] = stats.get("graphs", 0) - stats.get("labelled", 0)
    tables.write_manifest(tables.counted(spark, "balanced", stats), {"by": "n_vertices"}, f"{path}/manifest")
    return stats
