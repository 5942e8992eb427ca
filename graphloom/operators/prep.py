"""Joining features and labels, work lists, enrichment columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(features: DataFrame, labels: DataFrame, columns: list[str] | None = None, key: str = "graph_id") -> DataFrame:
    """Features with the label columns; a column both sides have is kept from the left."""
    wanted = [c for c in (columns or labels.columns) if c != key and c not in features.columns]
    return features.join(labels.select(key, *wanted), key)


def unlabelled(features: DataFrame, labels: DataFrame, key: str = "graph_id") -> DataFrame:
    return features.join(labels.select(key), key, "left_anti")


def with_labels_only(features: DataFrame, labels: DataFrame, key: str = "graph_id") -> DataFrame:
    return features.join(labels.select(key), key, "left_semi")


def enrich(table: DataFrame, extra: DataFrame, key: str = "graph_id") -> DataFrame:
    """Add or replace columns by a left join; `extra` is made unique by key first (the
    smallest row by its columns in order), so the number of rows cannot change."""
    new = [c for c in extra.columns if c != key]
    unique = _one_per_key(extra, key)
    return table.drop(*[c for c in new if c in table.columns]).join(unique, key, "left")


def _one_per_key(extra: DataFrame, key: str) -> DataFrame:
    new = [c for c in extra.columns if c != key]
    return extra.groupBy(key).agg(F.min(F.struct(*new)).alias("__row")).select(key, *[F.col("__row")[c].alias(c) for c in new])


def fill_missing(table: DataFrame, extra: DataFrame, key: str = "graph_id") -> DataFrame:
    """Keep what a row has and take only missing values from `extra`."""
    new = [c for c in extra.columns if c != key]
    renamed = _one_per_key(extra, key).select(key, *[F.col(c).alias(f"__new_{c}") for c in new])
    joined = table.join(renamed, key, "left")
    out = [F.coalesce(F.col(c), F.col(f"__new_{c}")).alias(c) if c in new else F.col(c) for c in table.columns]
    out += [F.col(f"__new_{c}").alias(c) for c in new if c not in table.columns]
    return joined.select(*out)


def work_list(table: DataFrame, column: str) -> DataFrame:
    """Rows whose group of enrichment columns has not been computed."""
    return table.where(F.col(column).isNull())


def not_refreshed(table: DataFrame, stamp: str, max_n: int, size: str = "n_vertices") -> DataFrame:
    """Rows within the size gate that carry no stamp; a missing stamp counts as none."""
    return table.where((F.col(size) <= max_n) & ~F.coalesce(F.col(stamp), F.lit(False)))


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)
