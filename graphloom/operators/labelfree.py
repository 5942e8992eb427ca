"""Estimates for graphs without labels, from `(graph_id, keys..., model, proba)`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.metrics import confidence
from graphloom.operators.ordering import exact_quantiles
from graphloom.session import written


def confidence_thresholds(validation: DataFrame, keys: list[str]) -> DataFrame:
    """Per model the confidence whose upper share equals the validation accuracy:
    the quantile at max(0, 1 - accuracy). `validation` has y, pred and score."""
    c = validation.withColumn("__conf", confidence("score"))
    hit = (F.col("pred") == F.col("y")).cast("double")
    levels = c.groupBy(*keys).agg(F.greatest(F.lit(0.0), 1.0 - F.avg(hit)).alias("level"))
    found = exact_quantiles(c, keys, "__conf", levels).select(*keys, F.col("quantile").alias("threshold"))
    return written(found, "thresholds")  # one row per model, its size known to later joins


def estimated_accuracy(target: DataFrame, thresholds: DataFrame, model_keys: list[str], keys: list[str]) -> DataFrame:
    """Share of target rows at or above their model's threshold."""
    joined = target.join(thresholds, model_keys)
    reached = (confidence("score") >= F.col("threshold")).cast("double")
    return joined.groupBy(*keys).agg(F.avg(reached).alias("atc_estimated_accuracy"))


def disagreement(df: DataFrame, row_keys: list[str], keys: list[str]) -> DataFrame:
    """Share of rows on which the models are not unanimous."""
    per_row = df.groupBy(*row_keys).agg((F.min("pred") != F.max("pred")).cast("double").alias("__split"))
    return per_row.groupBy(*keys).agg(F.avg("__split").alias("ensemble_disagreement"))


def report(df: DataFrame, thresholds: DataFrame, keys: list[str], row_key: str, lead_model, extra: list[str]) -> DataFrame:
    """The label-free scores per group: rows, share the lead model sends to class 1,
    disagreement, mean confidence, estimated accuracy and means of per-row columns.

    First one row per graph, then one per group; the models' means are equal-weight
    means because every graph has one row per model."""
    joined = df.join(thresholds, ["model"])
    c = confidence("score")
    per_row = joined.groupBy(*keys, row_key).agg(
        F.avg(F.when(F.col("model") == lead_model, F.col("pred").cast("double"))).alias("__lead"),
        (F.min("pred") != F.max("pred")).cast("double").alias("__split"),
        F.avg(c).alias("__conf"),
        F.avg((c >= F.col("threshold")).cast("double")).alias("__atc"),
        *[F.max(e).alias(e) for e in extra],
    )
    return per_row.groupBy(*keys).agg(
        F.count("*").alias("n_graphs"), (F.avg("__lead") * 100).alias("pct_predicted_matching"),
        F.avg("__split").alias("ensemble_disagreement"), F.avg("__conf").alias("mean_confidence"),
        F.avg("__atc").alias("atc_estimated_accuracy"), *[F.avg(e).alias(f"mean_{e}") for e in extra],
    )


def per_model(df: DataFrame, keys: list[str], models: list, row_key: str) -> DataFrame:
    """Per group one column per model with the share it sends to class 1 (percent, one
    decimal), and the disagreement."""
    wide = df.groupBy(*keys).pivot("model", models).agg(F.round(F.avg(F.col("pred").cast("double")) * 100, 1))
    return wide.join(disagreement(df, [*keys, row_key], keys), keys)
