"""Stored linear models: scoring, decision grids, permutation importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import mix, sigmoid
from graphloom.operators import metrics
from graphloom.operators.ordering import rank_by_hash
from graphloom.session import written

INTERCEPT = "(intercept)"


def coefficient_row(coefficients: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """`(keys, feature, coef, mean, scale)` turned into one row per key: a map from
    feature to its three numbers (one entry per feature)."""
    entry = F.struct("feature", F.struct("coef", "mean", "scale"))
    return coefficients.where(F.col("feature").isin([*features, INTERCEPT])).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(entry)).alias("__w")
    )


def linear_score(features: list[str], weights: str = "__w") -> Column:
    """sigmoid(b0 + sum of coef * (x - mean) / scale)."""
    w = F.col(weights)
    total = w[INTERCEPT]["coef"]
    for f in features:
        total = total + w[f]["coef"] * (F.col(f).cast("double") - w[f]["mean"]) / w[f]["scale"]
    return sigmoid(total)


def apply_linear(df: DataFrame, coefficients: DataFrame, features: list[str], keys: list[str], name: str = "score") -> DataFrame:
    rows = coefficient_row(coefficients, features, keys)
    if keys:
        joined = df.join(written(rows, "weights"), keys)  # one row per model, its size known to the planner
    else:
        joined = df.crossJoin(F.broadcast(rows))  # one row of weights
    return joined.withColumn(name, linear_score(features)).drop("__w")


def decision_grid(medians: DataFrame, ranges: DataFrame, coefficients: DataFrame, features: list[str], x: str, y: str,
                  steps: int, keys: list[str]) -> DataFrame:
    """Score over a grid of two features, the others at their medians.

    `medians` is `(keys, feature, median)`; `ranges` one row per key with the ends."""
    middle = medians.groupBy(*keys).pivot("feature", features).agg(F.first("median"))
    base = middle.join(ranges, keys).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    )

    def at(f: str, k: str) -> Column:
        return F.col(f"__lo_{f}") + (F.col(f"__hi_{f}") - F.col(f"__lo_{f}")) * F.col(k) / (steps - 1)

    grid = base.withColumn(x, at(x, "i")).withColumn(y, at(y, "j"))
    return apply_linear(grid, coefficients, features, keys).select(*keys, "i", "j", x, y, "score")


def permuted_copies(df: DataFrame, features: list[str], key: str, repeats: int, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Copies `(permuted, repeat, ...)` of the rows, one feature shuffled in each.

    A shuffle gives the row at position r of the key order the value at position r of
    a hash order. Positions come from cut ranks, so no task sorts all rows.
    Values move only between rows that agree in the columns `by`."""
    fixed = rank_by_hash(df, [*by], mix(key, 0), key, "__pos")
    plan = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    donors = df.select(*by, key, *features).withColumn("repeat", plan)
    donors = rank_by_hash(donors, [*by, "repeat"], mix(key, F.col("repeat") * 31 + seed + 1), key, "__pos").select(
        *by, "repeat", "__pos", *[F.col(f).alias(f"__d_{f}") for f in features]
    )
    met = fixed.join(donors, [*by, "__pos"]).withColumn("permuted", F.explode(F.array(*[F.lit(f) for f in features])))
    swapped = {f: F.when(F.col("permuted") == f, F.col(f"__d_{f}")).otherwise(F.col(f)) for f in features}
    return met.withColumns(swapped).drop("__pos", *[f"__d_{f}" for f in features])


def permutation_importance(df: DataFrame, features: list[str], key: str, predict, repeats: int = 3, seed: int = 0) -> DataFrame:
    """Mean drop of the MCC when one feature is shuffled: `(feature, importance,
    importance_std)`. `predict(frame)` adds pred; all copies are scored in one job."""
    whole = metrics.score(predict(df).withColumn("g", F.lit(0)), ["g"], ranked=False).select(F.col("mcc").alias("__base"))
    copies = predict(permuted_copies(df, features, key, repeats, seed))
    each = metrics.score(copies, ["permuted", "repeat"], ranked=False).select("permuted", "repeat", "mcc")
    drops = each.crossJoin(F.broadcast(whole)).withColumn("__drop", F.col("__base") - F.col("mcc"))  # one row
    return drops.groupBy(F.col("permuted").alias("feature")).agg(
        F.avg("__drop").alias("importance"), F.stddev_pop("__drop").alias("importance_std")
    )


def importance_over_seeds(df: DataFrame, features: list[str], key: str, predict, by: str = "seed", repeats: int = 3) -> DataFrame:
    """Importances of one model per value of `by`: `(feature, importance,
    importance_std, n_seeds)`, mean and deviation over the models' own means. `df` has
    the rows held out for each; `predict(frame)` adds pred by the model of the row's
    `by`. All features, repeats and models are shuffled and scored in one job."""
    whole = metrics.score(predict(df), [by], ranked=False).select(by, F.col("mcc").alias("__base"))
    whole = written(whole, "seed-scores")  # one row per model, its size known to the planner
    copies = predict(permuted_copies(df, features, key, repeats, by=(by,)))
    each = metrics.score(copies, [by, "permuted", "repeat"], ranked=False).join(whole, by)
    own = each.groupBy(by, F.col("permuted").alias("feature")).agg(F.avg(F.col("__base") - F.col("mcc")).alias("__mean"))
    return own.groupBy("feature").agg(
        F.avg("__mean").alias("importance"), F.stddev_pop("__mean").alias("importance_std"), F.count("*").alias("n_seeds"))


def normalised(importance: DataFrame, column: str = "importance") -> DataFrame:
    """Importances clipped at zero, as shares of their sum (of 1 if that is zero)."""
    clipped = importance.withColumn("__c", F.greatest(F.col(column), F.lit(0.0)))
    total = clipped.agg(F.sum("__c").alias("__t"))
    return clipped.crossJoin(F.broadcast(total)).withColumn(  # one row
        "share", F.col("__c") / F.when(F.col("__t") > 0, F.col("__t")).otherwise(1.0)
    ).drop("__c", "__t")
