"""Standardisation, range checks, distance to a fitted distribution, two axes.

Moments come from one grouped aggregation joined back to the rows, so no group is
gathered in one task."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from graphloom.session import written


def moments(df: DataFrame, features: list[str], keys: list[str] | None = None, ddof: int = 0) -> DataFrame:
    """`(keys, __mu_f, __sd_f)`, a deviation of zero given as one."""
    keys = keys or []
    deviation = F.stddev_pop if ddof == 0 else F.stddev_samp
    cols = []
    for f in features:
        cols.append(F.avg(F.col(f).cast("double")).alias(f"__mu_{f}"))
        sd = deviation(F.col(f).cast("double"))
        # A constant column can come out a rounding error away from zero.
        flat = F.min(f) == F.max(f)
        cols.append(F.when(flat | (sd == 0), 1.0).otherwise(sd).alias(f"__sd_{f}"))
    return df.groupBy(*keys).agg(*cols)


def fixed(fitted: DataFrame) -> Row:
    """The one row of moments as numbers on the driver (two per feature)."""
    return fitted.first()


def apply_moments(df: DataFrame, fitted: DataFrame | Row, features: list[str], keys: list[str] | None = None,
                  suffix: str = "_z") -> DataFrame:
    """Scale by moments fitted elsewhere, adding `<feature><suffix>`."""
    if isinstance(fitted, Row):
        return df.withColumns({
            f"{f}{suffix}": (F.col(f).cast("double") - fitted[f"__mu_{f}"]) / fitted[f"__sd_{f}"] for f in features})
    if keys:
        # One row per group, as a table: the planner knows its size before it decides
        # between a broadcast and a shuffle of all rows.
        joined = df.join(written(fitted, "moments"), keys)
    else:
        joined = df.crossJoin(F.broadcast(fitted))  # one row of moments
    scaled = {f"{f}{suffix}": (F.col(f).cast("double") - F.col(f"__mu_{f}")) / F.col(f"__sd_{f}") for f in features}
    return joined.withColumns(scaled).drop(*[f"__{m}_{f}" for f in features for m in ("mu", "sd")])


def standardize(df: DataFrame, features: list[str], keys: list[str] | None = None, ddof: int = 0) -> DataFrame:
    """z-scores within each group of `keys`, or over all rows."""
    return apply_moments(df, moments(df, features, keys, ddof), features, keys)


def ranges(df: DataFrame, features: list[str]) -> DataFrame:
    """One row with the smallest and largest value of each feature."""
    return df.agg(*[F.min(f).alias(f"__lo_{f}") for f in features], *[F.max(f).alias(f"__hi_{f}") for f in features])


def out_of_range(df: DataFrame, train_ranges: DataFrame, features: list[str], name: str = "features_oob") -> DataFrame:
    """How many features of a row lie outside the training range."""
    outside = [((F.col(f) < F.col(f"__lo_{f}")) | (F.col(f) > F.col(f"__hi_{f}"))).cast("int") for f in features]
    total = outside[0]
    for o in outside[1:]:
        total = total + o
    joined = df.crossJoin(F.broadcast(train_ranges)).withColumn(name, total)  # one row of ranges
    return joined.drop(*[f"__{m}_{f}" for f in features for m in ("lo", "hi")])


def covariance(df: DataFrame, features: list[str]) -> np.ndarray:
    """Sample covariance of the features; features by features numbers reach the driver."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    row = df.agg(*[F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in pairs]).first()
    out = np.zeros((len(features), len(features)))
    for (a, b), value in zip(pairs, row):
        i, j = features.index(a), features.index(b)
        out[i, j] = out[j, i] = value
    return out


def inverse_covariance(df: DataFrame, features: list[str], ridge: float = 1e-6) -> np.ndarray:
    return np.linalg.inv(covariance(df, features) + ridge * np.eye(len(features)))


def mahalanobis(df: DataFrame, features: list[str], centre: list[float], inverse: np.ndarray,
                name: str = "mahalanobis") -> DataFrame:
    """Distance of each row to a distribution, as one plain expression."""
    total = F.lit(0.0)
    for i, a in enumerate(features):
        da = F.col(a).cast("double") - float(centre[i])
        for j in range(i, len(features)):
            db = F.col(features[j]).cast("double") - float(centre[j])
            total = total + da * db * float(inverse[i, j] * (1 if i == j else 2))
    return df.withColumn(name, F.sqrt(F.greatest(total, F.lit(0.0))))


def two_axes(fit_on: DataFrame, project: DataFrame, features: list[str]) -> tuple[DataFrame, list[float]]:
    """First two principal axes of `fit_on` (standardised by its own moments) and the
    coordinates of `project` on them. The sign is set so that the largest loading of
    an axis is positive. Returns the frame with pc1, pc2 and the variance shares."""
    fitted = moments(fit_on, features)
    z = [f"{f}_z" for f in features]
    assembler = VectorAssembler(inputCols=z, outputCol="__v")
    model = PCA(k=2, inputCol="__v", outputCol="__p").fit(assembler.transform(apply_moments(fit_on, fitted, features)))
    loadings = model.pc.toArray()
    signs = [math.copysign(1.0, loadings[np.abs(loadings[:, k]).argmax(), k]) for k in range(2)]
    out = model.transform(assembler.transform(apply_moments(project, fitted, features)))
    axes = vector_to_array("__p")
    out = out.withColumn("pc1", axes[0] * signs[0]).withColumn("pc2", axes[1] * signs[1]).drop("__v", "__p", *z)
    return out, [float(x) for x in model.explainedVariance.toArray()]
