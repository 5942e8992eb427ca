"""Decision quality of any number of models, seeds and datasets in one job.

Input is a long table `(keys..., y, pred, score, delta_cx)`. Rows are first merged by
(keys, score): every metric is a sum over these, or a running sum over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import safe_div
from graphloom.operators.ordering import exact_quantiles, running_totals

METRICS = ["accuracy", "precision", "recall", "specificity", "npv", "f1", "mcc", "cohen_kappa",
           "roc_auc", "pr_auc", "log_loss", "savings"]
CLIP = 1e-15


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    """tn, fp, fn, tp and the sums savings are made of."""
    y, p, d = F.col("y"), F.col("pred"), F.col("delta_cx")
    return df.groupBy(*keys).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.sum(F.when(p == 1, d).otherwise(0)).alias("captured"),
        F.sum(F.when(d > 0, d).otherwise(0)).alias("realizable"),
    )


def from_confusion(df: DataFrame) -> DataFrame:
    """All metrics that follow from tn, fp, fn, tp, captured, realizable."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    both = (tp + fn > 0) & (tn + fp > 0)
    mcc = safe_div(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))
    expected = safe_div((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn), n * n)
    return df.withColumns({
        "accuracy": safe_div(tp + tn, n),
        "precision": _zero(safe_div(tp, tp + fp)),
        "recall": _zero(safe_div(tp, tp + fn)),
        "specificity": safe_div(tn, tn + fp),
        "npv": safe_div(tn, tn + fn),
        "f1": _zero(safe_div(2 * tp, 2 * tp + fp + fn)),
        "mcc": F.when(both, _zero(mcc)).otherwise(0.0),
        "cohen_kappa": safe_div(safe_div(tp + tn, n) - expected, 1.0 - expected),
        "savings": F.when(F.col("realizable") > 0, F.col("captured").cast("double") / F.col("realizable")),
    })


def by_score(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, score) with positives and negatives."""
    return df.groupBy(*keys, "score").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )


def ranking_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """roc_auc (ties at half), pr_auc (average precision) and log_loss per group.

    Going down the scores, tp and fp at a threshold include its ties. log_loss is
    given only where all scores lie in [0, 1]."""
    run = running_totals(scored, keys, "score", {"pos": "tp", "neg": "fp"}, {"pos": "P", "neg": "N"}, descending=True)
    p, n, tp, fp = (F.col(c).cast("double") for c in ("P", "N", "tp", "fp"))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    s = F.least(F.greatest(F.col("score"), F.lit(CLIP)), F.lit(1 - CLIP))
    return run.groupBy(*keys).agg(
        # Each positive beats the negatives not yet seen, and half of those tied with it.
        safe_div(F.sum(pos * (n - fp + neg / 2)), F.max(p) * F.max(n)).alias("roc_auc"),
        F.when(F.max(n) > 0, safe_div(F.sum(pos * tp / (tp + fp)), F.max(p))).alias("pr_auc"),
        F.when(
            (F.min("score") >= 0) & (F.max("score") <= 1) & (F.max(p) > 0) & (F.max(n) > 0),
            -F.sum(pos * F.log(s) + neg * F.log(1.0 - s)) / (F.max(p) + F.max(n)),
        ).alias("log_loss"),
    )


def score(df: DataFrame, keys: list[str], ranked: bool = True) -> DataFrame:
    """The twelve metrics and the confusion counts, one row per group of `keys`."""
    merged = confusion(df, [*keys, "score"]) if ranked else confusion(df, keys)
    if not ranked:
        return from_confusion(merged).drop("captured", "realizable")
    counts = ["tn", "fp", "fn", "tp", "captured", "realizable"]
    flat = from_confusion(merged.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts]))
    scored = merged.where("score is not null").select(
        *keys, "score", F.expr("fn + tp").alias("pos"), F.expr("tn + fp").alias("neg")
    )
    curves = ranking_metrics(scored, keys)
    return flat.join(curves, keys, "left").select(*keys, *METRICS, "tn", "fp", "fn", "tp")


def long_form(metrics: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """`(keys, metric, value)`, NaN given as NULL."""
    names = names or METRICS
    cast = metrics.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    out = cast.unpivot([F.col(k) for k in keys], [F.col(c) for c in names], "metric", "value")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def over_seeds(metrics: DataFrame, keys: list[str], names: list[str] | None = None, ddof: int = 0) -> DataFrame:
    """Mean and deviation over seeds, missing values left out: `(keys, metric, mean, std)`."""
    deviation = F.stddev_pop if ddof == 0 else F.stddev_samp
    return long_form(metrics, [*keys, "seed"], names).groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), deviation("value").alias("std")
    )


def roc_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, fpr, tpr), one point per distinct score."""
    run = running_totals(by_score(df, keys), keys, "score", {"pos": "tp", "neg": "fp"}, {"pos": "P", "neg": "N"}, descending=True)
    return run.select(*keys, "score", safe_div(F.col("fp"), F.col("N")).alias("fpr"), safe_div(F.col("tp"), F.col("P")).alias("tpr"))


def pr_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, recall, precision, no_skill), one point per distinct score."""
    run = running_totals(by_score(df, keys), keys, "score", {"pos": "tp", "neg": "fp"}, {"pos": "P", "neg": "N"}, descending=True)
    return run.select(
        *keys, "score", safe_div(F.col("tp"), F.col("P")).alias("recall"),
        safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe_div(F.col("P"), F.col("P") + F.col("N")).alias("no_skill"),
    )


def threshold_rule(df: DataFrame, keys: list[str], value: str, y: str = "y") -> DataFrame:
    """The one threshold with the highest MCC per group, tried in both directions.

    `low_is_match` 1 means value <= t goes to class 1, 0 means value > t. The first
    best wins: smaller threshold first, then the low direction."""
    counted = df.groupBy(*keys, value).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    run = running_totals(counted, keys, value, {"pos": "lp", "neg": "ln"}, {"pos": "P", "neg": "N"})
    lp, ln, p, n = (F.col(c).cast("double") for c in ("lp", "ln", "P", "N"))
    below, above = lp + ln, (p + n) - (lp + ln)
    spread = F.sqrt(below) * F.sqrt(above) * F.sqrt(p) * F.sqrt(n)
    mcc = _zero(safe_div(lp * (n - ln) - ln * (p - lp), spread))
    both = run.withColumn("side", F.explode(F.array(F.lit(1), F.lit(0)))).withColumn(
        "mcc", F.round(F.when(F.col("side") == 1, mcc).otherwise(-mcc), 12)
    )
    best = F.max_by(
        F.struct(F.col(value).alias("threshold"), F.col("side").alias("low_is_match"), F.col("mcc")),
        F.struct(F.col("mcc"), -F.col(value), F.col("side")),
    )
    return both.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.threshold", "b.low_is_match", "b.mcc")


def uniform_calibration(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Mean score and observed rate in equal-width bins of [0, 1]; a score on an edge
    belongs to the bin it closes, and empty bins give no row."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    b = F.size(F.filter(edges, lambda e: e < F.col("score")))
    return df.groupBy(*keys, b.alias("bin")).agg(
        F.avg("score").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("observed"), F.count("*").alias("n_rows")
    )


def quantile_calibration(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """The same with bins between exact quantiles of the scores of a group."""
    edges = exact_quantiles(df, keys, "score", [i / bins for i in range(1, bins)])
    lists = edges.groupBy(*keys).agg(F.array_sort(F.collect_list("quantile")).alias("edges"))  # bins - 1 numbers
    merged = df.groupBy(*keys, "score").agg(F.sum("y").alias("pos"), F.count("*").alias("c"))
    placed = merged.join(lists, keys).withColumn("bin", F.expr("size(filter(edges, e -> e < score))"))
    return placed.groupBy(*keys, "bin").agg(
        (F.sum(F.col("score") * F.col("c")) / F.sum("c")).alias("mean_score"),
        (F.sum("pos") / F.sum("c")).alias("observed"), F.sum("c").alias("n_rows"),
    )


def per_size(df: DataFrame, keys: list[str], size: str = "n_vertices") -> DataFrame:
    """Metrics per size; class-conditional ones are NULL where a size has one class."""
    scored = score(df, [*keys, size])
    single = (F.col("tp") + F.col("fn") == 0) | (F.col("tn") + F.col("fp") == 0)
    conditional = [m for m in METRICS if m not in ("accuracy", "cohen_kappa", "log_loss")]
    return scored.select(
        *keys, size, (F.col("tp") + F.col("fn")).alias("matching_wins"), single.cast("int").alias("single_class"),
        "accuracy", *[F.when(~single, F.col(m)).alias(m) for m in conditional],
    )


def confidence(c: Column | str) -> Column:
    p = F.col(c) if isinstance(c, str) else c
    return F.greatest(p, 1.0 - p)


def selective(df: DataFrame, keys: list[str], bar: float = 0.9) -> DataFrame:
    """Mean confidence and accuracy of all rows, and coverage and accuracy of the rows
    whose confidence reaches the bar."""
    c = confidence("score")
    hit = (F.col("pred") == F.col("y")).cast("double")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_graphs"), F.avg(c).alias("mean_confidence"), F.avg(hit).alias("accuracy_all"),
        F.avg((c >= bar).cast("double")).alias("coverage"), F.avg(F.when(c >= bar, hit)).alias("accuracy_conf"),
    )
