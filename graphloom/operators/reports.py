"""Reports over labelled collections: balance, composition, histograms, cost growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.ordering import exact_quantiles
from graphloom.session import written

# The verdict bounds and the share that marks a feature near-constant.
SEVERE, IMBALANCED, DEGENERATE = 0.05, 0.20, 0.90


def balance_report(df: DataFrame, keys: list[str], delta: str = "delta_cx") -> DataFrame:
    """Wins, ties, minority share, majority to minority ratio and a verdict."""
    d = F.col(delta)
    counted = df.groupBy(*keys).agg(
        F.count("*").alias("n_graphs"), F.count_if(d > 0).alias("matching_wins"),
        F.count_if(d < 0).alias("pauli_wins"), F.count_if(d == 0).alias("ties"),
    )
    low, high = F.least("matching_wins", "pauli_wins"), F.greatest("matching_wins", "pauli_wins")
    minority = F.round(low / F.col("n_graphs"), 4)
    return counted.select(
        *keys, "n_graphs", "matching_wins", "pauli_wins", "ties",
        F.round(F.col("matching_wins") / F.col("n_graphs"), 4).alias("matching_win_frac"),
        minority.alias("minority_frac"),
        F.round(high / F.greatest(low, F.lit(1)), 1).alias("imbalance_ratio"),
        F.when(minority < SEVERE, "severely imbalanced").when(minority < IMBALANCED, "imbalanced")
        .otherwise("reasonably balanced").alias("verdict"),
    )


def win_rate_by(df: DataFrame, keys: list[str], delta: str = "delta_cx") -> DataFrame:
    d = F.col(delta)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_graphs"),
        F.round(F.avg((d > 0).cast("double")), 3).alias("matching_win_rate"),
        F.round(F.avg(d.cast("double")), 1).alias("mean_delta_cx"),
    )


def long_features(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """`(keys, feature, value)` with values as DOUBLE."""
    cast = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    return cast.unpivot([F.col(k) for k in keys], [F.col(f) for f in features], "feature", "value")


def modal_fractions(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Share of rows at the commonest value of each feature; near-constant ones flagged."""
    counts = long_features(df, keys, features).where("value is not null").groupBy(*keys, "feature", "value").agg(
        F.count("*").alias("c")
    )
    frac = F.round(F.max("c") / F.sum("c"), 3)
    return counts.groupBy(*keys, "feature").agg(
        frac.alias("mode_frac"), (frac >= DEGENERATE).cast("int").alias("degenerate")
    )


def composition(df: DataFrame, taken: DataFrame, group: str, source: str, y: str = "y") -> DataFrame:
    """Per group: available rows by class, rows taken by a balanced pick, and from
    which sources the rows taken of each class come, as a map (NULL if none)."""
    available = df.groupBy(group).agg(
        F.count_if(F.col(y) == 1).alias("matching_avail"), F.count_if(F.col(y) == 0).alias("pauli_avail"))
    by_source = taken.groupBy(group, source).agg(
        F.count_if(F.col(y) == 1).alias("m"), F.count_if(F.col(y) == 0).alias("p")
    )

    def mapping(c: str) -> Column:
        # One entry per source of a group.
        pairs = F.collect_list(F.when(F.col(c) > 0, F.struct(F.col(source), F.col(c))))
        return F.to_json(F.map_from_entries(F.array_sort(pairs)))

    sources = by_source.groupBy(group).agg(mapping("m").alias("matching_from"), mapping("p").alias("pauli_from"))
    return (available.withColumn("take_per_class", F.least("matching_avail", "pauli_avail")).join(sources, group, "left")
            .withColumn("total", F.col("take_per_class") * 2))


def medians(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Exact median of each feature: `(keys, feature, median)`."""
    q = exact_quantiles(long_features(df, keys, features), [*keys, "feature"], "value", [0.5])
    return q.select(*keys, "feature", F.col("quantile").alias("median"))


def correlation(df: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """Pearson matrix as `(keys, a, b, r)`, all pairs in one aggregation."""
    keys = keys or []
    pairs = [(a, b) for a in features for b in features]
    upper = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    wide = df.groupBy(*keys).agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in upper]
    )
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`" if (a, b) in upper else f"`{b}|{a}`").alias("r"))
        for a, b in pairs
    ]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.a", "c.b", "c.r")


def histogram(df: DataFrame, value: Column, bins: int, keys: list[str], shared: bool = True) -> DataFrame:
    """Counts and normalised density in equal-width bins between the smallest and the
    largest value, of all rows or of each group; the last bin takes its right edge."""
    rows = df.select(*keys, value.cast("double").alias("__x")).where("__x is not null")
    ends = rows.groupBy(*([] if shared else keys)).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    # One row, or one row per group as a table whose size the planner knows.
    placed = rows.crossJoin(F.broadcast(ends)) if shared else rows.join(written(ends, "ends"), keys)
    width = F.col("__hi") - F.col("__lo")
    b = F.when(width == 0, 0).otherwise(
        F.least(F.floor((F.col("__x") - F.col("__lo")) / width * bins), F.lit(bins - 1))
    ).cast("int")
    counts = placed.groupBy(*keys, b.alias("bin"), "__lo", "__hi").agg(F.count("*").alias("n_rows"))
    if keys:
        sizes = counts.groupBy(*keys).agg(F.sum("n_rows").alias("__n"))
        counts = counts.join(sizes, keys)
    else:
        counts = counts.crossJoin(F.broadcast(counts.agg(F.sum("n_rows").alias("__n"))))  # one row
    step = (F.col("__hi") - F.col("__lo")) / bins
    return counts.select(
        *keys, "bin", (F.col("__lo") + F.col("bin") * step).alias("left_edge"), "n_rows",
        F.when(step > 0, F.col("n_rows") / (F.col("__n") * step)).alias("density"),
    )


def value_histogram(df: DataFrame, value: str, keys: list[str], few: int = 12, bins: int = 30) -> DataFrame:
    """Counts per value where a column has at most `few` distinct values; else in `bins`
    equal bins between the smallest and the largest value, named by their left edges."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    whole = counts.groupBy(value).agg(F.lit(1).alias("__one")).agg(
        F.count("*").alias("__d"), F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    place = F.least(F.floor((F.col(value) - F.col("__lo")) / width), F.lit(bins - 1))
    edge = F.when(F.col("__d") <= few, F.col(value).cast("double")).otherwise(F.col("__lo") + place * width)
    return counts.crossJoin(F.broadcast(whole)).groupBy(*keys, edge.alias(value)).agg(F.sum("__n").alias("n_rows"))  # one row


def cost_growth(df: DataFrame, keys: list[str], n: str, seconds: str, targets: list[int]) -> DataFrame:
    """Power law t = a n^b fitted on logarithms, and the cost it gives at other sizes."""
    x, t = F.log(F.col(n).cast("double")), F.log(F.col(seconds))
    fit = df.where((F.col(seconds) > 0) & (F.col(n) > 0)).groupBy(*keys).agg(
        F.regr_slope(t, x).alias("exponent_b"), F.regr_intercept(t, x).alias("__a")
    )
    return fit.withColumn("n_vertices", F.explode(F.array(*[F.lit(v) for v in targets]))).select(
        *keys, "n_vertices",
        F.exp(F.col("__a") + F.col("exponent_b") * F.log(F.col("n_vertices").cast("double"))).alias("projected_seconds"),
        "exponent_b",
    )


def cost_to_go(done: DataFrame, remaining: DataFrame, n: str, seconds: str) -> DataFrame:
    """Seconds still to spend per size: what is left times the mean time of that size,
    or the largest measured mean (1.0 if nothing is measured) for sizes not timed."""
    means = done.groupBy(n).agg(F.avg(seconds).alias("__mean"))
    worst = means.agg(F.coalesce(F.max("__mean"), F.lit(1.0)).alias("__worst"))
    left = remaining.groupBy(n).agg(F.count("*").alias("remaining"))
    return left.join(means, n, "left").crossJoin(F.broadcast(worst)).select(  # one row
        n, "remaining", (F.col("remaining") * F.coalesce("__mean", "__worst")).alias("seconds_left")
    )


def filled_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with all, some and none of the columns present."""
    there = [F.col(c).isNotNull().cast("int") for c in columns]
    n = there[0]
    for t in there[1:]:
        n = n + t
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(n == len(columns)).alias("all_filled"),
        F.count_if((n > 0) & (n < len(columns))).alias("partly_filled"), F.count_if(n == 0).alias("none_filled"),
    )


def interleave_rankings(ranked: DataFrame, dataset_order: dict[str, int], top: int) -> DataFrame:
    """Merge rankings `(dataset, feature, importance)` by taking the best of each dataset
    in turn, first seen wins. The table has features times datasets rows."""
    place = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("importance"), "feature"))
    turn = F.create_map(*[x for k, v in dataset_order.items() for x in (F.lit(k), F.lit(v))])[F.col("dataset")]
    placed = ranked.withColumn("__place", place).withColumn("__turn", turn)
    first = placed.groupBy("feature").agg(F.min(F.struct("__place", "__turn")).alias("__at"))
    best = first.orderBy("__at").limit(top)
    order = F.row_number().over(Window.orderBy("__at"))  # over at most `top` rows
    return best.select(order.alias("position"), "feature")


def top_per_group(df: DataFrame, keys: list[str], metric: str, name: str) -> DataFrame:
    """The row with the highest metric of each group, ties by name."""
    best = F.min_by(F.struct(name, metric), F.struct(-F.col(metric), F.col(name)))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, f"b.{name}", f"b.{metric}")


def mode_of(df: DataFrame, column: str) -> DataFrame:
    """Commonest value, the smallest on ties: one row."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), column).limit(1)
