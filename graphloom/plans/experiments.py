"""Experiment tables: model ladder, ablations, transfer between families, ensembles.

Splits are made once per seed and kept as tables in the shared folder; fits are Spark
jobs started from a few driver threads; all predictions end in one long table and are
scored together."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from graphloom.operators import labelfree, linear, metrics, sampling, scaling
from graphloom.plans import learners
from graphloom.session import written

THREADS = 4


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def split_seeds(df: DataFrame, seeds: list[int], key: str = "graph_id", parts: tuple[str, ...] = ("n_vertices", "y")) -> DataFrame:
    """One copy of the rows per seed with its split, kept as a table in which a seed's
    parts have folders of their own."""
    rows = df.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("bigint") for s in seeds])))
    return written(sampling.split_three(rows, key, list(parts), F.col("seed"), ["seed"]), "splits", "seed", "split")


def fit_and_score(train: DataFrame, test: DataFrame, features: list[str], model: str, fitted: Row | None = None) -> DataFrame:
    """`(graph_id, y, delta_cx, n_vertices, score, pred)` of the test rows; the scaler is
    fitted on the training rows only, unless their moments are given."""
    learner, scale = learners.LEARNERS[model]
    if scale and fitted is None:
        fitted = scaling.fixed(scaling.moments(train, features))
    fitted = fitted if scale else None
    scored = learner(learners.vectors(train, features, fitted), learners.vectors(test, features, fitted))
    return scored.select("graph_id", "n_vertices", "y", "delta_cx", "score", "pred")


def run_grid(jobs: list[tuple]) -> DataFrame:
    """Fit every `(tags, train, test, features, model)`, a sixth item being moments of the
    training rows; one long table of predictions."""

    def one(job):
        tags, *given = job
        out = fit_and_score(*given)
        return out.withColumns({k: F.lit(v) for k, v in tags.items()})

    with ThreadPoolExecutor(THREADS) as pool:
        return _union(list(pool.map(one, jobs)))


def ladder(df: DataFrame, features: list[str], models: list[str], seeds: list[int]) -> DataFrame:
    """Mean and deviation over seeds of every metric for every model."""
    splits = split_seeds(df, seeds)
    jobs = []
    for seed in seeds:
        mine = splits.where(F.col("seed") == seed).drop("seed")
        train, test = mine.where("split = 'train'"), mine.where("split = 'test'")
        jobs += [({"model": m, "seed": seed}, train, test, features, m) for m in models]
    scored = metrics.score(run_grid(jobs), ["model", "seed"])
    return metrics.over_seeds(scored, ["model"])


def feature_sets(df: DataFrame, sets: dict[str, list[str]], model: str, seeds: list[int], ddof: int = 0) -> DataFrame:
    """The same model on named feature sets: `(feature_set, metric, mean, std)`."""
    splits = split_seeds(df, seeds)
    named = list(dict.fromkeys(f for some in sets.values() for f in some))
    scale, jobs = learners.LEARNERS[model][1], []
    for seed in seeds:
        mine = splits.where(F.col("seed") == seed).drop("seed")
        train, test = mine.where("split = 'train'"), mine.where("split = 'test'")
        fitted = scaling.fixed(scaling.moments(train, named)) if scale else None
        jobs += [({"feature_set": s, "seed": seed}, train, test, f, model, fitted) for s, f in sets.items()]
    return metrics.over_seeds(metrics.score(run_grid(jobs), ["feature_set", "seed"]), ["feature_set"], ddof=ddof)


def drop_one(df: DataFrame, features: list[str], seeds: list[int], model: str = "logistic") -> DataFrame:
    """Each feature left out in turn, with the loss against the full model:
    `(dropped, metric, mean, std, drop)`."""
    sets = {"(none)": features, **{f: [x for x in features if x != f] for f in features}}
    table = feature_sets(df, sets, model, seeds, ddof=1).withColumnRenamed("feature_set", "dropped")
    full = table.where("dropped = '(none)'").select("metric", F.col("mean").alias("__full"))
    return table.join(full, "metric").withColumn("drop", F.col("__full") - F.col("mean")).drop("__full")


def family_transfer(df: DataFrame, family: str, folds: list[tuple[str, str]], features: list[str], model: str = "logistic") -> DataFrame:
    """Fit on one family, score on another: `(train_on, test_on, metrics...)`."""
    jobs = [({"train_on": a, "test_on": b}, df.where(F.col(family) == a), df.where(F.col(family) == b), features, model)
            for a, b in folds]
    return metrics.score(run_grid(jobs), ["train_on", "test_on"])


def per_size(df: DataFrame, features: list[str], seeds: list[int], model: str) -> DataFrame:
    """A model of its own for every size, averaged over seeds. A size whose training
    rows have one class predicts that class."""
    sizes = [r[0] for r in df.select("n_vertices").distinct().orderBy("n_vertices").collect()]  # sizes, not rows
    rows = df.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("bigint") for s in seeds])))
    splits = written(sampling.split_two(rows, "graph_id", ["seed", "n_vertices", "y"], F.col("seed")), "splits")
    classes = {(r["seed"], r["n_vertices"]): r["c"] for r in splits.where("split = 'train'").groupBy("seed", "n_vertices").agg(
        F.collect_set("y").alias("c")).collect()}  # at most two values per seed and size
    jobs, fixed = [], []
    for seed in seeds:
        for size in sizes:
            mine = splits.where((F.col("seed") == seed) & (F.col("n_vertices") == size)).drop("seed")
            train, test = mine.where("split = 'train'"), mine.where("split = 'test'")
            present = classes.get((seed, size), [])
            if len(present) < 2:
                only = int(present[0]) if present else 0
                fixed.append(test.select("graph_id", "n_vertices", "y", "delta_cx", F.lit(float(only)).alias("score"),
                                         F.lit(only).alias("pred"), F.lit(seed).alias("seed")))
            else:
                jobs.append(({"seed": seed}, train, test, features, model))
    frames = ([run_grid(jobs)] if jobs else []) + fixed
    scored = metrics.per_size(_union(frames), ["seed"])
    names = [m for m in metrics.METRICS if m in scored.columns]
    return metrics.over_seeds(scored, ["n_vertices"], names)


def ensemble_report(labelled: DataFrame, unlabelled: DataFrame, features: list[str], models: list[str], keys: list[str]) -> DataFrame:
    """Fit several models on labelled graphs, predict the unlabelled ones, and give the
    label-free estimates per group of `keys`."""
    split = written(sampling.split_two(labelled, "graph_id", ["n_vertices", "y"], 42), "labelled")
    train, val = split.where("split = 'train'"), split.where("split = 'test'")
    fitted = scaling.fixed(scaling.moments(train, features))
    z = [f"{f}_z" for f in features]
    inverse = scaling.inverse_covariance(scaling.apply_moments(train, fitted, features), z)
    target = scaling.out_of_range(scaling.apply_moments(unlabelled, fitted, features), scaling.ranges(train, features), features)
    target = written(scaling.mahalanobis(target, z, [0.0] * len(z), inverse).drop(*z), "target")
    asked = val.select("graph_id", "n_vertices", "y", "delta_cx", *features, F.lit(1).alias("__val")).unionByName(
        target.select("graph_id", "n_vertices", F.lit(None).cast("int").alias("y"), F.lit(None).cast("bigint").alias("delta_cx"),
                      *features, F.lit(0).alias("__val")))

    def one(model: str) -> DataFrame:
        learner, scale = learners.LEARNERS[model]
        moments = fitted if scale else None
        out = learner(learners.vectors(train, features, moments), learners.vectors(asked, features, moments))
        return out.select("graph_id", "y", "score", "pred", "__val", F.lit(model).alias("model"))

    with ThreadPoolExecutor(THREADS) as pool:
        long = written(_union(list(pool.map(one, models))), "predictions")
    thresholds = labelfree.confidence_thresholds(long.where("__val = 1"), ["model"])
    rows = long.where("__val = 0").drop("y", "__val").join(
        target.select("graph_id", *keys, "mahalanobis", "features_oob"), "graph_id")
    return labelfree.report(rows, thresholds, keys, "graph_id", models[0], ["mahalanobis", "features_oob"])


def forest_importance(df: DataFrame, features: list[str], repeats: int = 3, trees: int = 50) -> DataFrame:
    """Permutation importance for the cost gap: mean drop of R² on held-out rows, clipped
    at zero and normalised."""
    split = written(sampling.split_two(df, "graph_id", ["n_vertices"], 0), "split")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    copies = linear.permuted_copies(test, features, "graph_id", repeats).unionByName(
        test.withColumns({"permuted": F.lit("(none)"), "repeat": F.lit(0)}))
    predicted = learners.cost_forest(learners.vectors(train, features), learners.vectors(copies, features), trees=trees)
    each = learners.r_squared(predicted, ["permuted", "repeat"])
    whole = each.where("permuted = '(none)'").select(F.col("r2").alias("__base"))
    drops = each.where("permuted <> '(none)'").crossJoin(F.broadcast(whole))  # one row
    mean = drops.groupBy(F.col("permuted").alias("feature")).agg(F.avg(F.col("__base") - F.col("r2")).alias("importance"))
    return linear.normalised(mean)
