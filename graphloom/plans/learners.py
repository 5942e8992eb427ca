"""Classifiers fitted on Spark, and two that are plain SQL.

Entries of `LEARNERS` take `(train, rows)` with a vector column `features`, a 0/1
column `y` (and `weight`, if weighting is asked) and return `rows` with `score` and
`pred`. Boosting under three names is one engine with three presets; the RBF machine
stands on landmarks; the network has sigmoid units only. Learners that Spark ML hasn't
got are estimators here, so that one cross-validation covers all grids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.scalars import safe_div, sigmoid
from graphloom.operators import metrics, neighbors, reports, sampling, scaling
from graphloom.operators.ordering import running_totals
from graphloom.session import written

#: Trees of forests grow until their leaves are pure, or to the depth Spark allows.
DEPTH = 30
#: Leaves that the upper parts of a batch of trees may have together: the driver holds one batch.
LEAVES = 400_000
#: Levels of the upper part of a tree, or more where nodes below would have over TWIG points.
TOP, TWIG = 6, 4096
#: Votes of a batch of trees; pairs of a tree and a point or a row in a task.
PAIRS, TASK_PAIRS = 100_000_000, 250_000
#: Bins of a feature in a forest.
BINS = 32
STEP = np.uint64(0x9E3779B97F4A7C15)
Learner = Callable[[DataFrame, DataFrame], DataFrame]


def vectors(df: DataFrame, features: list[str], fitted: DataFrame | Row | None = None) -> DataFrame:
    """Adds the vector column, scaled by `fitted` moments if given."""
    if fitted is None:
        return VectorAssembler(inputCols=features, outputCol="features").transform(df)
    scaled = scaling.apply_moments(df, fitted, features)
    z = [f"{f}_z" for f in features]
    return VectorAssembler(inputCols=z, outputCol="features").transform(scaled).drop(*z)


def _scored(model, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    return out.withColumn("score", vector_to_array("probability")[1]).withColumn("pred", F.col("prediction").cast("int")).drop(
        "rawPrediction", "probability", "prediction", "features")


def _width(df: DataFrame) -> int:
    return df.schema["features"].metadata["ml_attr"]["num_attrs"]


def _common(train: DataFrame) -> dict:
    given = {"labelCol": "y", "featuresCol": "features"}
    if "weight" in train.columns:
        given["weightCol"] = "weight"
    return given


def logistic_model(train: DataFrame, c: float = 1.0, max_iter: int = 100):
    """Penalty strength 1 / (C N), on standardised features as they are."""
    return LogisticRegression(regParam=1.0 / (c * train.count()), elasticNetParam=0.0, standardization=False,
                              maxIter=max_iter, **_common(train)).fit(train)


def logistic(train: DataFrame, rows: DataFrame) -> DataFrame:
    return _scored(logistic_model(train), rows)


def tree(depth: int) -> Learner:
    return lambda train, rows: _scored(DecisionTreeClassifier(maxDepth=depth, seed=0, **_common(train)).fit(train), rows)


def batches(points: int, rows: int, trees: int) -> list[int]:
    """Trees per batch. A tree has at most one leaf per different point in its upper part,
    so whatever the number of rows and trees, a batch stays near LEAVES leaves in the
    driver and near PAIRS votes in the folder (or is one tree)."""
    leaves = min(points, 2 ** top_depth(points))
    most = max(1, min(trees, LEAVES // max(1, leaves), PAIRS // max(1, rows)))
    return [min(most, trees - at) for at in range(0, trees, most)]


def top_depth(points: int) -> int:
    """Levels of the upper part of a tree: below, a node has about TWIG points."""
    return min(DEPTH, max(TOP, (points // TWIG).bit_length()))


def bin_ends(train: DataFrame) -> list[list[float]]:
    """The upper ends of the bins of each feature but the last bin's: its values where
    there are at most BINS of them, else quantiles."""
    long = train.select(F.posexplode(vector_to_array("features")).alias("f", "v"))
    share = [i / BINS for i in range(1, BINS)]
    found = {r["f"]: r for r in long.groupBy("f").agg(F.percentile_approx("v", share, 10_000).alias("q"), F.approx_count_distinct("v").alias("n")).collect()}
    few = [f for f, r in found.items() if r["n"] <= 2 * BINS]
    values: dict[int, list[float]] = {}
    for r in long.where(F.col("f").isin(few)).distinct().collect():  # about 2 * BINS values of a feature
        values.setdefault(r["f"], []).append(r["v"])
    return [sorted(values[f])[:-1] if len(values.get(f, ())) in range(1, BINS + 1) else sorted(set(found[f]["q"])) for f in sorted(found)]


def binned(df: DataFrame, ends: list[list[float]]) -> DataFrame:
    """df with `__code`, the bins of its features."""
    def run(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(ends))
        codes = np.column_stack([np.searchsorted(e, rows[:, f]) for f, e in enumerate(ends)]).astype(np.int8)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(ends), pa.int32()), pa.array(codes.ravel()))

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return df.withColumn("__code", F.arrow_udf(run, T.ArrayType(T.ByteType()))(vector_to_array("features")))


def spread_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson numbers of the given means for uniform numbers u."""
    out = np.zeros(len(u))
    for m in np.unique(mean):
        k = np.arange(1, int(m + 12 * m**0.5 + 24))
        log = np.concatenate([[0.0], np.cumsum(np.log(m / k))]) - m
        at = mean == m
        out[at] = np.searchsorted(np.cumsum(np.exp(log)), u[at], side="right")
    return out


def twigs(at: np.ndarray, codes: np.ndarray, y: np.ndarray, w: np.ndarray, ident: np.ndarray, to: np.ndarray, asked: np.ndarray,
          features: int, depth: int) -> np.ndarray:
    """The votes for the rows `asked` (bins) in the nodes `to`. Each node is grown to pure
    leaves from the points in it, (bins, y, weight w) in the nodes `at`: all nodes a level
    at a time, by the largest drop of the variance (for y of 0 and 1 that of Gini) over
    `features` features drawn by the node's hash. Nodes without rows aren't grown."""
    out, row = np.zeros(len(asked)), np.arange(len(asked))
    for level in range(depth + 1):
        used, to = np.unique(to, return_inverse=True)
        place = np.full(len(ident), -1)
        place[used] = np.arange(len(used))
        kept = place[at] >= 0
        at, codes, y, w, ident = place[at[kept]], codes[kept], y[kept], w[kept], ident[used]
        k, every = len(used), np.arange(len(at))
        total = np.bincount(at, w, k)
        mean = np.bincount(at, w * y, k) / total
        away = w * (y - mean[at])
        drawn = np.argsort(spread_bits(ident[:, None] + np.arange(1, codes.shape[1] + 1, dtype=np.uint64) * STEP), axis=1)[:, :features]
        best, feature, end = np.zeros(k), np.zeros(k, int), np.zeros(k, int)
        for j in range(features if level < depth else 0):
            cell = at * BINS + codes[every, drawn[at, j]]
            left = np.bincount(cell, w, k * BINS).reshape(k, BINS).cumsum(axis=1)[:, :-1]
            gap = np.bincount(cell, away, k * BINS).reshape(k, BINS).cumsum(axis=1)[:, :-1]
            right = total[:, None] - left
            some = (left > 1e-9 * total[:, None]) & (right > 1e-9 * total[:, None])
            gain = np.where(some, gap**2 * total[:, None], 0.0) / np.where(some, left * right, 1.0)
            cut = gain.argmax(axis=1)
            gain = gain[np.arange(k), cut]
            more = gain > best
            best[more], feature[more], end[more] = gain[more], drawn[more, j], cut[more]
        inner = best > 1e-20 * total * (1 + mean**2)
        out[row[~inner[to]]] = mean[to[~inner[to]]]
        stay, kept = inner[to], inner[at]
        if not stay.any():
            return out
        row, to, asked = row[stay], to[stay], asked[stay]
        at, codes, y, w = at[kept], codes[kept], y[kept], w[kept]
        to = 2 * to + (asked[np.arange(len(to)), feature[to]] > end[to])
        at = 2 * at + (codes[np.arange(len(at)), feature[at]] > end[at])
        ident = spread_bits(np.repeat(ident, 2) + np.tile(np.arange(1, 3, dtype=np.uint64), k) * STEP)
    return out


def _bins_of(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def grown(train: DataFrame, rows: DataFrame, trees: int, top: Callable, target: str, features: int) -> DataFrame:
    """`rows` with `__mean`, the mean of the trees. Spark ML's forest `top(trees, depth, seed)`
    grows the upper levels over the bins of all rows; below, the points of each of its leaves
    meet the rows that land there, many leaves in a task, and are grown to the end (`twigs`)
    on a bag of their own: a point of n rows counts as often as a Poisson number of mean n
    says, drawn by the hash of point and tree. Equal points are one; the driver sees only
    upper levels."""
    extra = [c for c in ("weight",) if c in train.columns]
    ends = bin_ends(train)
    vector = array_to_vector(F.col("__code").cast("array<double>")).alias("features")
    held = written(binned(train, ends).select("__code", F.col(target).cast("double").alias(target), *extra), "forest-train")
    points = held.groupBy("__code", target, *extra).agg(F.count("*").cast("double").alias("__m"))
    points = written(points.withColumn("__h", F.xxhash64("__code", target)), "forest-points")
    asked = written(binned(rows, ends), "forest-rows")
    codes = written(asked.select("__code").distinct(), "forest-codes")
    n, most = points.count(), codes.count()
    fitted, depth, votes = held.select(vector, target, *extra), top_depth(n), None
    schema = T.StructType([T.StructField("__code", T.ArrayType(T.ByteType())), T.StructField("__vote", T.DoubleType())])

    def run(known: pa.Table, open_: pa.Table) -> pa.Table:
        if not len(open_):
            return pa.table({"__code": pa.array([], pa.list_(pa.int8())), "__vote": pa.array([], pa.float64())})
        tree, leaf, h = (known.column(c).to_numpy().astype(np.int64) for c in ("__tree", "__leaf", "__h"))
        node, at = np.unique(tree << 32 | leaf, return_inverse=True)
        u = spread_bits(h.view(np.uint64) + (tree + 1).astype(np.uint64) * STEP)
        m, w = known.column("__m").to_numpy(), known.column("__w").to_numpy()
        bag = poisson(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53, m)
        bag = np.where(np.bincount(at, bag)[at] > 0, bag, m) * w  # a node out of the bag takes its points as they are
        into, some = np.searchsorted(node, open_.column("__tree").to_numpy().astype(np.int64) << 32 | open_.column("__leaf").to_numpy()), bag > 0
        got = twigs(at[some], _bins_of(known.column("__code"))[some], known.column("__y").to_numpy()[some], bag[some],
                    spread_bits(node.view(np.uint64) * STEP), into, _bins_of(open_.column("__code")), features, DEPTH - depth)
        return pa.table({"__code": open_.column("__code"), "__vote": pa.array(got)})

    first = 0
    for seed, some in enumerate(batches(n, most, trees)):
        model = top(some, depth, seed).setLeafCol("__at").fit(fitted)
        parts = max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(n + most) * some // TASK_PAIRS))

        def placed(df: DataFrame, *columns) -> DataFrame:
            leaves = model.transform(df.withColumn("features", vector)).select(F.posexplode(vector_to_array("__at")).alias("__tree", "__leaf"), "__code", *columns)
            leaves = leaves.withColumns({"__tree": F.col("__tree") + first, "__leaf": F.col("__leaf").cast("int")})
            return leaves.withColumn("__task", F.pmod(F.xxhash64("__tree", "__leaf"), F.lit(parts)).cast("int")).groupBy("__task")

        known = placed(points, "__h", "__m", F.col(target).alias("__y"), (F.col("weight").cast("double") if extra else F.lit(1.0)).alias("__w"))
        one = known.cogroup(placed(codes)).applyInArrow(run, schema).groupBy("__code").agg(F.sum("__vote").alias("__vote"))
        one, first = written(one, "forest"), first + some
        votes = one if votes is None else votes.unionByName(one)
    votes = votes.groupBy("__code").agg((F.sum("__vote") / trees).alias("__mean"))
    return asked.join(votes, "__code").drop("__code")


def forest(trees: int = 200) -> Learner:
    def run(train: DataFrame, rows: DataFrame) -> DataFrame:
        def top(some: int, depth: int, seed: int):
            return RandomForestClassifier(numTrees=some, maxDepth=depth, maxBins=BINS, seed=seed, **_common(train))

        out = grown(train, rows, trees, top, "y", int(np.ceil(_width(train) ** 0.5)))
        return out.withColumnRenamed("__mean", "score").withColumn("pred", (F.col("score") > 0.5).cast("int")).drop("features")

    return run


def boosting(depth: int, rounds: int) -> Learner:
    return lambda train, rows: _scored(
        GBTClassifier(maxDepth=depth, maxIter=rounds, stepSize=0.1, seed=0, **_common(train)).fit(train), rows)


def network(hidden: list[int]) -> Learner:
    def run(train: DataFrame, rows: DataFrame) -> DataFrame:
        if "weight" in train.columns:
            raise ValueError("the network takes no weights: resample the rows instead")
        width = _width(train)
        model = MultilayerPerceptronClassifier(layers=[width, *hidden, 2], maxIter=100, seed=0, labelCol="y",
                                               featuresCol="features").fit(train)
        return _scored(model, rows)

    return run


class Applied(Model):
    """A fitted learner of this module: fn(rows) gives rows with score and pred."""

    def __init__(self, fn: Callable[[DataFrame], DataFrame]):
        super().__init__()
        self.fn = fn

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self.fn(dataset.withColumn("__features", F.col("features")))
        return out.drop("features").withColumnRenamed("__features", "features").withColumn("prediction", F.col("pred").cast("double"))


def landmarks(train: DataFrame, most: int) -> np.ndarray:
    """At most `most` different points of the training rows, those with the smallest
    hashes: a bounded sample that spans the kernel's feature space."""
    points = train.select(vector_to_array("features").alias("x")).distinct()
    rows = points.orderBy(F.xxhash64("x"), "x").limit(most).collect()
    return np.array([r["x"] for r in rows], float)


class KernelMachine(Estimator):
    """RBF machine with hinge loss: Nystroem features of hashed landmarks, a linear
    support vector machine on them, and a logistic curve over its margins for scores.

    With as many landmarks as training points the kernel is the exact one. On 200 points
    on two rings it takes the same side as an exact dual solver on 98% or more (tests)."""

    gamma = Param(Params._dummy(), "gamma", "width of the kernel; 0 is 1 / number of features", TypeConverters.toFloat)
    c = Param(Params._dummy(), "c", "weight of the losses", TypeConverters.toFloat)
    points = Param(Params._dummy(), "points", "landmarks at most", TypeConverters.toInt)

    def __init__(self, gamma: float = 0.0, c: float = 1.0, points: int = 256):
        super().__init__()
        self._setDefault(gamma=0.0, c=1.0, points=256)
        self._set(gamma=gamma, c=c, points=points)

    def _fit(self, train: DataFrame) -> Applied:
        at = landmarks(train, self.getOrDefault(self.points))
        gamma = self.getOrDefault(self.gamma) or 1.0 / at.shape[1]
        square = ((at[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
        values, vectors_ = np.linalg.eigh(np.exp(-gamma * square))
        kept = values > 1e-8 * values.max()
        turn = vectors_[:, kept] / np.sqrt(values[kept])

        def run(x: pa.Array) -> pa.Array:
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            far = (rows**2).sum(axis=1)[:, None] - 2 * rows @ at.T + (at**2).sum(axis=1)[None, :]
            out = np.exp(-gamma * np.maximum(far, 0)) @ turn
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

        run.__annotations__ = {"x": pa.Array, "return": pa.Array}
        mapped = F.arrow_udf(run, T.ArrayType(T.DoubleType()))

        def image(df: DataFrame) -> DataFrame:
            return df.withColumn("features", array_to_vector(mapped(vector_to_array("features"))))

        given = _common(train) | {"featuresCol": "features"}
        inside = written(image(train.select("features", *[c for c in ("y", "weight") if c in train.columns])), "kernel")
        # The penalty of a squared norm per row: 1 / (C N), as for the logistic learner.
        machine = LinearSVC(regParam=1.0 / (self.getOrDefault(self.c) * max(1, inside.count())), maxIter=100, standardization=False, **given).fit(inside)
        margins = VectorAssembler(inputCols=["__margin"], outputCol="features")

        def placed(df: DataFrame) -> DataFrame:
            out = machine.transform(df).withColumn("__margin", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "prediction")
            return margins.transform(out)

        curve = LogisticRegression(labelCol="y", featuresCol="features", **({"weightCol": "weight"} if "weight" in train.columns else {})).fit(placed(inside))

        def score(rows: DataFrame) -> DataFrame:
            out = curve.transform(placed(image(rows)))
            out = out.withColumn("score", vector_to_array("probability")[1]).withColumn("pred", (F.col("__margin") > 0).cast("int"))
            return out.drop("rawPrediction", "probability", "prediction", "__margin", "features")

        return Applied(score)


def as_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The vector's numbers as columns __f0, __f1, ..."""
    width = _width(df)
    names = [f"__f{i}" for i in range(width)]
    x = df.withColumn("__x", vector_to_array("features"))
    return x.withColumns({name: F.col("__x")[i] for i, name in enumerate(names)}).drop("__x"), names


class GaussianBayes(Estimator):
    """The SQL naive Bayes as an estimator."""

    smoothing = Param(Params._dummy(), "smoothing", "share of the largest variance added to all", TypeConverters.toFloat)

    def __init__(self, smoothing: float = 1e-9):
        super().__init__()
        self._setDefault(smoothing=1e-9)
        self._set(smoothing=smoothing)

    def _fit(self, train: DataFrame) -> Applied:
        known, names = as_columns(train)
        known, smoothing = written(known, "bayes"), self.getOrDefault(self.smoothing)
        return Applied(lambda rows: naive_bayes(known, as_columns(rows)[0], names, smoothing).drop(*names))


class Neighbours(Estimator):
    """The exact nearest neighbours as an estimator; rows need a key of their own."""

    k = Param(Params._dummy(), "k", "neighbours asked", TypeConverters.toInt)
    p = Param(Params._dummy(), "p", "order of the distance", TypeConverters.toFloat)
    weighted = Param(Params._dummy(), "weighted", "weights 1 / distance", TypeConverters.toBoolean)

    def __init__(self, k: int = 5, p: float = 2.0, weighted: bool = False, key: str = "graph_id"):
        super().__init__()
        self._setDefault(k=5, p=2.0, weighted=False)
        self._set(k=k, p=p, weighted=weighted)
        self.key = key

    def _fit(self, train: DataFrame) -> Applied:
        known = written(train.select(self.key, "y", vector_to_array("features").alias("__x")), "known")
        k, p, weighted = (self.getOrDefault(x) for x in (self.k, self.p, self.weighted))

        def score(rows: DataFrame) -> DataFrame:
            asked = rows.withColumn("__x", vector_to_array("features"))
            votes = neighbors.knn_vote(asked, known, [], self.key, F.col("__x"), k, weighted, int(p) if p == int(p) else p)
            return rows.join(votes.withColumnRenamed("qid", self.key), self.key)

        return Applied(score)


def rbf_machine(train: DataFrame, rows: DataFrame) -> DataFrame:
    return KernelMachine().fit(train).transform(rows).drop("features", "prediction")


# name -> (learner, wants standardised features)
LEARNERS: dict[str, tuple[Learner, bool]] = {
    "logistic": (logistic, True),
    "dtree_d1": (tree(1), False),
    "dtree_d2": (tree(2), False),
    "dtree_d3": (tree(3), False),
    "svm_rbf": (rbf_machine, True),
    "mlp": (network([64, 32]), True),
    "mlp_small": (network([32]), True),
    "rand_forest": (forest(), False),
    "grad_boost": (boosting(3, 50), False),
    "xgboost": (boosting(5, 50), False),
    "lightgbm": (boosting(4, 50), False),
}


# ---------------------------------------------------------------------------
# learners as SQL
# ---------------------------------------------------------------------------


def naive_bayes(train: DataFrame, rows: DataFrame, features: list[str], smoothing: float = 1e-9) -> DataFrame:
    """Gaussian naive Bayes: class means and population variances, each variance raised
    by `smoothing` times the largest variance of a feature."""
    per = train.groupBy("y").agg(
        F.count("*").alias("n"),
        *[F.avg(f).alias(f"m_{f}") for f in features], *[F.var_pop(F.col(f).cast("double")).alias(f"v_{f}") for f in features])
    whole = train.agg(F.count("*").alias("__n"), F.greatest(
        *[F.var_pop(F.col(f).cast("double")) for f in features], F.lit(0.0)).alias("__top"))

    def side(k: int):
        # One row always: of NULLs if the class has no rows.
        return per.where(F.col("y") == k).agg(*[F.max(c).alias(f"{c}_{k}") for c in per.columns if c != "y"])

    model = side(0).crossJoin(side(1)).crossJoin(whole)  # one row each

    def likelihood(k: int):
        total = F.log(F.col(f"n_{k}") / F.col("__n"))
        for f in features:
            v = F.col(f"v_{f}_{k}") + F.col("__top") * smoothing
            d = F.col(f).cast("double") - F.col(f"m_{f}_{k}")
            total = total - F.log(v * 2 * F.pi()) / 2 - d * d / (v * 2)
        return total

    joined = rows.crossJoin(F.broadcast(model))
    # With one class in the training rows every row is of that class.
    score = F.when(F.col("n_0").isNull(), F.lit(1.0)).when(F.col("n_1").isNull(), F.lit(0.0)).otherwise(sigmoid(likelihood(1) - likelihood(0)))
    return joined.withColumn("score", score).withColumn("pred", (F.col("score") > 0.5).cast("int")).select(
        *rows.columns, "score", "pred")


def stump(train: DataFrame, features: list[str]) -> DataFrame:
    """The exact one-split tree by Gini impurity: `(feature, threshold, left_class,
    right_class, impurity)`, one row. Splits lie half way between neighbouring values;
equal impurity goes to the first feature and the lower split. Where nothing can be
    split, feature and threshold are NULL and both sides are the larger class."""
    order = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    long = reports.long_features(train, ["y"], features).groupBy("feature", "value").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    run = running_totals(long, ["feature"], "value", {"pos": "lp", "neg": "ln"}, {"pos": "P", "neg": "N"})
    lp, ln, p, n = (F.col(c).cast("double") for c in ("lp", "ln", "P", "N"))
    rp, rn = p - lp, n - ln
    gini = (2 * lp * ln / (lp + ln) + F.coalesce(safe_div(2 * rp * rn, rp + rn), F.lit(0.0))) / (p + n)
    split = run.where("lp + ln < P + N").withColumn("impurity", F.round(gini, 12)).withColumn("ord", order[F.col("feature")])
    best = split.agg(F.min(F.struct("impurity", "ord", "value", "feature", (lp > ln).cast("int").alias("left_class"),
                                    (rp > rn).cast("int").alias("right_class"))).alias("b")).select("b.*")
    best = written(best, "stump")
    above = long.join(best.select("feature", F.col("value").alias("__v")), "feature").where("value > __v").agg(F.min("value").alias("__next"))
    major = train.agg((F.count_if(F.col("y") == 1) > F.count_if(F.col("y") == 0)).cast("int").alias("__major"))
    return best.crossJoin(above).crossJoin(major).select(  # one row each
        "feature", ((F.col("value") + F.col("__next")) / 2).alias("threshold"), F.coalesce("left_class", "__major").alias("left_class"),
        F.coalesce("right_class", "__major").alias("right_class"), "impurity")


def apply_stump(rows: DataFrame, fitted: DataFrame, features: list[str]) -> DataFrame:
    value = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])[F.col("feature")]
    return rows.crossJoin(F.broadcast(fitted)).withColumn(  # one row
        "pred", F.when(value <= F.col("threshold"), F.col("left_class")).otherwise(F.col("right_class"))
    ).select(*rows.columns, "pred")


# ---------------------------------------------------------------------------
# tuning and traces
# ---------------------------------------------------------------------------


class MccEvaluator(Evaluator, HasLabelCol, HasPredictionCol):
    """Matthews correlation as the measure of a cross-validation."""

    def __init__(self, label: str = "y"):
        super().__init__()
        self._setDefault(labelCol=label, predictionCol="prediction")

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = dataset.select(F.col(self.getLabelCol()).cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"),
                              F.lit(0).alias("delta_cx"), F.lit(0).alias("g"))
        return float(metrics.score(rows, ["g"], ranked=False).first()["mcc"])

    def isLargerBetter(self) -> bool:
        return True


def grids(train_rows: int) -> dict:
    """Estimators and grids of the sweep, with the parameters Spark has."""
    lr = LogisticRegression(labelCol="y", standardization=False)
    dt = DecisionTreeClassifier(labelCol="y", seed=0)
    rf = RandomForestClassifier(labelCol="y", seed=0)
    gb = GBTClassifier(labelCol="y", seed=0, maxIter=50)
    nb, kn, km = GaussianBayes(), Neighbours(), KernelMachine()
    return {
        "logistic": (lr, ParamGridBuilder().addGrid(lr.regParam, [1.0 / (c * train_rows) for c in (0.1, 1.0, 10.0)]).build()),
        "dtree": (dt, ParamGridBuilder().addGrid(dt.maxDepth, [1, 2, 3, 5, 8]).addGrid(dt.minInstancesPerNode, [1, 5, 20]).build()),
        "rand_forest": (rf, ParamGridBuilder().addGrid(rf.numTrees, [50, 100]).addGrid(rf.maxDepth, [8, 12]).build()),
        "naive_bayes": (nb, ParamGridBuilder().addGrid(nb.smoothing, [1e-11, 1e-9, 1e-7]).build()),
        "knn": (kn, ParamGridBuilder().addGrid(kn.k, [3, 5, 11]).addGrid(kn.p, [1.0, 2.0]).addGrid(kn.weighted, [False, True]).build()),
        "svm_rbf": (km, ParamGridBuilder().addGrid(km.c, [0.1, 1.0, 10.0]).addGrid(km.gamma, [0.0, 0.5]).build()),
        "grad_boost": (gb, ParamGridBuilder().addGrid(gb.maxDepth, [2, 3]).addGrid(gb.stepSize, [0.05, 0.1]).build()),
    }


def sweep(train: DataFrame, name: str, key: str = "graph_id", k: int = 5, parallelism: int = 4):
    """Grid search by stratified folds and MCC; `train` has features and y. Returns the
    best fitted model and `[(parameters, mean MCC)]`."""
    estimator, grid = grids(train.count())[name]
    folded = written(sampling.folds(train, key, ["y"], k).select(key, "features", "y", "fold"), "folds")
    search = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=MccEvaluator(), numFolds=k,
                            foldCol="fold", parallelism=parallelism).fit(folded)
    table = [({p.name: v for p, v in g.items()}, m) for g, m in zip(grid, search.avgMetrics)]
    return search.bestModel, table


def training_curve(train: DataFrame, val: DataFrame, iterations: int) -> DataFrame:
    """Metrics on both parts after each number of iterations, by refitting."""
    out = None
    for i in range(1, iterations + 1):
        model = logistic_model(train, max_iter=i)
        for part, rows in (("train", train), ("val", val)):
            scored = _scored(model, rows).withColumn("iteration", F.lit(i)).withColumn("part", F.lit(part))
            scored = scored.select("iteration", "part", "y", "pred", "score", "delta_cx")
            out = scored if out is None else out.unionByName(scored)
    return metrics.score(out, ["iteration", "part"])


def objective_history(train: DataFrame) -> list[float]:
    """The solver's own objective after each iteration."""
    return list(logistic_model(train).summary.objectiveHistory)


def cost_forest(train: DataFrame, rows: DataFrame, target: str = "delta_cx", trees: int = 200) -> DataFrame:
    """Random forest regression of the cost gap: `rows` with `predicted`."""
    def top(some: int, depth: int, seed: int):
        return RandomForestRegressor(numTrees=some, maxDepth=depth, maxBins=BINS, seed=seed, labelCol=target, **({"weightCol": "weight"} if "weight" in train.columns else {}))

    out = grown(train, rows, trees, top, target, int(np.ceil(_width(train) / 3)))
    return out.withColumnRenamed("__mean", "predicted").drop("features")


def r_squared(df: DataFrame, keys: list[str], target: str = "delta_cx") -> DataFrame:
    y, p = F.col(target).cast("double"), F.col("predicted")
    return df.groupBy(*keys).agg((1.0 - safe_div(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count("*"))).alias("r2"))
