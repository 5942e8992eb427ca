"""Estimators of this library against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import scaling
from graphloom.plans import experiments, features, learners


def rings(spark, n=200, seed=4):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    angle, radius = rng.uniform(0, 2 * np.pi, n), np.where(y == 1, 1.0, 2.2) + rng.normal(0, 0.15, n)
    x = np.column_stack([radius * np.cos(angle), radius * np.sin(angle)])
    rows = [(i, int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    return learners.vectors(spark.createDataFrame(rows, "graph_id long, y int, a double, b double"), ["a", "b"]), x, 2 * y - 1


def exact_machine(x, y, gamma, c, rounds=4000):
    """Hinge loss with the full kernel matrix, by subgradient steps on the primal."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    values, vectors = np.linalg.eigh(k)
    phi = np.hstack([vectors * np.sqrt(np.maximum(values, 0)), np.ones((len(x), 1))])
    w, decay = np.zeros(phi.shape[1]), 1 / (c * len(x))
    for t in range(1, rounds + 1):
        hit = y * (phi @ w) < 1
        w -= (decay * w - (y[hit, None] * phi[hit]).sum(axis=0) / len(x)) / (decay * (t + 50))
    return np.sign(phi @ w)


def test_kernel_machine_agrees_with_the_exact_one(spark):
    df, x, y = rings(spark)
    model = learners.KernelMachine(gamma=0.5, c=1.0, points=200).fit(df)
    got = {r["graph_id"]: r for r in model.transform(df).collect()}
    want = exact_machine(x, y, 0.5, 1.0)
    side = np.array([2 * got[i]["pred"] - 1 for i in range(len(x))])
    assert (side == want).mean() >= 0.98 and (side == y).mean() >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    few = learners.KernelMachine(gamma=0.5, points=40).fit(df).transform(df).agg(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0]
    assert few >= 0.95


@pytest.mark.parametrize("name", ["naive_bayes", "knn"])
def test_grids_cover_the_learners_in_sql(spark, name, monkeypatch):
    df, _, _ = rings(spark, 80)
    grid = learners.grids(80)[name]
    kept = [g for g in grid[1]][:2]
    monkeypatch.setattr(learners, "grids", lambda n: {name: (grid[0], kept)})
    model, table = learners.sweep(df, name, k=2)
    assert len(table) == 2 and all(-1 <= m <= 1 for _, m in table)
    out = model.transform(df)
    assert {"score", "pred", "prediction"} <= set(out.columns) and out.count() == 80


def test_bayes_estimator_is_the_sql_one(spark):
    df, _, _ = rings(spark, 60)
    got = {r["graph_id"]: r["score"] for r in learners.GaussianBayes(1e-9).fit(df).transform(df).collect()}
    want = {r["graph_id"]: r["score"] for r in learners.naive_bayes(df, df, ["a", "b"]).collect()}
    assert got == pytest.approx(want)
    assert scaling.covariance(df, ["a", "b"]).shape == (2, 2)


def test_models_score_after_counters_in_one_session(spark):
    _, stats = features.counted_graphs(spark.createDataFrame([("Bw",), ("Bw",), ("BG",), ("B",)], "g6 string"))
    assert stats == {"lines": 4, "parse_error": 1, "disconnected": 1, "parsed": 1, "duplicate": 1}
    df, _, _ = rings(spark, 60)
    assert len(learners.logistic(df, df).collect()) == 60  # the closure holds the training summary, that the session


def test_forests_grow_in_batches_the_driver_can_hold(spark, monkeypatch):
    df, _, _ = rings(spark, 60)
    sizes, fitted = [], learners.RandomForestClassifier.fit

    def seen(self, *given):
        sizes.append(self.getNumTrees())
        return fitted(self, *given)

    monkeypatch.setattr(learners, "LEAVES", 300)
    monkeypatch.setattr(learners.RandomForestClassifier, "fit", seen)
    got = learners.forest(12)(df, df).collect()
    assert sum(sizes) == 12 and max(sizes) <= 6 and len(got) == 60
    assert np.mean([r["pred"] == r["y"] for r in got]) >= 0.95 and all(0 <= r["score"] <= 1 for r in got)
    out = learners.cost_forest(df, df, "y", 12).collect()
    assert len(out) == 60 and np.mean([abs(r["predicted"] - r["y"]) < 0.5 for r in out]) >= 0.95


def test_feature_sets_read_one_seed_and_share_moments(spark, monkeypatch):
    df, _, _ = rings(spark, 120)
    df = df.drop("features").withColumns({"n_vertices": F.lit(8), "delta_cx": F.col("y") * 2 - 1})
    asked, kept = [], scaling.moments

    def seen(rows, *given):
        asked.append(rows._jdf.queryExecution().executedPlan().toString())
        return kept(rows, *given)

    monkeypatch.setattr(scaling, "moments", seen)
    table = experiments.drop_one(df, ["a", "b"], [0, 1, 2])
    assert len(asked) == 3 and all("PartitionFilters: [isnotnull(seed" in plan for plan in asked)
    assert {r["dropped"] for r in table.select("dropped").distinct().collect()} == {"(none)", "a", "b"}


def test_forests_leave_the_lower_levels_to_the_tasks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(0, 0.8, 3000) > 0.8).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(3000)]
    df = learners.vectors(spark.createDataFrame(rows, "graph_id long, y int, a double, b double, c double, d double"), list("abcd"))
    train, test = df.where("graph_id % 3 > 0"), df.where("graph_id % 3 = 0")
    nodes, fitted = [], learners.RandomForestClassifier.fit

    def seen(self, *given):
        model = fitted(self, *given)
        nodes.append(model.totalNumNodes / self.getNumTrees())
        return model

    monkeypatch.setattr(learners.RandomForestClassifier, "fit", seen)
    got = {r["graph_id"]: r["score"] for r in learners.forest(40)(train, test).collect()}
    assert max(nodes) <= 2 ** (learners.TOP + 1)  # the driver held whole trees before
    monkeypatch.undo()
    whole = learners.RandomForestClassifier(numTrees=40, maxDepth=learners.DEPTH, seed=5, labelCol="y").fit(train).transform(test)
    want = {r["graph_id"]: r["probability"][1] for r in whole.select("graph_id", "probability").collect()}
    a, b, truth = np.array([got[i] for i in want]), np.array(list(want.values())), y[list(want)]
    assert np.corrcoef(a, b)[0, 1] >= 0.93 and abs(((a > 0.5) == truth).mean() - ((b > 0.5) == truth).mean()) <= 0.04


def test_twigs_grow_to_pure_leaves():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 32, (400, 3)).astype(np.int8), axis=0)
    y, n = rng.normal(size=len(codes)), len(codes)
    at = rng.integers(0, 3, n)
    got = learners.twigs(at, codes, y, np.ones(n), np.arange(3, dtype=np.uint64), at, codes, 3, 24)
    assert got == pytest.approx(y)
    once = learners.twigs(at, codes, y, np.ones(n), np.arange(3, dtype=np.uint64), at, codes, 3, 0)
    assert once == pytest.approx([y[at == i].mean() for i in at])
    many = learners.poisson(rng.random(20000), np.repeat([1.0, 50.0], 10000)).reshape(2, -1)
    assert many.mean(axis=1) == pytest.approx([1, 50], rel=0.03) and many.var(axis=1) == pytest.approx([1, 50], rel=0.06)
