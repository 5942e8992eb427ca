"""Neighbours, ranks, metrics, learners and generators against plain computations."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.functions.scalars import mix
from graphloom.operators import generate, metrics, neighbors, ordering, sampling, scaling
from graphloom.plans import learners


def points(spark, count, hot=0.4, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        group = "hot" if rng.random() < hot else f"g{i % 3}"
        x = rng.normal(size=3).round(1) if i % 5 else np.zeros(3)  # many equal points
        rows.append((i, group, int(rng.random() < 0.3), *map(float, x)))
    return spark.createDataFrame(rows, "id long, grp string, y int, a double, b double, c double")


def brute_neighbours(pdf, k, p=2):
    out = set()
    for _, g in pdf.groupby("grp"):
        x = g[["a", "b", "c"]].to_numpy()
        gap = np.abs(x[:, None] - x[None])
        d = np.round(gap.max(axis=2) if p == float("inf") else (gap**p).sum(axis=2) ** (1 / p), 9)
        ids = g["id"].to_numpy()
        for i in range(len(g)):
            order = sorted((d[i, j], ids[j]) for j in range(len(g)) if j != i)[:k]
            out |= {(int(ids[i]), r + 1, int(n), round(float(dd), 8)) for r, (dd, n) in enumerate(order)}
    return out


@pytest.mark.parametrize("leaf, p", [(4096, 2), (40, 2), (16, 1), (16, float("inf")), (40, 3)])
def test_neighbours_are_exact(spark, leaf, p):
    """Trees of no level and of several, and distances of several orders."""
    df = points(spark, 400)
    found = neighbors.nearest(df, df, ["grp"], "id", neighbors.feature_point(["a", "b", "c"]), 4, skip_self=True,
                              p=p, fan=5, leaf=leaf, block=64)
    got = {(r["qid"], r["rank"], r["nid"], round(r["dist"], 8)) for r in found.collect()}
    assert got == brute_neighbours(df.toPandas(), 4, p)


def test_equal_points_are_cut_into_blocks(spark):
    df = spark.range(300).select(F.col("id"), F.lit("g").alias("grp"), F.lit(0).alias("y"), F.array(F.when(F.col("id") < 290, 1.0).otherwise(F.col("id").cast("double"))).alias("x"))
    found = neighbors.nearest(df, df, ["grp"], "id", F.col("x"), 2, skip_self=True, fan=4, leaf=16, block=32).collect()
    assert len(found) == 600 and {r["dist"] for r in found if r["qid"] < 290} == {0.0}
    assert sorted(r["nid"] for r in found if r["qid"] == 0) == [1, 2] and sorted(r["nid"] for r in found if r["qid"] == 1) == [0, 2]


def test_compared_pairs_grow_slower_than_the_square(spark, monkeypatch):
    kept = neighbors._search

    def compared(n):
        made = spark.sparkContext.accumulator(0)

        def counting(queries, data, *rest):
            made.add(len(queries) * len(data))
            return kept(queries, data, *rest)

        monkeypatch.setattr(neighbors, "_search", counting)
        df = spark.range(n).select("id", F.lit(0).alias("y"), F.array(*[F.rand(7 + i) for i in range(2)]).alias("x"))
        df = spark.createDataFrame(df.collect(), df.schema)
        assert neighbors.nearest(df, df, [], "id", F.col("x"), 3, skip_self=True, fan=8, leaf=64).count() == 3 * n
        return made.value

    few, many = compared(1000), compared(8000)
    assert many < 16 * few and many < 8000 * 8000 / 12


def test_queries_with_copies_stay_in_their_leaf(spark, monkeypatch):
    """Text keys, 100 points of 20 copies each: k copies are found at home, and the plane
    between two pivots closes all other leaves."""
    made, kept = spark.sparkContext.accumulator(0), neighbors._search

    def counting(queries, data, *rest):
        made.add(len(queries) * len(data))
        return kept(queries, data, *rest)

    monkeypatch.setattr(neighbors, "_search", counting)
    x = F.array(*[F.pmod(F.xxhash64(F.col("id") % 100, F.lit(i)), F.lit(1000)).cast("double") for i in range(6)])
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("y"), x.alias("x"))
    found = neighbors.nearest(df, df, [], "id", F.col("x"), 3, skip_self=True, fan=8, leaf=400)
    assert found.agg(F.count("*"), F.max("dist"), F.count_if(F.col("qid") == F.col("nid"))).first()[:] == (6000, 0.0, 0)
    assert made.value <= 2000 * 400


@pytest.mark.parametrize("itself", [False, True])
def test_equal_points_are_searched_once(spark, monkeypatch, itself):
    """1,200 rows on 40 points: the points are compared, and a query leaves out itself and
    not its place; ties go to the smaller key, also those of different places."""
    made, kept = spark.sparkContext.accumulator(0), neighbors._search

    def counting(queries, data, *rest):
        made.add(len(queries) * len(data))
        return kept(queries, data, *rest)

    monkeypatch.setattr(neighbors, "_search", counting)
    x = F.when(F.col("id") < 900, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array((F.col("id") % 13).cast("double"), (F.col("id") % 3).cast("double")))
    df = spark.range(1200).select("id", F.lit(0).alias("y"), x.alias("x"))
    asks = df if itself else df.where("id % 7 = 0").withColumn("id", F.col("id") + 5000)
    found = neighbors.nearest(asks, df, [], "id", F.col("x"), 60, skip_self=itself, fan=4, leaf=16, block=100).collect()
    rows = [(r["id"], r["x"]) for r in df.collect()]
    got = {}
    for r in sorted(found, key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append((r["dist"], r["nid"]))
    assert len(got) == asks.count()
    for q, at in [(r["id"], r["x"]) for r in asks.where("id % 5 = 0 or id > 890").collect()]:
        assert got[q] == sorted((round(sum((a - b) ** 2 for a, b in zip(at, to)) ** 0.5, 9), i) for i, to in rows if i != q)[:60]
    assert made.value <= 40 * 40 * 2


def test_visits_leave_out_what_is_beyond_the_bound():
    schema = pa.schema([("g", pa.string()), ("qid", pa.int64()), ("nid", pa.int64()), ("dist", pa.float64()), ("ny", pa.int64())])
    data = pa.table({"id": list(range(50)), "y": [0] * 50, "x": [[float(i)] for i in range(50)]})
    asked = pa.table({"g": ["{}"] * 3, "qid": [1, 2, 3], "x": [[0.0]] * 3, "bound": pa.array([None, 2.0, 0.0], pa.float64())})
    found = neighbors._search(asked, data, 5, 2, schema).to_pylist()
    assert [(r["qid"], r["nid"]) for r in found] == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0), (2, 1), (2, 2), (3, 0)]


def test_overlap_of_one_class_is_null(spark):
    df = points(spark, 60).withColumn("y", F.when(F.col("grp") == "hot", 1).otherwise(F.col("y")))
    rows = {r["grp"]: r for r in neighbors.overlap_report(df, ["grp"], "id", ["a", "b", "c"], 3).collect()}
    assert rows["hot"]["single_class"] == 1 and rows["hot"]["knn_disagree_pos"] is None
    assert any(r["knn_disagree_pos"] is not None for r in rows.values())


def test_close_values_spread_over_many_cuts(spark):
    """A million values within 1% of each other are cut into at least as many parts as there are cores."""
    df = spark.range(1_000_000).select((F.lit(0.5) + F.col("id") * 5e-9).alias("v"))
    counts = [r["count"] for r in ordering.with_cuts(df, [], [F.col("v")]).groupBy(ordering.CUT).count().collect()]
    assert len(counts) >= 8 and max(counts) < 600_000


@pytest.fixture
def small_cuts(monkeypatch):
    for name, value in (("CUT_ROWS", 20), ("STEP", 4), ("ABOVE", 3)):
        monkeypatch.setattr(ordering, name, value)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_many_cuts(spark, small_cuts, descending):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.sin("id").alias("v"), (F.col("id") % 11).alias("c"))
    cut = ordering.with_cuts(df, ["g"], [F.col("v")]).toPandas()
    assert cut[cut.g == 0][ordering.CUT].nunique() > 20
    assert all(part.sort_values("v")[ordering.CUT].is_monotonic_increasing for _, part in cut.groupby("g"))
    got = ordering.running_totals(df, ["g"], "v", {"c": "run"}, {"c": "all"}, descending).toPandas()
    assert len(got) == 3000
    for _, part in got.groupby("g"):
        part = part.sort_values("v", ascending=not descending)
        assert (part["run"] == part["c"].cumsum()).all() and (part["all"] == part["c"].sum()).all()


def test_ranks_by_tied_values_over_many_cuts(spark, small_cuts):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("size"))
    got = ordering.rank_in_group(df, [], [F.col("size"), F.col("id")], "place").toPandas().sort_values(["size", "id"])
    assert list(got["place"]) == list(range(1, 2001))


@pytest.mark.parametrize("widths", [(1024,), (100_000, 1024), (1024, 1)])
def test_labels_by_hash_are_those_of_the_ranks(spark, widths):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"))
    hashed = F.pmod("id", F.lit(97)) if widths[-1] == 1 else mix("id", 3)

    def part(rank, size):
        return F.when(rank <= size / 5, "a").when(rank <= size / 2, "b").otherwise("c")

    want = {r["id"]: r["want"] for r in ordering.rank_by_hash(df, ["g"], hashed, "id", "r", "n").select("id", part(F.col("r"), F.col("n")).alias("want")).collect()}
    got = ordering.label_by_hash(df, ["g"], hashed, "id", part, "got", widths=widths).collect()
    assert len(got) == 4000 and {r["id"]: r["got"] for r in got} == want


def test_sample_ranks_few_rows(spark, monkeypatch):
    ranked = []
    kept = ordering.rank_in_group
    monkeypatch.setattr(ordering, "rank_in_group", lambda df, *rest: (ranked.append(df.count()), kept(df, *rest))[1])
    assert sampling.sample_rows(spark.range(100_000), 300, "id").count() == 300
    assert ranked[0] <= 3


def test_ranks_and_quantiles_of_a_hot_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
                                  ((F.col("id") * 37) % 501 / 10.0).alias("v"))
    ranked = ordering.rank_by_hash(df, ["g"], mix("id", 5), "id", "rank", "size").toPandas()
    for _, part in ranked.groupby("g"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1)) and set(part["size"]) == {len(part)}
    q = ordering.exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.99, 1.0]).toPandas()
    pdf = df.toPandas()
    for r in q.itertuples():
        assert r.quantile == pytest.approx(pdf[pdf.g == r.g]["v"].quantile(r.level))


def test_metrics_against_definitions(spark):
    rng = random.Random(2)
    rows = [(i, rng.random() < 0.4, round(rng.random(), 2), rng.randint(-9, 9)) for i in range(500)]
    df = spark.createDataFrame([(0, int(y), int(s >= 0.5), float(s), d) for _, y, s, d in rows],
                               "g int, y int, pred int, score double, delta_cx int")
    m = metrics.score(df, ["g"]).first()
    y, s = np.array([r[1] for r in rows], dtype=int), np.array([r[2] for r in rows])
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert m["roc_auc"] == pytest.approx(np.mean(pairs))
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp, fp = ((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum()
        ap, last = ap + (tp / (y == 1).sum() - last) * tp / (tp + fp), tp / (y == 1).sum()
    assert m["pr_auc"] == pytest.approx(ap)
    assert m["mcc"] == pytest.approx(np.corrcoef(y, (s >= 0.5).astype(int))[0, 1])


def test_auc_of_score_and_of_its_negative_sum_to_one(spark):
    df = spark.range(3000).select(F.lit(0).alias("g"), ((F.col("id") * 7919) % 10 < 3).cast("int").alias("y"),
                                  ((F.col("id") * 31) % 97 / 7.0 - 5).alias("score"), F.lit(1).alias("pred"), F.lit(1).alias("delta_cx"))
    up = metrics.score(df, ["g"]).first()
    down = metrics.score(df.withColumn("score", -F.col("score")), ["g"]).first()
    assert up["roc_auc"] + down["roc_auc"] == pytest.approx(1.0)
    assert up["log_loss"] is None  # scores outside [0, 1]


def test_perfect_and_constant_choosers(spark):
    df = spark.createDataFrame([(d, int(d > 0)) for d in (5, -3, 2, -8, 1)], "delta_cx int, y int").withColumn("g", F.lit(0))
    perfect = metrics.score(df.withColumn("pred", F.col("y")), ["g"], ranked=False).first()
    assert perfect["savings"] == 1.0 and perfect["mcc"] == 1.0
    always = metrics.score(df.withColumn("pred", F.lit(1)), ["g"], ranked=False).first()
    assert always["savings"] == pytest.approx(-3 / 8) and always["mcc"] == 0.0 and always["npv"] is None
    one = metrics.score(df.where("y = 1").withColumn("pred", F.lit(1)).withColumn("score", F.lit(0.7)), ["g"]).first()
    assert one["mcc"] == 0.0 and one["roc_auc"] is None and one["specificity"] is None


def test_splits_do_not_depend_on_partitioning(spark):
    df = spark.range(900).select(F.col("id").alias("graph_id"), (F.col("id") % 4).alias("n_vertices"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    a = sampling.split_three(df.repartition(1), "graph_id", ["n_vertices", "y"]).toPandas()
    b = sampling.split_three(df.repartition(11), "graph_id", ["n_vertices", "y"]).toPandas()
    assert a.sort_values("graph_id")["split"].tolist() == b.sort_values("graph_id")["split"].tolist()
    share = a["split"].value_counts(normalize=True)
    assert share["test"] == pytest.approx(0.2, abs=0.02) and share["val"] == pytest.approx(0.16, abs=0.02)


def test_pca_axes_match_a_decomposition(spark):
    df = points(spark, 300)
    out, shares = scaling.two_axes(df, df, ["a", "b", "c"])
    x = df.toPandas()[["a", "b", "c"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    values = np.sort(np.linalg.eigvalsh(np.cov(z, rowvar=False)))[::-1]
    assert shares == pytest.approx(list(values[:2] / values.sum()))
    got = out.toPandas()
    assert abs(got["pc1"].mean()) < 1e-9 and got["pc1"].var() == pytest.approx(values[0])


def test_learners_beat_chance_on_a_separable_set(spark):
    df = spark.range(400).select(F.col("id").alias("graph_id"), F.lit(8).alias("n_vertices"), (F.col("id") % 10 / 10.0).alias("u"),
                                 ((F.col("id") * 7) % 11 / 11.0).alias("v")).withColumn("y", (F.col("u") > 0.45).cast("int"))
    df = df.withColumn("delta_cx", F.when(F.col("y") == 1, 3).otherwise(-2))
    fitted = scaling.fixed(scaling.moments(df, ["u", "v"]))
    for name in ("logistic", "dtree_d1", "svm_rbf"):
        learner, scale = learners.LEARNERS[name]
        rows = learners.vectors(df, ["u", "v"], fitted if scale else None)
        scored = learner(rows, rows).withColumn("g", F.lit(0))
        assert metrics.score(scored, ["g"]).first()["mcc"] > 0.8, name
    fit = learners.stump(df, ["u", "v"]).first()
    assert fit["feature"] == "u" and fit["threshold"] == pytest.approx(0.45)


def test_draws_are_spread_and_graphs_connected(spark):
    df = spark.range(200).select(F.col("id").alias("graph_no"), F.lit(32).alias("n"), F.lit(0.3).alias("p"), F.lit(9).alias("seed"))
    judged = generate.judged(df.withColumn("tri", generate.random_graph())).agg(F.avg("m"), F.stddev("m"), F.countDistinct("wl_key")).first()
    assert judged[0] == pytest.approx(0.3 * 496, rel=0.05) and judged[2] > 190
    assert judged[1] == pytest.approx(math.sqrt(496 * 0.3 * 0.7), rel=0.4)


def test_accept_fills_cells_and_passes_over_known_graphs(spark):
    size = spark.createDataFrame([(16, 12, 3)], "n int, want int, seed int")
    attempts = generate.structured_attempts(size, "want")
    kept, counters = generate.accept(attempts, ["n"], "seq", "want")
    assert kept.count() == 12
    counts = {r["outcome"]: r["n_graphs"] for r in counters.collect()}
    assert counts["generated"] == 12 and counts["duplicate"] > 0
    # Known graphs are duplicates; the places go to the next new ones.
    again, more = generate.accept(attempts, ["n"], "seq", "want", existing=kept.select("n", "wl_key"))
    assert again.join(kept.select("wl_key"), "wl_key").count() == 0
    assert {r["outcome"]: r["n_graphs"] for r in more.collect()}["generated"] == again.count()


def test_seeds_are_independent(spark):
    """Test sets of any two of five seeds share about a fifth; no order is a rotation
    of another; text keys do as well as whole numbers."""
    for key in ("id", "cast(id as string)"):
        df = spark.range(5000).selectExpr(f"{key} as id", "0 as y")
        orders, tests = [], []
        for seed in range(5):
            tests.append({r.id for r in sampling.split_two(df, "id", ["y"], seed).where("split = 'test'").collect()})
            orders.append([r.id for r in df.orderBy(mix("id", seed), "id").limit(50).collect()])
        for a in range(5):
            for b in range(a):
                assert 0.15 < len(tests[a] & tests[b]) / len(tests[a]) < 0.25
                assert len(set(orders[a]) & set(orders[b])) < 10


def test_accept_with_known_graphs(spark):
    """Known graphs are duplicates and take no place of new ones."""
    from graphloom.operators import generate

    paths = spark.createDataFrame([(k, 4, t) for k, t in enumerate([[1 << 59 | 1 << 57 | 1 << 54], [7 << 57], [1 << 59 | 7 << 56], [63 << 54]])], "seq long, n int, tri array<long>")
    attempts = paths.selectExpr("*", "2L as want")
    known = generate.judged(attempts.where("seq = 0")).select("n", "wl_key")
    kept, counters = generate.accept(attempts, ["n"], "seq", "want", require_connected=False, existing=known)
    seqs = sorted(r.seq for r in kept.collect())
    counts = {r.outcome: r.n_graphs for r in counters.collect()}
    assert len(seqs) == 2 and 0 not in seqs
    assert counts["generated"] == 2 and counts["duplicate"] >= 1


def test_one_class_and_nothing_to_split(spark):
    from graphloom.plans import learners

    rows = spark.range(20).selectExpr("id", "cast(1 as int) as y", "1.0D as a")
    assert [r.pred for r in learners.naive_bayes(rows, rows, ["a"]).collect()] == [1] * 20
    fitted = learners.stump(rows, ["a"])
    assert [r.pred for r in learners.apply_stump(rows, fitted, ["a"]).collect()] == [1] * 20


def test_shared_folder_needs_a_name_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from graphloom import session

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        session.shared_folder(cluster)
    cluster.sparkContext.getCheckpointDir = lambda: "hdfs://x/y"
    assert session.shared_folder(cluster) == "hdfs://x/y"


def test_a_second_run_judges_its_attempts_once(spark, monkeypatch):
    from graphloom.catalog import generated

    asked, judged = [], generate.judged

    def seen(*given):
        asked.append(given)
        return judged(*given)

    monkeypatch.setattr(generate, "judged", seen)
    kept, counters = generated._accepted_again(spark, "/root/testdata/sf0.001")
    assert len(asked) == 1 and kept.count() == counters.where("outcome = 'generated'").agg(F.sum("n_graphs")).first()[0]


def test_few_open_leaves_are_visited_in_one_round(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 3))
    df = spark.createDataFrame([(i, 0, *map(float, r)) for i, r in enumerate(x)], "id long, y int, a double, b double, c double")
    made, kept = [], neighbors.written

    def watch(rows, name="stage", *parts):
        made.append(name)
        return kept(rows, name, *parts)

    monkeypatch.setattr(neighbors, "written", watch)
    found = neighbors.nearest(df, df, [], "id", neighbors.feature_point(["a", "b", "c"]), 3, skip_self=True, fan=8, leaf=400).collect()
    assert made.count("tree-found") == 2  # one for the leaves at home; rounds of 2, 4, ... leaves before
    got = {(r["qid"], r["rank"]): r["nid"] for r in found}
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(np.round(np.sqrt(d), 9), axis=1, kind="stable")[:, :3]
    assert all(got[i, k + 1] == near[i, k] for i in range(3000) for k in range(3))
