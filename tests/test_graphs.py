"""Closed forms, identities and agreement of the two ways of computing."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import graph6
from graphloom.operators import dense, generate, pauli, refinement, spectral, topology
from graphloom.operators.packed import pack_edges, unpack_edges, with_adjacency, with_around
from graphloom.operators.steps import FEATURES, SHAPE, GraphFeature, Registry, with_walks
from graphloom.plans import features
from graphloom.sources import g6

Q3 = [(u, u ^ (1 << b)) for u in range(8) for b in range(3) if u < u ^ (1 << b)]
GOLDEN = {
    "K2": (2, [(0, 1)]),
    "K3": (3, [(0, 1), (0, 2), (1, 2)]),
    "star": (8, [(i, 7) for i in range(7)]),
    "K8": (8, list(itertools.combinations(range(8), 2))),
    "Q3": (8, Q3),
    "P8": (8, [(i, i + 1) for i in range(7)]),
    "C8": (8, [(i, i + 1) for i in range(7)] + [(0, 7)]),
    "empty": (8, []),
    "one": (1, []),
}


def packed_of(spark, graphs):
    edges = spark.createDataFrame([(k, int(u), int(v)) for k, (_, e) in graphs.items() for u, v in e],
                                  "graph_id string, u int, v int")
    sizes = spark.createDataFrame([(k, n) for k, (n, _) in graphs.items()], "graph_id string, n int")
    return pack_edges(edges, sizes)


def random_graphs(sizes, count, seed=1):
    rng = random.Random(seed)
    out = {}
    for n in sizes:
        for i in range(count):
            p = rng.choice([0.05, 0.15, 0.4, 0.8])
            out[f"{n}-{i}"] = (n, [(u, v) for u, v in itertools.combinations(range(n), 2) if rng.random() < p])
    return out


def by_id(df):
    return {r["graph_id"]: r for r in df.collect()}


def test_golden_shapes(spark):
    rows = by_id(features.max_matching(FEATURES.columns(packed_of(spark, GOLDEN), [*SHAPE, "clique_number"])))
    want = {  # m, triangles, diameter, matching, connected, bipartite, tree, regular, clique
        "K2": (1, 0, 1, 1, 1, 1, 1, 1, 2), "K3": (3, 1, 1, 1, 1, 0, 0, 1, 3), "star": (7, 0, 2, 1, 1, 1, 1, 0, 2),
        "K8": (28, 56, 1, 4, 1, 0, 0, 1, 8), "Q3": (12, 0, 3, 4, 1, 1, 0, 1, 2), "P8": (7, 0, 7, 4, 1, 1, 1, 0, 2),
        "C8": (8, 0, 4, 4, 1, 1, 0, 1, 2), "empty": (0, 0, None, 0, 0, 1, 0, 1, 1), "one": (0, 0, 0, 0, 1, 1, 1, 1, 1),
    }
    for k, w in want.items():
        r = rows[k]
        got = (r["m"], r["triangle_count"], r["diameter"], r["max_matching_size"], r["is_connected"], r["is_bipartite"],
               r["is_tree"], r["is_regular"], r["clique_number"])
        assert got == w, k


def test_golden_text(spark):
    text = {r["graph_id"]: r["g6"] for r in packed_of(spark, GOLDEN).select("graph_id", graph6.to_text().alias("g6")).collect()}
    assert (text["K2"], text["K3"], text["star"], text["K8"]) == ("A_", "Bw", "G???F{", "G~~~~{")


def test_golden_spectra_and_terms(spark):
    p = packed_of(spark, {k: v for k, v in GOLDEN.items() if k != "one"})
    gap = {r["graph_id"]: r["spectral_gap"] for r in spectral.gap_column(dense.spectra(p)).collect()}
    assert gap["K8"] == pytest.approx(8) and gap["star"] == pytest.approx(1) and gap["Q3"] == pytest.approx(2)
    assert gap["P8"] == pytest.approx(2 - 2 * math.cos(math.pi / 8))
    assert gap["C8"] == pytest.approx(2 - 2 * math.cos(math.pi / 4))
    terms = {r["graph_id"]: r["pauli_num_terms"] for r in pauli.pauli_columns(p).collect()}
    assert terms["K8"] == 7 and terms["Q3"] == 3 and terms["K2"] == 1 and terms["K3"] is None


def test_round_trip_of_all_widths(spark):
    graphs = random_graphs([2, 5, 11, 12, 62, 63, 64, 65, 100], 3)
    p = packed_of(spark, graphs)
    back = graph6.pack_text(p.select("graph_id", graph6.to_text().alias("g6")))
    assert {(r["graph_id"], r["n"], tuple(r["tri"])) for r in back.collect()} == {
        (r["graph_id"], r["n"], tuple(r["tri"])) for r in p.collect()}
    got = {}
    for r in unpack_edges(back).collect():
        got.setdefault(r["graph_id"], set()).add((r["u"], r["v"]))
    for k, (_, e) in graphs.items():
        assert got.get(k, set()) == set(e)


def brute(n, edges):
    a = np.zeros((n, n), dtype=int)
    for u, v in edges:
        a[u, v] = a[v, u] = 1
    d = np.where(a == 1, 1, np.inf)
    np.fill_diagonal(d, 0)
    for k in range(n):
        d = np.minimum(d, d[:, k, None] + d[None, k, :])
    walk = np.linalg.matrix_power(a.astype(object), 3)
    connected = np.isfinite(d).all()
    return (len(edges), int(connected), int(d.max()) if connected else None, int(np.trace(walk)) // 6)


def test_narrow_and_wide_against_brute_force(spark):
    graphs = random_graphs([7, 33, 64, 65, 90, 130], 4)
    rows = by_id(FEATURES.columns(packed_of(spark, graphs), SHAPE))
    for k, (n, e) in graphs.items():
        r = rows[k]
        assert (r["m"], r["is_connected"], r["diameter"], r["triangle_count"]) == brute(n, e), k
        assert r["degree_variance"] == pytest.approx(np.var(np.bincount([x for p in e for x in p], minlength=n)))


def test_wide_form_equals_narrow_form(spark):
    p = packed_of(spark, random_graphs([9, 40, 64], 6))
    parts = {}
    for wide in (False, True):
        df = topology.degrees(with_around(with_adjacency(p, wide), wide), wide)
        df = topology.triangle_columns(df, wide)
        df = topology.distance_columns(topology.component_columns(df, wide), wide)
        df = topology.clique_column(df.where("n < 41"), wide)
        cols = ["graph_id", "m", "triangle_count", "avg_clustering", "n_components", "is_bipartite", "diameter", "clique_number"]
        parts[wide] = sorted(map(tuple, df.select(*cols).collect()))
    assert parts[False] == parts[True]


def test_matching_two_ways(spark):
    p = packed_of(spark, random_graphs([3, 8, 13, 16], 25))
    a = by_id(topology.small_matching_column(with_adjacency(p)).select("graph_id", "max_matching_size"))
    b = by_id(dense.large_matching(p).select("graph_id", "max_matching_size"))
    assert {k: r[1] for k, r in a.items()} == {k: r[1] for k, r in b.items()}


def test_stacked_walks_are_the_expressions(spark):
    """Graphs of no vertex, one, several words and several parts, in one batch."""
    graphs = random_graphs([2, 3, 8, 16, 64, 65, 130], 8) | GOLDEN | {"none": (0, []), "one": (1, []), "apart": (70, [(0, 69), (3, 5), (5, 9), (3, 9)])}
    p = packed_of(spark, graphs).coalesce(1)
    names = ["n_components", "is_bipartite", "diameter", "m", "is_connected", "triangle_count", "avg_clustering", "degree_variance"]
    want, got = (by_id(f.columns(p, [*names, "deg", "tri2"])) for f in (FEATURES, with_walks(FEATURES)))
    assert set(got) == set(graphs) and got == want
    gap = by_id(FEATURES.columns(p, ["spectral_gap"]))
    assert set(gap) == set(graphs) and gap["apart"].spectral_gap == pytest.approx(0)


def test_the_table_takes_graphs_as_stacks(spark):
    """No walk is done by lambdas, and no graph goes through Python twice."""
    lines = packed_of(spark, GOLDEN).select(graph6.to_text().alias("g6"))
    plan = features.feature_table(lines, with_gap=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "bit_count" not in plan  # walks by width, matching


def test_exact_matching_of_stacks(spark):
    p = packed_of(spark, random_graphs([1, 2, 5, 9, 15, 16], 20) | {"none": (0, [])})
    got = by_id(dense.max_matching(p, 16).select("graph_id", "max_matching_size"))
    assert got == by_id(topology.small_matching_column(with_adjacency(p)).select("graph_id", "max_matching_size"))


def test_pauli_two_ways_and_dense_traces(spark):
    graphs = random_graphs([4, 8, 16, 32], 4)
    p = packed_of(spark, graphs)
    a = sorted(map(tuple, pauli._sums_narrow(p).select("graph_id", "terms", "w_sum", "w_squares", "w_max").collect()))
    b = sorted(map(tuple, dense.pauli_sums(p).select("graph_id", "terms", "w_sum", "w_squares", "w_max").collect()))
    assert a == b
    single = [np.eye(2), np.array([[0, 1], [1, 0]]), np.array([[0, -1j], [1j, 0]]), np.diag([1, -1])]
    terms = {r[0]: r[1] for r in a}
    for k, (n, e) in graphs.items():
        if n > 8:
            continue
        h = np.zeros((n, n))
        for u, v in e:
            h[u, v] = h[v, u] = 1
        count = 0
        for word in itertools.product(single, repeat=int(math.log2(n))):
            m = np.eye(1)
            for w in word:
                m = np.kron(m, w)
            count += abs(np.trace(m @ h)) > 1e-9
        assert terms[k] == count, k


def test_spectral_identities(spark):
    p = packed_of(spark, random_graphs([8, 20, 70], 5))
    rows = topology.with_triangles(p).join(dense.spectra(p).select("graph_id", "lap", F.col("adj").alias("spectrum"), "nlap"), "graph_id").collect()
    for r in rows:
        lap, adj = np.array(r["lap"]), np.array(r["spectrum"])
        assert lap.sum() == pytest.approx(2 * r["m"], abs=1e-6)
        assert (adj ** 2).sum() == pytest.approx(2 * r["m"], abs=1e-6)
        assert (adj ** 3).sum() == pytest.approx(6 * r["triangle_count"], abs=1e-5)
        assert min(r["nlap"]) > -1e-9 and max(r["nlap"]) < 2 + 1e-9


def test_refinement_key_ignores_names(spark):
    rng = random.Random(4)
    graphs = random_graphs([9, 70], 6)
    renamed = {}
    for k, (n, e) in graphs.items():
        order = list(range(n))
        rng.shuffle(order)
        renamed[k] = (n, [tuple(sorted((order[u], order[v]))) for u, v in e])
    keys = [{r["graph_id"]: r["wl_key"] for r in refinement.refine(packed_of(spark, g)).collect()} for g in (graphs, renamed)]
    assert keys[0] == keys[1]


def test_lines_that_cannot_be_read(spark):
    lines = ["G???F{", "G?", "G??? {", "~~?????", "", ">>graph6<<A_", "@", "~?@"]
    df = g6.checked(spark.createDataFrame([(x,) for x in lines], "g6 string"))
    got = {r["g6"]: r["fault"] for r in df.collect()}
    assert got == {"G???F{": None, "G?": "length", "G??? {": "character", "~~?????": "header", "": "blank",
                   ">>graph6<<A_": None, "@": None, "~?@": "header"}


def test_partitioning_does_not_matter(spark):
    lines = packed_of(spark, random_graphs([8, 16], 20)).select(graph6.to_text().alias("g6"))
    a = sorted(map(tuple, features.feature_table(lines.repartition(1)).collect()), key=str)
    b = sorted(map(tuple, features.feature_table(lines.repartition(13)).collect()), key=str)
    assert a == b


def test_no_size_promises_and_mixed_sizes(spark):
    """One table of many sizes keeps every graph, with the right matching."""
    import inspect

    for module in (topology, refinement, dense, pauli, features):
        for _, fn in inspect.getmembers(module, inspect.isfunction):
            assert "max_n" not in inspect.signature(fn).parameters, fn
    sizes = [8, 16, 24, 40, 64, 80, 128]
    paths = spark.createDataFrame([(n,) for n in sizes], "n int").withColumn("tri", generate.path_graph("cast(sequence(0, n - 1) as array<int>)"))
    lines = paths.select(graph6.to_text().alias("g6"))
    got = {r.n_vertices: r for r in features.feature_table(lines, with_gap=False).collect()}
    assert sorted(got) == sizes
    for n, r in got.items():
        assert (r.max_matching_size, r.diameter, r.is_tree, r.is_bipartite) == (n // 2, n - 1, 1, 1)
    none = spark.createDataFrame([(0, []), (3, [0])], "n int, tri array<long>")
    assert {r.n for r in refinement.refine(none).collect()} == {0, 3} == {r.n for r in dense.spectra(none, ("lap",)).collect()}
    assert {r.n: r.pauli_num_terms for r in pauli.pauli_columns(none).collect()} == {0: None, 3: None}


def test_batches_read_few_rows_of_a_growing_target(spark, tmp_path, monkeypatch):
    from graphloom.functions import graph6
    from graphloom.catalog.graphs import dense_graphs
    from graphloom.streaming import incremental

    lines = dense_graphs(spark, "/root/testdata/sf0.01").select(graph6.to_text().alias("g6")).distinct().orderBy("g6").collect()
    lines = [spark.createDataFrame(lines[a:b], "g6 string") for a, b in ((0, 60), (60, 1200), (1200, 1206))]
    path, read = str(tmp_path / "table"), []
    kept = incremental.finished

    def watched(*args):
        out = kept(*args)
        read.append(out.count())
        return out

    monkeypatch.setattr(incremental, "finished", watched)
    for some in lines:
        incremental.append_features(some, path, with_gap=False, rows_per_part=8)
    table = incremental.existing_table(spark, path)
    size = table.count()
    assert size > 800 and read[0] == 0 and read[2] <= 6 * 3 * 2 * 8 < size / 2
    depths = {r["depth"] for r in spark.read.parquet(path).select("depth").distinct().collect()}
    assert len(depths) > 1
    # A batch of which only some rows were written, and the whole batch again.
    for some in lines:
        incremental.append_features(some.limit(20), path, with_gap=False, rows_per_part=8)
        incremental.append_features(some, path, with_gap=False, rows_per_part=8)
    again = incremental.existing_table(spark, path)
    assert again.count() == size == again.select("graph_id").distinct().count()


def test_counters_of_lines_are_those_of_the_outcomes(spark):
    from graphloom.plans import features

    lines = spark.createDataFrame([("C~",), ("C~",), ("C?",), ("!!",), ("D~{",)], "g6 string")
    table, stats = features.counted_graphs(lines)
    want = {r["outcome"]: r["n"] for r in features.line_outcomes(lines).groupBy("outcome").agg(F.sum("copies").alias("n")).collect()}
    assert {k: v for k, v in stats.items() if v and k != "lines"} == {k: v for k, v in want.items() if v} and stats["lines"] == 5
    none, stats = features.counted_graphs(lines, table)
    assert none.count() == 0 and stats["parsed"] == 0 and stats["duplicate"] == 3


def test_a_feature_of_ones_own(spark):
    """Registered from outside, it takes what other steps give, and the rest is as before."""
    own = FEATURES.copy()
    own.register(GraphFeature(("n_leaves",), ("n", "deg"), lambda df, wide: df.withColumn("n_leaves", F.expr("size(filter(deg, d -> d = 1))"))))
    own.register(GraphFeature(("leaf_share",), ("n", "n_leaves"), lambda df, wide: df.withColumn("leaf_share", F.expr("n_leaves / n")), True))
    graphs = {k: g for k, g in GOLDEN.items() if k in ("star", "P8", "K8")} | {"P80": (80, [(i, i + 1) for i in range(79)])}
    lines = packed_of(spark, graphs).select(graph6.to_text().alias("g6"))
    table = features.feature_table(lines, with_gap=False, extra=("n_leaves", "leaf_share"), features=own)
    assert sorted((r.n_vertices, r.triangle_count, r.n_leaves, r.leaf_share) for r in table.collect()) == [
        (8, 0, 2, 0.25), (8, 0, 7, 0.875), (8, 56, 0, 0.0), (80, 0, 2, 0.025)]
    plain = features.feature_table(lines, with_gap=False)
    assert sorted(map(tuple, table.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    gated = by_id(features.gated(packed_of(spark, graphs), {"n_leaves": 64, "diameter": 200, "leaf_share": 64}, own))
    assert {k: (r.n_leaves, r.diameter) for k, r in gated.items()} == {"star": (7, 2), "P8": (2, 7), "K8": (0, 1), "P80": (None, 79)}


def test_features_are_planned_once_and_checked():
    names = [step.gives for step in FEATURES.order(["diameter", "is_tree", "avg_clustering"])]
    assert len(names) == len(set(names)) and names.index(("adj",)) < names.index(("around",)) < names.index(("diameter",))
    assert ("clique_number",) not in names
    own = Registry([GraphFeature(("a",), ("b",), lambda df, wide: df), GraphFeature(("b",), ("a",), lambda df, wide: df)])
    with pytest.raises(ValueError, match="itself"):
        own.order(["a"])
    with pytest.raises(KeyError, match="no step gives c"):
        own.order(["c"])
    with pytest.raises(ValueError, match="already"):
        own.register(GraphFeature(("a",), (), lambda df, wide: df))


def test_degrees_by_grouping_deal_the_links_once(spark, monkeypatch):
    from graphloom import session

    links = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 0, 1), (2, 0, 3)], "graph_id long, u int, v int")
    graphs = spark.createDataFrame([(1, 4), (2, 4), (3, 2), (4, 0)], "graph_id long, n int")
    got = {(r.graph_id, r.vertex): r.d for r in topology.degrees_by_grouping(links.distinct(), graphs).collect()}
    want = {1: [1, 2, 1, 0], 2: [1, 0, 0, 1], 3: [0, 0]}
    assert got == {(k, v): d for k, ds in want.items() for v, d in enumerate(ds)}
    monkeypatch.setattr(session, "TASK_ROWS", 2)
    edges = session.dealt(links, 30, "graph_id").distinct()  # 15 tasks for 30 rows
    assert edges.rdd.getNumPartitions() == 15
    plan = topology.degrees_by_grouping(edges, edges.select("graph_id").distinct().withColumn("n", F.lit(4)))._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", plan))) == {"graph_id, 15"}
