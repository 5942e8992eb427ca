"""Certificates of largest matchings: the bound proves the size, brute force agrees."""

import itertools
import random

import numpy as np

from graphloom.operators import dense, matching, topology
from graphloom.operators.packed import pack_edges, with_adjacency

from tests.test_graphs import GOLDEN, by_id, packed_of, random_graphs


def brute_missable(n, edges):
    best, missed = -1, set()

    def grow(at, used, size):
        nonlocal best, missed
        if at == len(edges):
            if size > best:
                best, missed = size, set()
            if size == best:
                missed |= {v for v in range(n) if v not in used}
            return
        grow(at + 1, used, size)
        u, v = edges[at]
        if u not in used and v not in used:
            grow(at + 1, used | {u, v}, size + 1)

    grow(0, frozenset(), 0)
    return best, missed


def test_missable_vertices_by_brute_force(spark):
    rng = random.Random(4)
    graphs = {f"g{i}": (7, rng.sample(list(itertools.combinations(range(7), 2)), rng.randint(0, 11))) for i in range(30)}
    got = by_id(dense.missable(packed_of(spark, graphs)))
    for k, (n, e) in graphs.items():
        assert (got[k].max_matching_size, set(got[k].missable)) == brute_missable(n, e), k


def test_random_graphs_of_all_sizes_are_proven(spark):
    graphs = random_graphs([5, 16, 31, 32, 64, 65, 128], 6) | GOLDEN
    rng = random.Random(9)
    for n in (32, 63, 90, 128):  # sparse ones and trees leave many vertices alone
        graphs[f"tree-{n}"] = (n, [(rng.randrange(max(0, v - 9), v), v) for v in range(1, n)])
        graphs[f"hub-{n}"] = (n, [(u, v) for u in range(3) for v in range(3, n)])
        graphs[f"rare-{n}"] = (n, sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(n * 2 // 3)}))
    packed = packed_of(spark, graphs)
    got = by_id(matching.certified(packed))
    assert set(got) == set(graphs) and all(r.certified == 1 for r in got.values())
    assert {got[f"hub-{n}"].max_matching_size for n in (32, 63, 90, 128)} == {3} and got["hub-90"].barrier == [0, 1, 2]
    assert any(len(r.barrier) > 5 for r in got.values())
    small = {k: g for k, g in graphs.items() if g[0] <= 16}
    want = by_id(topology.small_matching_column(with_adjacency(packed_of(spark, small))))
    assert all(got[k].max_matching_size == want[k].max_matching_size for k in small)


def test_odd_parts_and_bound_of_a_given_barrier(spark):
    graphs = {"star": GOLDEN["star"], "P8": GOLDEN["P8"], "K8": GOLDEN["K8"]}
    from pyspark.sql import functions as F

    df = with_adjacency(packed_of(spark, graphs)).withColumn("barrier", F.expr("array(7)"))
    got = {k: r.odd_parts for k, r in by_id(matching.odd_parts_column(df, False)).items()}
    assert got == {"star": 7, "P8": 1, "K8": 1}


def test_barriers_on_stacks_are_those_of_expressions(spark):
    graphs = random_graphs([7, 16, 31, 40, 128], 5) | {k: GOLDEN[k] for k in ("star", "P8", "K8")}
    found = dense.barriers(dense.missable(packed_of(spark, graphs)))
    assert any(len(r.barrier) > 1 for r in found.collect())
    plain = with_adjacency(found.drop("odd_parts"), True)
    want = {k: r.odd_parts for k, r in by_id(matching.odd_parts_column(plain, True)).items()}
    assert {k: r.odd_parts for k, r in by_id(found).items()} == want


def test_graphs_with_a_matching_of_all_vertices_need_no_elimination(monkeypatch):
    rng = np.random.default_rng(3)
    a = np.triu(rng.random((60, 24, 24)) < 0.4, 1)
    stack = np.ascontiguousarray((a | a.transpose(0, 2, 1)).astype(float))
    stack[:5, 0], stack[:5, :, 0] = 0, 0  # a vertex alone
    rank, _ = dense._kernel_support(stack, 1)
    sure = dense._regular(stack)
    assert not sure[:5].any() and (rank[sure] == 24).all() and sure.sum() == (rank == 24).sum() > 50
    assert not dense._regular(stack[:, :23, :23]).any() and not dense._regular(np.zeros((2, 4, 4))).any()
    asked = []
    slow = dense._kernel_support
    monkeypatch.setattr(dense, "_kernel_support", lambda x, seed: asked.append(len(x)) or slow(x, seed))
    got = dense.missing(stack, 1)
    assert sum(asked) == (~sure).sum() and (got[0] == rank // 2).all() and [len(x) > 0 for x in got[1]] == [r < 24 for r in rank]


def test_unlucky_ranks_are_told(spark, monkeypatch):
    """A rank that falls short leaves the bound above the size."""
    short = spark.createDataFrame([("a", 4, 2)], "graph_id string, n int, m int")
    edges = spark.createDataFrame([("a", 0, 1), ("a", 2, 3)], "graph_id string, u int, v int")
    packed = pack_edges(edges, short.select("graph_id", "n"))
    monkeypatch.setattr(dense, "missable", lambda df, seed: df.selectExpr("*", "1 as max_matching_size", "array(2, 3) as missable"))
    row = matching.certified(packed).first()
    assert (row.max_matching_size, row.matching_bound, row.certified) == (1, 2, 0)


def test_graphs_without_vertices(spark):
    none = spark.createDataFrame([("e", 0, []), ("x", 3, [0])], "graph_id string, n int, tri array<long>")
    got = by_id(matching.certified(none))
    assert {k: (r.max_matching_size, r.matching_bound, r.certified) for k, r in got.items()} == {"e": (0, 0, 1), "x": (0, 0, 1)}
    assert np.array_equal(got["x"].barrier, [])
