"""Shape of each graph: sizes, degrees, triangles, reachability, matchings.

All functions take packed rows and add columns; nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.bitset import sets
from graphloom.operators.packed import bind, by_width, with_adjacency, with_around

SMALL_MATCHING = 16


def link_count(df: DataFrame) -> DataFrame:
    return df.withColumn("m", F.expr("cast(aggregate(deg, 0L, (acc, d) -> acc + d) div 2 as bigint)"))


def degrees(df: DataFrame, wide: bool) -> DataFrame:
    s = sets(wide)
    return link_count(df.withColumn("deg", F.expr(f"transform(adj, a -> {s.size('a')})")))


def size_columns(df: DataFrame) -> DataFrame:
    """m, edge_density = 2m / n(n-1), zero below two vertices."""
    return df.withColumn(
        "edge_density", F.expr("if(n < 2, 0D, 2D * m / (cast(n as double) * (n - 1)))")
    )


def degree_columns(df: DataFrame) -> DataFrame:
    """Largest, smallest and mean degree and population variance, vertices of
    degree zero included. The variance is taken from whole-number sums."""
    squares = "aggregate(deg, 0L, (acc, d) -> acc + cast(d as bigint) * d)"
    return (
        df.withColumn("max_degree", F.expr("coalesce(array_max(deg), 0)"))
        .withColumn("min_degree", F.expr("coalesce(array_min(deg), 0)"))
        .withColumn("avg_degree", F.expr("if(n = 0, 0D, 2D * m / n)"))
        .withColumn(
            "degree_variance",
            F.expr(f"if(n = 0, 0D, cast(n * {squares} - 4 * m * m as double) / (cast(n as double) * n))"),
        )
        .withColumn("is_regular", F.expr("cast(max_degree = min_degree as int)"))
        .withColumn("chromatic_index_lower_bound", F.col("max_degree"))
    )


def corner_column(df: DataFrame, wide: bool) -> DataFrame:
    """`tri2`, twice the triangles at each vertex: common neighbours over its own
    neighbours."""
    s = sets(wide)
    at_vertex = f"""transform(adj, (a, i) -> aggregate(around[i], 0L, (acc, j) -> acc + {s.size(s.meet('a', 'adj[j]'))}))"""
    return df.withColumn("tri2", F.expr(bind("adj", bind("around", at_vertex))))


def triangle_totals(df: DataFrame) -> DataFrame:
    """Triangles, and the mean over all vertices of 2T(v) / d(d-1)."""
    return (
        df.withColumn("triangle_count", F.expr("cast(aggregate(tri2, 0L, (acc, t) -> acc + t) div 6 as bigint)"))
        .withColumn(
            "avg_clustering",
            F.expr(
                "if(n = 0, 0D, aggregate(zip_with(tri2, deg, (t, d) -> "
                "if(d < 2, 0D, t / (cast(d as double) * (d - 1)))), 0D, (acc, c) -> acc + c) / n)"
            ),
        )
    )


def triangle_columns(df: DataFrame, wide: bool) -> DataFrame:
    return triangle_totals(corner_column(df, wide))


def component_columns(df: DataFrame, wide: bool) -> DataFrame:
    """Number of components and whether two colours suffice.

    One sweep per graph grows an even and an odd set from the lowest vertex not yet
    seen. A new component starts when both sets are stable; a vertex in both sets
    is an odd cycle."""
    s = sets(wide)
    seen = s.union("st.even", "st.odd")
    grow_even = (f"aggregate(sequence(0, n - 1), st.even, (acc, i) -> "
                 f"if({s.has('st.odd', 'i')}, {s.union('acc', 'adj[i]')}, acc))")
    grow_odd = (f"aggregate(sequence(0, n - 1), st.odd, (acc, i) -> "
                f"if({s.has('st.even', 'i')}, {s.union('acc', 'adj[i]')}, acc))")
    fresh = f"array_min(filter(sequence(0, n - 1), i -> not {s.has(seen, 'i')}))"
    # `new` carries the grown sets, so that growth is worked out once per round.
    round_ = f"""if(st.done, st, aggregate(
        array(named_struct('even', {grow_even}, 'odd', {grow_odd})), st, (old, new) ->
          case when new.even <> old.even or new.odd <> old.odd
                 then named_struct('even', new.even, 'odd', new.odd, 'parts', old.parts, 'done', false)
               when {s.size(s.union('old.even', 'old.odd'))} >= n
                 then named_struct('even', old.even, 'odd', old.odd, 'parts', old.parts, 'done', true)
               else named_struct('even', {s.union('old.even', s.single(fresh.replace('st.', 'old.')))},
                                 'odd', old.odd, 'parts', old.parts + 1, 'done', false)
          end))"""
    start = f"named_struct('even', {s.empty}, 'odd', {s.empty}, 'parts', 0, 'done', n < 1)"
    swept = f"if(n < 1, {start}, aggregate(sequence(1, 3 * n + 1), {start}, (st, r) -> {round_}))"
    return (
        df.withColumn("sweep", F.expr(bind("adj", swept)))
        .withColumn("n_components", F.expr("sweep.parts"))
        .withColumn("is_connected", F.expr("cast(sweep.parts = 1 as int)"))
        .withColumn("is_bipartite", F.expr(f"cast({s.size(s.meet('sweep.even', 'sweep.odd'))} = 0 as int)"))
        .drop("sweep")
    )


def distance_columns(df: DataFrame, wide: bool) -> DataFrame:
    """Diameter: rounds until every vertex has reached every other, NULL if that
    never happens. All sources advance together, one round per distance."""
    s = sets(wide)
    step = f"""transform(st.reach, (r, i) -> aggregate(around[i], r, (acc, j) -> {s.union('acc', 'st.reach[j]')}))"""
    start = f"""named_struct('reach', transform(sequence(0, n - 1), i -> {s.single('i')}), 'rounds', 0, 'done', n = 1)"""
    round_ = f"""if(st.done, st, aggregate(array({step}), st, (old, reach) ->
        if(reach = old.reach, named_struct('reach', old.reach, 'rounds', old.rounds, 'done', true),
           named_struct('reach', reach, 'rounds', old.rounds + 1,
                        'done', forall(reach, x -> {s.size('x')} = n)))))"""
    walked = f"aggregate(sequence(1, n), {start}, (st, r) -> {round_})"
    return df.withColumn("walk", F.expr(bind("around", f"if(n < 1, null, {walked})"))).withColumn(
        "diameter", F.expr(f"if({s.size('walk.reach[0]')} = n, walk.rounds, null)")
    ).drop("walk")


def cycle_columns(df: DataFrame) -> DataFrame:
    """Tree test, and the cycle space dimension m - n + 1 of connected graphs."""
    return df.withColumn("is_tree", F.expr("cast(m = n - 1 and is_connected = 1 as int)")).withColumn(
        "cycle_count", F.expr("if(is_connected = 1, m - n + 1, null)")
    )


def clique_column(df: DataFrame, wide: bool = False) -> DataFrame:
    """Largest clique. Round k holds, for every clique of k vertices, the vertices
    above its last one that are linked to all of it; equal candidate sets are one.
    Exponential in the worst case, so callers gate it on size."""
    s = sets(wide)
    first = f"array_distinct(transform(adj, (a, v) -> {s.meet('a', s.above('v'))}))"
    grow = f"""array_distinct(flatten(transform(st.cands, c -> transform(
        filter(sequence(0, n - 1), w -> {s.has('c', 'w')}),
        w -> {s.meet(s.meet('c', 'adj[w]'), s.above('w'))}))))"""
    start = f"named_struct('cands', {first}, 'size', 1)"
    round_ = f"""if(size(st.cands) = 0, st, aggregate(array({grow}), st, (old, cands) ->
        named_struct('cands', cands, 'size', if(size(cands) > 0, old.size + 1, old.size))))"""
    found = f"aggregate(sequence(1, n), {start}, (st, r) -> {round_}).size"
    return df.withColumn("clique_number", F.expr(bind("adj", f"if(n < 1, 1, {found})")))


def small_matching_column(df: DataFrame) -> DataFrame:
    """Largest matching, exact, for up to 16 vertices.

    Vertices are passed in order. A state is the set of later vertices already
    taken, with the number of links chosen in the bits above; each vertex is left
    alone or joined to a later free neighbour. Equal states are one."""
    free = "filter(sequence(v + 1, n - 1), w -> (shiftright(adj[v], w) & 1L) = 1L and (shiftright(s, w) & 1L) = 0L)"
    options = f"""if((shiftright(s, v) & 1L) = 1L, array(s & ~shiftleft(1L, v)),
        if(v + 1 > n - 1, array(s), concat(array(s), transform({free}, w -> s + shiftleft(1L, w) + shiftleft(1L, 20)))))"""
    states = f"""aggregate(sequence(0, n - 1), array(0L), (states, v) ->
        array_distinct(flatten(transform(states, s -> {options}))))"""
    return df.withColumn(
        "max_matching_size",
        F.expr(bind("adj", f"if(n < 1, 0, cast(array_max(transform({states}, s -> shiftright(s, 20))) as int))")),
    )


def with_degrees(packed: DataFrame) -> DataFrame:
    return by_width(
        packed,
        lambda df, wide: degree_columns(size_columns(degrees(with_adjacency(df, wide), wide))).drop("adj", "deg"),
    )


def with_triangles(packed: DataFrame) -> DataFrame:
    return by_width(
        packed,
        lambda df, wide: triangle_columns(
            degrees(with_around(with_adjacency(df, wide), wide), wide), wide
        ).drop("adj", "around", "deg", "tri2"),
    )


def with_components(packed: DataFrame) -> DataFrame:
    return by_width(
        packed,
        lambda df, wide: cycle_columns(
            component_columns(degrees(with_adjacency(df, wide), wide), wide)
        ).drop("adj", "deg"),
    )


def with_diameter(packed: DataFrame) -> DataFrame:
    return by_width(
        packed,
        lambda df, wide: distance_columns(with_around(with_adjacency(df, wide), wide), wide).drop("adj", "around"),
    )


def with_clique(packed: DataFrame) -> DataFrame:
    """Clique number of graphs of all sizes; exponential in the worst case, so ask for
    it only where it is wanted."""
    return by_width(packed, lambda df, wide: clique_column(with_adjacency(df, wide), wide).drop("adj"))


# ---------------------------------------------------------------------------
# the same figures by joins and grouping over the link table
# ---------------------------------------------------------------------------


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.select(
        "graph_id", F.explode(F.expr("array(named_struct('src', u, 'dst', v), named_struct('src', v, 'dst', u))")).alias("e")
    ).select("graph_id", "e.src", "e.dst")


def degrees_by_grouping(edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """`(graph_id, n, vertex, d)` with vertices of degree zero, from a link table. The degrees
    of a graph meet in one row: where both frames are dealt by `graph_id`, as often as
    their size asks, nothing is dealt again."""
    counted = both_directions(edges).groupBy("graph_id", F.col("src").alias("vertex")).agg(F.count("*").alias("d"))
    found = counted.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("vertex", "d"))).alias("m"))
    every = F.expr("if(n < 1, cast(array() as array<bigint>), transform(sequence(0, n - 1), v -> coalesce(m[v], 0L)))")
    return graphs.select("graph_id", "n").join(found, "graph_id", "left").select(
        "graph_id", "n", F.posexplode(every).alias("vertex", "d"))


def triangles_by_joins(edges: DataFrame) -> DataFrame:
    """Triangles per graph from the link table: u<v, u<w joined on u, closed on v<w."""
    left = edges.select("graph_id", "u", F.col("v").alias("v1"))
    right = edges.select("graph_id", "u", F.col("v").alias("v2"))
    wedges = left.join(right, ["graph_id", "u"]).where("v1 < v2")
    closing = edges.select("graph_id", F.col("u").alias("v1"), F.col("v").alias("v2"))
    return wedges.join(closing, ["graph_id", "v1", "v2"]).groupBy("graph_id").agg(F.count("*").alias("triangle_count"))
