"""Synthetic graph collections, made where the rows are.

A graph is drawn from its keys by an arithmetic hash, so the same keys give the same
graph on any partitioning. Graphs are built straight into packed rows: no pair of
vertices becomes a row of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import HASH_MODULUS, is_power_of_two
from graphloom.operators import refinement, topology
from graphloom.operators.ordering import rank_in_group
from graphloom.operators.packed import WORD, bind, words_needed
from graphloom.session import counted_in, spread, written


def draw(seed: str, graph: str, place: str) -> str:
    """Text of a hash of three whole numbers into [0, HASH_MODULUS): two squaring steps."""
    m = HASH_MODULUS
    start = f"(({seed}) * 104729L + (({graph}) % {m}) * 7919L + ({place}) * 1299709L + 12345L) % {m}"
    return (f"transform(transform(array({start}), h -> (h * h + 12345L * h + 7L) % {m}), "
            f"h -> (h * h + 54321L * h + 11L) % {m})[0]")


def random_graph(n: str = "n", p: str = "p", seed: str = "seed", graph: str = "graph_no") -> Column:
    """`tri` of G(n, p): every pair is a link with probability p on its own."""
    return F.expr(
        f"""if({n} < 2, cast(array() as array<bigint>), transform(sequence(0, {words_needed(n)} - 1), w ->
          aggregate(sequence(0, {WORD - 1}), 0L, (acc, k) -> shiftleft(acc, 1) |
            if(w * {WORD} + k < {n} * ({n} - 1) div 2, if({draw(seed, graph, f'w * {WORD} + k')} < {p} * {HASH_MODULUS}, 1L, 0L), 0L))))"""
    )


def cell_seed(base: Column, n: Column, p: Column) -> Column:
    """Seed of a (n, p) cell: the same whatever cells are made beside it."""
    return (base + F.floor(p * 1000) + n).cast("bigint")


def counting_order(offset: str = "0", reverse: str = "false") -> str:
    """Vertices 0..n-1 from an offset on, wrapped round, possibly backwards."""
    order = f"transform(sequence(0, n - 1), i -> cast((i + {offset}) % n as int))"
    return f"if({reverse}, reverse({order}), {order})"


def xor_order(mask: str) -> str:
    return f"transform(sequence(0, n - 1), i -> cast(i ^ {mask} as int))"


def perturbed_order(swaps: str, seed: str, graph: str) -> str:
    """Swaps of neighbours at drawn places 1..n-2, one after the other."""
    at = f"cast(1 + {draw(seed, graph, 't')} % (n - 2) as int)"
    swap = ("transform(o, (x, i) -> case when i = a then o[a + 1] when i = a + 1 then o[a] else x end)")
    return (f"if(n < 3, sequence(0, n - 1), aggregate(sequence(1, {swaps}), sequence(0, n - 1), "
            f"(o, t) -> transform(array({at}), a -> {swap})[0]))")


def segment_order(length: str, seed: str, graph: str) -> str:
    """Each segment of the given length reversed or not by a drawn coin."""
    start = f"(i div {length}) * {length}"
    flipped = f"{start} + least({start} + {length}, n) - 1 - i"
    coin = draw(seed, graph, f"i div {length}")
    return f"transform(sequence(0, n - 1), i -> cast(if({coin} * 2 > {HASH_MODULUS}, {flipped}, i) as int))"


def _words(positions: str) -> str:
    """`tri` words from an array of positions."""
    slots = f"array_distinct(transform(ps, p -> cast(p div {WORD} as int)))"
    bits = (f"aggregate(filter(ps, p -> cast(p div {WORD} as int) = s), 0L, "
            f"(acc, p) -> acc | shiftleft(1L, cast({WORD - 1} - p % {WORD} as int)))")
    table = f"map_from_arrays({slots}, transform({slots}, s -> {bits}))"
    return (f"transform(array({positions}), ps -> transform(array({table}), m -> "
            f"transform(sequence(0, {words_needed('n')} - 1), w -> coalesce(m[w], 0L)))[0])[0]")


def _path_positions(order: str) -> str:
    u, v = "least(o[i], o[i + 1])", "greatest(o[i], o[i + 1])"
    place = f"cast({v} as bigint) * ({v} - 1) div 2 + {u}"
    return f"transform(array({order}), o -> transform(sequence(0, n - 2), i -> {place}))[0]"


def path_graph(order: str) -> Column:
    """`tri` of the path that visits the vertices in the given order."""
    return F.expr(_words(_path_positions(order)))


def path_with_extra_links(order: str, extra: str, seed: str, graph: str) -> Column:
    """The path and `extra` other pairs, the first of all others in a drawn order."""
    drawn = draw(seed, graph, "p")
    others = f"filter(sequence(0L, cast(n * (n - 1) div 2 - 1 as bigint)), p -> not array_contains(ps0, p))"
    chosen = (f"transform(slice(array_sort(transform({others}, p -> named_struct('h', {drawn}, 'p', p))), 1, "
              f"cast({extra} as int)), c -> c.p)")
    return F.expr(f"transform(array({_path_positions(order)}), ps0 -> {_words(f'concat(ps0, {chosen})')})[0]")


def judged(graphs: DataFrame, require_connected: bool = True) -> DataFrame:
    """Adds m, is_connected, wl_key and `outcome` (empty, disconnected or NULL)."""
    seen = refinement.refine(topology.with_components(graphs))
    disconnected = F.lit(require_connected) & (F.col("is_connected") == 0)
    return seen.withColumn("outcome", F.when(F.col("m") == 0, "empty").when(disconnected, "disconnected")).drop(
        "colours", "n_colours", "n_components", "is_bipartite", "is_tree", "cycle_count")


OUTCOMES = ("generated", "duplicate", "empty", "disconnected")


def attempts(graphs: DataFrame, cell: list[str], seq: str, want: str,
             require_connected: bool = True, existing: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """All attempts up to the one that filled their cell, with their `outcome`, as a
    table, and the totals.

    Kept (`generated`) are the first `want` new graphs of each cell in the order of
    `seq`. Empty, disconnected (if asked) and repeated graphs (equal refinement key
    within the cell, first wins) are passed over, and so are those in `existing
    (n, wl_key)`. `want` is a column of `graphs`; a table of graphs that are `judged`
    already is taken as it is."""
    known = graphs if "outcome" in graphs.columns else written(judged(graphs, require_connected), "attempts")
    fine = known.where("outcome is null")
    if existing is not None:  # known graphs count as duplicates and take no place
        fine = refinement.drop_existing(fine, existing, ["n", "wl_key"])
    first = refinement.first_of_each(fine, [*cell, "wl_key"], seq, [seq])
    ranked = rank_in_group(first, cell, [F.col(seq)], "__rank")
    targets = known.select(*cell, want).distinct()
    taken = written(ranked.join(targets, cell).where(F.col("__rank") <= F.col(want)).select(
        *cell, seq, "__rank", F.col(want).alias("__want")), "taken")
    last = taken.groupBy(*cell).agg(F.max(F.when(F.col("__rank") == F.col("__want"), F.col(seq))).alias("__last"))
    tried = known.join(last, cell, "left").where(F.col("__last").isNull() | (F.col(seq) <= F.col("__last")))
    marked = tried.join(taken.select(*cell, seq, F.lit(1).alias("__in")), [*cell, seq], "left")
    outcome = F.coalesce("outcome", F.when(F.col("__in") == 1, "generated").otherwise("duplicate"))
    marked = marked.select(*[c for c in known.columns if c != "outcome"], outcome.alias("outcome"))
    counted = [F.count_if(F.col("outcome") == name).alias(name) for name in OUTCOMES]
    table = written(marked, "marked")
    return table, counted_in(table, F.count(F.lit(1)).alias("attempts"), *counted)


def accept(graphs: DataFrame, cell: list[str], seq: str, want: str,
           require_connected: bool = True, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The kept graphs, and `(cell, outcome, n_graphs)` over the attempts up to the one
    that filled the cell."""
    marked, _ = attempts(graphs, cell, seq, want, require_connected, existing)
    return marked.where("outcome = 'generated'").drop("outcome"), marked.groupBy(*cell, "outcome").agg(F.count("*").alias("n_graphs"))


def short_runs(counters: DataFrame, wanted: DataFrame, cell: list[str], want: str) -> DataFrame:
    """Cells that stayed below what was wanted: `(cell, n_graphs, want)`."""
    made = counters.where("outcome = 'generated'").select(*cell, "n_graphs")
    return wanted.join(made, cell, "left").withColumn("n_graphs", F.coalesce("n_graphs", F.lit(0).cast("bigint"))).where(
        F.col("n_graphs") < F.col(want))


def structured_attempts(sizes: DataFrame, want: str, seed: str = "seed") -> DataFrame:
    """All variants for each row `(n, want, seed)` in priority order: counting paths with
    every offset and direction, XOR-permuted paths with every mask, paths with 1-4
    extra links (six tries per wanted graph), then segment-reversed and perturbed
    paths in turn (four tries each). `seq` orders them."""
    sizes = sizes.where(is_power_of_two("n"))
    base = "cast(sequence(0, n - 1) as array<int>)"

    def tries(count: str, priority: int, step: int = 1, at: int = 0) -> DataFrame:
        k = spread(sizes.withColumn("k", F.explode(F.expr(f"sequence(0L, cast({count} as bigint) - 1)"))), "n", "k")
        return k.withColumn("seq", F.expr(f"{priority} * 1000000000000000L + k * {step} + {at}"))

    variants = [
        (tries("2 * n", 1), "counting_path", path_graph(counting_order("k div 2", "k % 2 = 1"))),
        (tries("n", 2).where("k > 0"), "xor_permuted", path_graph(xor_order("cast(k as int)"))),
        (tries(f"{want} * 6", 3), "extra_edges", path_with_extra_links(base, "1 + k % 4", f"{seed} + 1000", "k")),
        (tries(f"{want} * 4", 4, 2), "segment_reversed", path_graph(segment_order("4", seed, "k"))),
        (tries(f"{want} * 4", 4, 2, 1), "perturbed", path_graph(perturbed_order("1", f"{seed} + 1", "k"))),
    ]
    out = None
    for frame, name, tri in variants:
        part = frame.select("n", want, seed, "seq", F.lit(name).alias("variant"), tri.alias("tri"))
        out = part if out is None else out.unionByName(part)
    return out
