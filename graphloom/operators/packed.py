"""One row per graph.

A graph is kept as `(graph_id, n, tri)`: `tri` holds the upper triangle of the
adjacency matrix, taken column by column, as 60-bit words with the first position
in the highest bit. 60 is ten graph6 characters, so text and words convert by
shifts alone. Everything computed from a packed row is a narrow projection: no
shuffle, however many graphs there are.

From `tri` the projections below need the neighbour sets, one bit set per vertex:

* up to 64 vertices: `adj ARRAY<BIGINT>`, bit j of element i is the link i-j;
* beyond: `adj ARRAY<ARRAY<BIGINT>>`, 64 bits per inner element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.bitset import sets
from graphloom.session import spread

WORD = 60
NARROW_MAX = 64


def bind(name: str, body: str) -> str:
    """`body` with the column `name` worked out once beforehand.

    Catalyst merges neighbouring projections when a column is named only once, also
    where that one place is inside a lambda and so runs many times. Binding the
    column to a lambda variable of the same name keeps it to one evaluation."""
    return f"transform(array({name}), {name} -> {body})[0]"


def position(u: Column | str, v: Column | str) -> Column:
    """Place of the link u-v (u < v) in the upper triangle taken by columns."""
    u = F.col(u) if isinstance(u, str) else u
    v = F.col(v) if isinstance(v, str) else v
    return (F.shiftright(v.cast("bigint") * (v - 1), 1) + u).cast("bigint")


def words_needed(n: str) -> str:
    return f"cast(ceil(({n} * ({n} - 1) / 2) / {WORD}) as int)"


def pack_edges(edges: DataFrame, graphs: DataFrame | None = None, n: int | None = None,
               keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """Packed rows from links `(keys, u, v)` with u < v; repeated links count once.

    Either every graph has `n` vertices, or `graphs` gives `(keys, n)`, in which
    case graphs without any link are kept too. Links are merged on the map side
    (bit_or), so a graph with very many repeated links arrives as a few words.
    """
    keys = list(keys)
    p = position("u", "v")
    bit = F.expr(f"shiftleft(1L, cast({WORD - 1} - p % {WORD} as int))")
    located = edges.select(*keys, p.alias("p"))
    if n is not None and n * (n - 1) // 2 <= WORD:
        packed = located.groupBy(*keys).agg(F.bit_or(bit).alias("w"))
        packed = packed.select(*keys, F.lit(n).alias("n"), F.array("w").alias("tri"))
        if graphs is None:
            return packed
        return graphs.select(*keys).join(packed.drop("n"), keys, "left").select(
            *keys, F.lit(n).alias("n"), F.coalesce("tri", F.expr("array(0L)")).alias("tri")
        )
    words = located.groupBy(*keys, F.expr(f"p div {WORD}").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    # At most 8,729 words for the 1,024 vertices of the largest graphs.
    maps = words.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    if graphs is None:
        sized = maps.withColumn("n", F.lit(n))
    else:
        sized = graphs.select(*keys, "n").join(maps, keys, "left")
    tri = F.expr(
        f"if(n < 2, cast(array() as array<bigint>), transform(sequence(0, {words_needed('n')} - 1), "
        "w -> coalesce(m[w], 0L)))"
    )
    return sized.select(*keys, F.col("n").cast("int").alias("n"), tri.alias("tri"))


def links_of(tri: str = "tri", n: str = "n") -> Column:
    """ARRAY<STRUCT<u, v>> of the links, found word by word."""
    return F.expr(
        f"""transform(
          flatten(transform({tri}, (w, i) -> if(w = 0, cast(array() as array<int>),
            transform(filter(sequence(0, {WORD - 1}), s -> (shiftright(w, {WORD - 1} - s) & 1) = 1),
                      s -> i * {WORD} + s)))),
          p -> named_struct(
            'u', cast(p - (cast(floor((1 + sqrt(1 + 8D * p)) / 2) as int)
                 * (cast(floor((1 + sqrt(1 + 8D * p)) / 2) as int) - 1)) / 2 as int),
            'v', cast(floor((1 + sqrt(1 + 8D * p)) / 2) as int)))"""
    )


def unpack_edges(packed: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """Links `(keys, u, v)` with u < v, one row each."""
    return packed.select(*keys, F.explode(links_of()).alias("e")).select(*keys, "e.u", "e.v")


# The bit of the link i-j, j < i: row i of the triangle is one run of positions.
_BIT = (f"(shiftright(tri[cast((shiftright(i * (i - 1), 1) + j) div {WORD} as int)], "
        f"cast({WORD - 1} - (shiftright(i * (i - 1), 1) + j) % {WORD} as int)) & 1L)")


def _narrow_adjacency() -> Column:
    """Lower rows from the words, then each completed from the rows below it."""
    low = f"""transform(sequence(0, n - 1), i -> if(i = 0, 0L,
        aggregate(sequence(0, i - 1), 0L, (acc, j) -> acc | shiftleft({_BIT}, j))))"""
    full = """transform(low, (l, i) -> if(i = n - 1, l,
        aggregate(sequence(i + 1, n - 1), l, (acc, j) -> acc | shiftleft(shiftright(low[j], i) & 1L, j))))"""
    return F.expr(bind("tri", f"if(n < 1, cast(array() as array<bigint>), transform(array({low}), low -> {full})[0])"))


def _wide_adjacency() -> Column:
    """The same with rows of several blocks."""
    low = f"""transform(sequence(0, n - 1), i -> transform(sequence(0, cast((n - 1) div 64 as int)), b -> if(b * 64 >= i, 0L,
        aggregate(sequence(b * 64, least(i - 1, b * 64 + 63)), 0L, (acc, j) -> acc | shiftleft({_BIT}, j & 63)))))"""
    full = """transform(low, (l, i) -> transform(l, (w, b) -> if(greatest(i + 1, b * 64) > least(n - 1, b * 64 + 63), w,
        aggregate(sequence(greatest(i + 1, b * 64), least(n - 1, b * 64 + 63)), w, (acc, j) ->
          acc | shiftleft(shiftright(low[j][shiftright(i, 6)], i & 63) & 1L, j & 63)))))"""
    return F.expr(bind("tri", f"transform(array({low}), low -> {full})[0]"))


def with_adjacency(packed: DataFrame, wide: bool = False) -> DataFrame:
    return packed.withColumn("adj", _wide_adjacency() if wide else _narrow_adjacency())


def with_around(df: DataFrame, wide: bool = False) -> DataFrame:
    """Adds `around`, the neighbours of each vertex as lists, next to `adj`. Steps that
    go over the links of a vertex again and again take these."""
    has = sets(wide).has("a", "j")
    return df.withColumn("around", F.expr(bind(
        "adj", f"if(n < 1, cast(array() as array<array<int>>), transform(adj, a -> filter(sequence(0, n - 1), j -> {has})))")))


def spread_large(packed: DataFrame) -> DataFrame:
    """Large graphs dealt over all cores: few bytes each, but seconds of work. All
    columns are hashed, so copies of one graph do not meet in one task."""
    return spread(packed, *packed.columns)


def by_width(packed: DataFrame, compute) -> DataFrame:
    """Apply `compute(frame, wide)` to the graphs of each width, split on their own n;
    store mixed sizes partitioned by n so that each side reads its own files only."""
    narrow = compute(packed.where(F.col("n") <= NARROW_MAX), False)
    wide = compute(spread_large(packed.where(F.col("n") > NARROW_MAX)), True)
    return narrow.unionByName(wide)
