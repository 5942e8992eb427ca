"""Features of a graph as registered steps, planned into one narrow pass per width.

A step names the columns it adds and those it needs: of the packed row, or of other
steps. Asking for some features runs just the steps behind them, each once, in an order
in which every step finds what it needs; columns nobody asked for are dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import dense, pauli, spectral, topology
from graphloom.operators.packed import by_width, with_adjacency, with_around

PACKED = ("n", "tri")


class GraphFeature(NamedTuple):
    """`add(frame, wide)` adds the columns `gives` to frames of graphs up to 64 vertices
    (wide is false) or of more. With `whole` it takes the frame of all sizes instead,
    after the pass over the widths."""

    gives: tuple[str, ...]
    needs: tuple[str, ...]
    add: Callable[[DataFrame, bool], DataFrame]
    whole: bool = False


class Registry:
    def __init__(self, features: Iterable[GraphFeature] = ()) -> None:
        self._of: dict[str, GraphFeature] = {}
        for feature in features:
            self.register(feature)

    def register(self, feature: GraphFeature) -> GraphFeature:
        """A column can come from one step only, and not from the packed row."""
        if not feature.gives:
            raise ValueError("a feature that gives no column")
        for column in feature.gives:
            if column in self._of or column in PACKED:
                raise ValueError(f"column {column} already has a step")
        self._of.update(dict.fromkeys(feature.gives, feature))
        return feature

    def copy(self) -> Registry:
        out = Registry()
        out._of.update(self._of)
        return out

    def order(self, wanted: Iterable[str], there: Iterable[str] = ()) -> list[GraphFeature]:
        """The steps behind the wanted columns, each after those it needs; what is there
        already has no step."""
        there = {*PACKED, *there}
        out: list[GraphFeature] = []
        open_: list[GraphFeature] = []

        def visit(column: str, by: str) -> None:
            if column in there:
                return
            if column not in self._of:
                raise KeyError(f"no step gives {column}, wanted by {by}")
            step = self._of[column]
            if step in open_:
                raise ValueError(f"{column} needs itself")
            if step in out:
                return
            open_.append(step)
            for need in step.needs:
                visit(need, column)
                if not step.whole and need not in there and self._of[need].whole:
                    raise ValueError(f"{column} is of one width, but needs {need} of the whole frame")
            open_.pop()
            out.append(step)

        for column in wanted:
            visit(column, "the caller")
        return sorted(out, key=lambda step: step.whole)

    def columns(self, packed: DataFrame, wanted: Iterable[str]) -> DataFrame:
        """packed with the wanted columns. Columns that it has already are taken as they
        are, also by the steps that need them."""
        wanted = [c for c in dict.fromkeys(wanted) if c not in packed.columns]
        steps = self.order(wanted, packed.columns)
        narrow, whole = [s for s in steps if not s.whole], [s for s in steps if s.whole]
        later = {need for s in whole for need in s.needs}

        def compute(df: DataFrame, wide: bool) -> DataFrame:
            for step in narrow:
                df = step.add(df, wide)
            return df.select(*packed.columns, *[c for s in narrow for c in s.gives if (c in wanted or c in later) and c not in packed.columns])

        out = by_width(packed, compute) if narrow else packed
        for step in whole:
            out = step.add(out, False)
        return out.select(*packed.columns, *wanted)


SPECTRA = (*spectral.basic_expressions(), *spectral.rich_expressions())


def _spectra(df: DataFrame, wide: bool) -> DataFrame:
    """Vertex sets, if asked for as well, aren't the spectrum of the same name."""
    hidden = df.withColumnRenamed("adj", "__adj")
    return spectral.summaries(dense.spectra(hidden)).withColumnRenamed("__adj", "adj")


#: The features of the library. A caller's own go into a copy, or here for all to use.
FEATURES = Registry([
    GraphFeature(("adj",), ("n", "tri"), with_adjacency),
    GraphFeature(("around",), ("n", "adj"), with_around),
    GraphFeature(("deg",), ("adj",), topology.degrees),
    GraphFeature(("m",), ("deg",), lambda df, wide: topology.link_count(df)),
    GraphFeature(("edge_density",), ("n", "m"), lambda df, wide: topology.size_columns(df)),
    GraphFeature(("max_degree", "min_degree", "avg_degree", "degree_variance", "is_regular", "chromatic_index_lower_bound"),
                 ("n", "deg", "m"), lambda df, wide: topology.degree_columns(df)),
    GraphFeature(("tri2",), ("adj", "around"), topology.corner_column),
    GraphFeature(("triangle_count", "avg_clustering"), ("n", "deg", "tri2"), lambda df, wide: topology.triangle_totals(df)),
    GraphFeature(("n_components", "is_bipartite"), ("n", "adj"), topology.component_columns),
    GraphFeature(("is_connected",), ("n_components",), lambda df, wide: df.withColumn("is_connected", F.expr("cast(n_components = 1 as int)"))),
    GraphFeature(("is_tree", "cycle_count"), ("n", "m", "is_connected"), lambda df, wide: topology.cycle_columns(df)),
    GraphFeature(("diameter",), ("n", "around"), topology.distance_columns),
    GraphFeature(("clique_number",), ("n", "adj"), topology.clique_column),
    GraphFeature(("spectral_gap",), ("n", "tri"), lambda df, wide: spectral.gap_column(dense.spectra(df, ("lap",))).drop("lap"), True),
    GraphFeature(SPECTRA, ("n", "tri"), _spectra, True),
    GraphFeature(pauli.COLUMNS, ("n", "tri"), lambda df, wide: pauli.pauli_columns(df), True),
])

#: Gives in one pass over stacked graphs what those steps give one by one as expressions.
WALKS = GraphFeature(("deg", "tri2", "n_components", "is_bipartite", "diameter"), ("n", "tri"), lambda df, wide: dense.walks(df))


def with_walks(features: Registry) -> Registry:
    """A copy in which WALKS takes over from the library's own steps; pays where most of
    its columns are wanted."""
    out = features.copy()
    out._of.update({c: WALKS for c in WALKS.gives if features._of.get(c) is FEATURES._of[c]})
    return out


SHAPE = ("m", "edge_density", "max_degree", "min_degree", "avg_degree", "degree_variance", "is_regular", "chromatic_index_lower_bound",
         "triangle_count", "avg_clustering", "n_components", "is_connected", "is_bipartite", "is_tree", "cycle_count", "diameter")
