"""From graph text to the feature table, and the columns added to it later."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import dense, prep, topology
from graphloom.operators.pauli import COLUMNS as PAULI
from graphloom.operators.steps import FEATURES, SHAPE, SPECTRA, Registry, with_walks
from graphloom.sources import g6
from graphloom.functions.graph6 import graph_key, pack_text
from graphloom.session import counted_in, written
from graphloom.sources.tables import FEATURE_SCHEMA

ROUNDED = ["edge_density", "avg_degree", "degree_variance", "avg_clustering", "spectral_gap"]


def max_matching(packed: DataFrame) -> DataFrame:
    """Exact up to 16 vertices, matrix rank beyond."""
    return dense.max_matching(packed, topology.SMALL_MATCHING)


def shaped(packed: DataFrame, extra: Sequence[str] = (), features: Registry = FEATURES) -> DataFrame:
    """Shape columns, those in `extra` and the matching of connected graphs."""
    features = with_walks(features)
    more = [c for c in extra if c not in SHAPE]
    late = [c for c in more if features.order([c])[-1].whole]  # beside the matching, on connected graphs only
    early = [c for c in more if c not in late]
    matched = max_matching(features.columns(packed, [*SHAPE, *early]).where("is_connected = 1"))
    return features.columns(matched, late) if late else matched


def feature_table(lines: DataFrame, existing: DataFrame | None = None, with_gap: bool = True,
                  extra: Sequence[str] = (), features: Registry = FEATURES) -> DataFrame:
    """The 15-column feature table of the connected graphs in `lines (g6)`, and the
    registered features named in `extra` after them.

    Copies of a text are one graph. Graphs already in `existing` are dropped before
    anything is computed. After the one shuffle that merges copies all work is
    narrow: walks, matchings and the spectral gap on stacked graphs in Arrow batches, the
    rest as expressions."""
    graphs = g6.distinct_packed(lines).drop("copies")
    if existing is not None:
        graphs = prep.unlabelled(graphs, existing)
    columns = [f.name for f in FEATURE_SCHEMA if with_gap or f.name != "spectral_gap"]
    more = [c for c in extra if c not in columns]
    gap = ["spectral_gap"] if with_gap else []
    out = shaped(graphs, [*gap, *more], features).withColumn("n_vertices", F.col("n"))
    return out.select(*[F.round(c, 6).alias(c) if c in ROUNDED else F.col(c) for c in [*columns, *more]])


def line_outcomes(lines: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """What becomes of the lines: `(outcome, copies)`, a row per outcome and text.
    Of equal connected texts one is `parsed` and the others are `duplicate`."""
    bad = g6.checked(lines).where("fault is not null").groupBy("fault").agg(F.count("*").alias("copies"))
    bad = bad.select(F.lit("parse_error").alias("outcome"), "copies")
    good = g6.distinct_packed(lines)
    if existing is not None:
        seen = existing.select("graph_id", F.lit(1).alias("__seen")).distinct()
        good = good.join(seen, "graph_id", "left")
    else:
        good = good.withColumn("__seen", F.lit(None).cast("int"))
    good = topology.with_components(good)
    parts = F.expr(
        """case when is_connected = 0 then array(named_struct('outcome', 'disconnected', 'copies', copies))
                when __seen = 1 then array(named_struct('outcome', 'duplicate', 'copies', copies))
                else array(named_struct('outcome', 'parsed', 'copies', 1L),
                           named_struct('outcome', 'duplicate', 'copies', copies - 1)) end""")
    return bad.unionByName(good.select(F.explode(parts).alias("p")).select("p.outcome", "p.copies"))


def counted_graphs(lines: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(the distinct connected graphs that are new, as a table, and what became of the
    lines). The lines are read once: those that can't be read are one group without a
    key. The counters come from the tables written."""
    text = g6.checked(lines).withColumn("g6", F.when(F.col("fault").isNull(), F.col("g6"))).withColumn("graph_id", graph_key("g6"))
    merged = written(pack_text(text).groupBy("graph_id", "tri").agg(F.max("n").alias("n"), F.count("*").alias("copies")), "distinct-graphs")
    read = counted_in(merged, F.sum("copies").alias("lines"), F.sum(F.when(F.col("graph_id").isNull(), F.col("copies"))).alias("parse_error"))
    merged = merged.where("graph_id is not null")
    if existing is not None:
        merged = merged.join(existing.select("graph_id", F.lit(1).alias("__seen")).distinct(), "graph_id", "left")
    else:
        merged = merged.withColumn("__seen", F.lit(None).cast("int"))
    new = F.col("__seen").isNull()
    shown = written(topology.with_components(merged), "judged-graphs")
    judged = counted_in(
        shown, F.sum(F.when(F.col("is_connected") == 0, F.col("copies"))).alias("disconnected"),
        F.count_if((F.col("is_connected") == 1) & new).alias("parsed"),
        F.sum(F.when(F.col("is_connected") == 1, F.col("copies") - new.cast("int"))).alias("duplicate"))
    return shown.where("is_connected = 1 and __seen is null").drop("__seen"), read | judged


def gated(packed: DataFrame, gates: Mapping[str, int], features: Registry = FEATURES) -> DataFrame:
    """`(graph_id, n)` and the registered features named in `gates`, each for graphs up
    to its number of vertices and NULL beyond: one row per graph. The gates come before
    the steps; features with one gate are computed together."""
    out = packed.select("graph_id", "n")
    for most in sorted(set(gates.values())):
        names = [c for c, gate in gates.items() if gate == most]
        some = features.columns(packed.where(F.col("n") <= most), names).select("graph_id", *names)
        out = out.join(some, "graph_id", "left")
    return out.select("graph_id", "n", *gates)


def gated_enrichment(packed: DataFrame, spectral_max: int, pauli_max: int) -> DataFrame:
    """Spectral and Pauli columns within their size gates."""
    return gated(packed, dict.fromkeys(SPECTRA, spectral_max) | dict.fromkeys(PAULI, pauli_max))
