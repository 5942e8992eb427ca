"""Queries over the derived graph collections: features of each graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog.registry import query
from graphloom.catalog.sqltext import BOTH, GD, GS, GW, degrees, directed, distances
from graphloom.functions.scalars import bit_text, hamming_text
from graphloom.operators import dense, hamming, matching, pauli, refinement, spectral, topology
from graphloom.operators.packed import pack_edges, unpack_edges, with_adjacency
from graphloom.session import spread
from graphloom.sources import fixtures as fx


def dense_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_edges(fx.part_links(spark, sf_dir), n=8)


def sparse_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_edges(fx.order_links(spark, sf_dir), n=8)


def wide_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_edges(fx.supplier_links(spark, sf_dir), n=128)


def all_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.part_links(spark, sf_dir).withColumn("graph_id", F.col("graph_id") * 2)
    s = fx.order_links(spark, sf_dir).withColumn("graph_id", F.col("graph_id") * 2 + 1)
    return pack_edges(d.union(s), n=8)


def _r(c: str):
    return F.round(c, 6).alias(c)


@query("f01_size_and_density", f"""with {BOTH}
select graph_id, cast(8 as int) as n, count(*) as m, round(2.0::double * count(*) / 56, 6) as edge_density from gb group by graph_id""")
def size_and_density(spark, sf_dir):
    df = topology.with_degrees(all_small(spark, sf_dir))
    return df.select("graph_id", "n", "m", _r("edge_density"))


_DEG_SQL = """select graph_id, cast(max(d) as int) as max_degree, cast(min(d) as int) as min_degree,
  round(avg(d), 6) as avg_degree, round((count(*) * sum(d * d) - sum(d) * sum(d)) / cast(count(*) * count(*) as double), 6) as degree_variance,
  cast(max(d) = min(d) as int) as is_regular from deg group by graph_id"""


@query("f02_degrees", f"with {BOTH}, {degrees('gb', 8)} {_DEG_SQL}")
def degree_query(spark, sf_dir):
    df = topology.with_degrees(all_small(spark, sf_dir))
    return df.select("graph_id", "max_degree", "min_degree", _r("avg_degree"), _r("degree_variance"), "is_regular")


@query("f02_degrees_wide", f"with {GW}, {degrees('gw', 128)} {_DEG_SQL}")
def degree_query_wide(spark, sf_dir):
    df = topology.with_degrees(wide_graphs(spark, sf_dir))
    return df.select("graph_id", "max_degree", "min_degree", _r("avg_degree"), _r("degree_variance"), "is_regular")


@query("f02_degrees_by_grouping", f"with {GS}, {degrees('gs', 8)} {_DEG_SQL}")
def degree_query_grouped(spark, sf_dir):
    edges = fx.order_edges(spark, sf_dir)
    graphs = edges.select("graph_id").distinct().withColumn("n", F.lit(8))
    d = F.col("d")
    return topology.degrees_by_grouping(edges, graphs).groupBy("graph_id").agg(
        F.max(d).cast("int").alias("max_degree"),
        F.min(d).cast("int").alias("min_degree"),
        F.round(F.avg(d), 6).alias("avg_degree"),
        F.round((F.count(d) * F.sum(d * d) - F.sum(d) * F.sum(d)) / (F.count(d) * F.count(d)), 6).alias("degree_variance"),
        (F.max(d) == F.min(d)).cast("int").alias("is_regular"),
    )




@query("f03_bipartite", f"""with recursive {BOTH}, {directed('gb')},
 cover as (select graph_id, i as s, i as t, 0 as par from (select distinct graph_id from gb) g cross join range(8) r(i)
   union select c.graph_id, c.s, e.t, 1 - c.par from cover c join dir e on e.graph_id = c.graph_id and e.s = c.t)
select graph_id, cast(max(case when s = t and par = 1 then 1 else 0 end) = 0 as int) as is_bipartite from cover group by graph_id""")
def bipartite(spark, sf_dir):
    return topology.with_components(all_small(spark, sf_dir)).select("graph_id", "is_bipartite")


@query("f03_bipartite_wide", f"""with recursive {GW}, {directed('gw')},
 parity as (select graph_id, i as s, i as t, 0 as par from (select distinct graph_id from gw) g cross join range(128) r(i)
   union select c.graph_id, c.s, e.t, 1 - c.par from parity c join dir e on e.graph_id = c.graph_id and e.s = c.t)
select graph_id, cast(max(case when s = t and par = 1 then 1 else 0 end) = 0 as int) as is_bipartite from parity group by graph_id""")
def bipartite_wide(spark, sf_dir):
    return topology.with_components(wide_graphs(spark, sf_dir)).select("graph_id", "is_bipartite")


@query("f04_connected", f"""with recursive {BOTH}, {directed('gb')},
 reach as (select graph_id, i as s, i as t from (select distinct graph_id from gb) g cross join range(8) r(i)
   union select r.graph_id, r.s, e.t from reach r join dir e on e.graph_id = r.graph_id and e.s = r.t),
 low as (select graph_id, t, min(s) as label from reach group by graph_id, t)
select graph_id, cast(count(distinct label) as int) as n_components, cast(count(distinct label) = 1 as int) as is_connected
from low group by graph_id""")
def connected(spark, sf_dir):
    return topology.with_components(all_small(spark, sf_dir)).select("graph_id", "n_components", "is_connected")


@query("f05_diameter", f"""with recursive {BOTH}, {directed('gb')}, {distances('gb', 8)}
select graph_id, cast(case when count(*) = 64 then max(d) end as int) as diameter from dist group by graph_id""")
def diameter(spark, sf_dir):
    return topology.with_diameter(all_small(spark, sf_dir)).select("graph_id", "diameter")


_REACH_WIDE = f"""{directed('gw')}, reach as (select graph_id, 0 as t from (select distinct graph_id from gw) g
   union select r.graph_id, e.t from reach r join dir e on e.graph_id = r.graph_id and e.s = r.t)"""


@query("f04_connected_wide", f"""with recursive {GW}, {_REACH_WIDE}
select graph_id, cast(count(*) = 128 as int) as is_connected from reach group by graph_id""")
def connected_wide(spark, sf_dir):
    return topology.with_components(wide_graphs(spark, sf_dir)).select("graph_id", "is_connected")


@query("f05_diameter_wide")
def diameter_wide(spark, sf_dir):
    return topology.with_diameter(wide_graphs(spark, sf_dir)).select("graph_id", "diameter")


@query("f06_trees_and_cycles", f"""with recursive {BOTH}, {directed('gb')},
 reach as (select graph_id, 0 as t from (select distinct graph_id from gb) g
   union select r.graph_id, e.t from reach r join dir e on e.graph_id = r.graph_id and e.s = r.t),
 con as (select graph_id, count(*) = 8 as c from reach group by graph_id),
 size as (select graph_id, count(*) as m from gb group by graph_id)
select graph_id, cast(m = 7 and c as int) as is_tree, case when c then m - 7 end as cycle_count from size join con using (graph_id)""")
def trees_and_cycles(spark, sf_dir):
    return topology.with_components(all_small(spark, sf_dir)).select("graph_id", "is_tree", "cycle_count")


def _triangles(edges: str) -> str:
    return f"""tri as (select a.graph_id, a.u as x, a.v as y, b.v as z from {edges} a join {edges} b
   on a.graph_id = b.graph_id and a.u = b.u and a.v < b.v
   join {edges} c on c.graph_id = a.graph_id and c.u = a.v and c.v = b.v)"""


@query("f07_triangles", f"""with {BOTH}, {_triangles('gb')}
select g.graph_id, count(t.x) as triangle_count from (select distinct graph_id from gb) g left join tri t using (graph_id) group by g.graph_id""")
def triangles(spark, sf_dir):
    return topology.with_triangles(all_small(spark, sf_dir)).select("graph_id", "triangle_count")


@query("f07_triangles_wide", f"""with {GW}, {_triangles('gw')}
select g.graph_id, count(t.x) as triangle_count from (select distinct graph_id from gw) g left join tri t using (graph_id) group by g.graph_id""")
def triangles_wide(spark, sf_dir):
    return topology.with_triangles(wide_graphs(spark, sf_dir)).select("graph_id", "triangle_count")


@query("j10_triangles_by_joins", f"with {GD}, {_triangles('gd')} select graph_id, count(*) as triangle_count from tri group by graph_id")
def triangles_joined(spark, sf_dir):
    return topology.triangles_by_joins(fx.part_edges(spark, sf_dir))


def _clustering(edges: str, n: int) -> str:
    return f"""{degrees(edges, n)}, {_triangles(edges)},
 corner as (select graph_id, vertex, count(*) as t from (select graph_id, x as vertex from tri union all select graph_id, y from tri
   union all select graph_id, z from tri) a group by 1, 2)
select d.graph_id, round(avg(case when d.d < 2 then 0.0::double else 2.0::double * coalesce(a.t, 0) / (d.d * (d.d - 1)) end), 6) as avg_clustering
from deg d left join corner a on a.graph_id = d.graph_id and a.vertex = d.vertex group by d.graph_id"""


@query("f08_clustering", f"with {BOTH}, {_clustering('gb', 8)}")
def clustering(spark, sf_dir):
    return topology.with_triangles(all_small(spark, sf_dir)).select("graph_id", _r("avg_clustering"))


@query("f09_clique_number", f"""with recursive {GD}, clique as (
   select graph_id, v as last, (1 << cast(u as int)) | (1 << cast(v as int)) as mask, 2 as k from gd
   union all select c.graph_id, e.v, c.mask | (1 << cast(e.v as int)), c.k + 1 from clique c
   join gd e on e.graph_id = c.graph_id and e.u = c.last
   where (select count(*) from gd f where f.graph_id = c.graph_id and f.v = e.v and (c.mask & (1 << cast(f.u as int))) <> 0) = c.k)
select graph_id, cast(max(k) as int) as clique_number from clique group by graph_id""")
def clique_number(spark, sf_dir):
    return topology.with_clique(dense_graphs(spark, sf_dir)).select("graph_id", "clique_number")


@query("f08_clustering_wide", f"with {GW}, {_clustering('gw', 128)}")
def clustering_wide(spark, sf_dir):
    return topology.with_triangles(wide_graphs(spark, sf_dir)).select("graph_id", _r("avg_clustering"))


@query("f09_clique_number_wide", f"""with recursive {GW}, clique as (
   select graph_id, v as last, [u, v] as members, 2 as k from gw
   union all select c.graph_id, e.v, list_append(c.members, e.v), c.k + 1 from clique c
   join gw e on e.graph_id = c.graph_id and e.u = c.last
   where (select count(*) from gw f where f.graph_id = c.graph_id and f.v = e.v and list_contains(c.members, f.u)) = c.k)
select graph_id, cast(max(k) as int) as clique_number from clique group by graph_id""")
def clique_number_wide(spark, sf_dir):
    return topology.with_clique(wide_graphs(spark, sf_dir)).select("graph_id", "clique_number")


def _matching(edges: str) -> str:
    return f"""cover as (select distinct graph_id, 0 as mask, 0 as k from {edges}
   union select c.graph_id, c.mask | (1 << cast(e.u as int)) | (1 << cast(e.v as int)), c.k + 1 from cover c
   join {edges} e on e.graph_id = c.graph_id
   where (c.mask & ((1 << cast(e.u as int)) | (1 << cast(e.v as int)))) = 0)
select graph_id, cast(max(k) as int) as max_matching_size from cover group by graph_id"""


@query("f10_matching_exact", f"with recursive {BOTH}, {_matching('gb')}")
def matching_exact(spark, sf_dir):
    return dense.max_matching(spread(all_small(spark, sf_dir), "graph_id"), topology.SMALL_MATCHING).select("graph_id", "max_matching_size")


@query("f10_matching_by_rank", f"with recursive {GS}, {_matching('gs')}")
def matching_by_rank(spark, sf_dir):
    return dense.large_matching(sparse_graphs(spark, sf_dir)).select("graph_id", "max_matching_size")


_BARRIER = f"""cover as (select distinct graph_id, 0 as mask, 0 as k from gb
   union select c.graph_id, c.mask | (1 << cast(e.u as int)) | (1 << cast(e.v as int)), c.k + 1 from cover c join gb e on e.graph_id = c.graph_id
   where (c.mask & ((1 << cast(e.u as int)) | (1 << cast(e.v as int)))) = 0),
 nu as materialized (select graph_id, max(k) as k from cover group by 1),
 vert as materialized (select nu.graph_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) as v from nu),
 missed as materialized (select distinct p.graph_id, p.v from vert p join nu on nu.graph_id = p.graph_id join cover c on c.graph_id = p.graph_id and c.k = nu.k where (c.mask & (1 << p.v)) = 0),
 near as materialized (select distinct d.graph_id, d.t as v from dir d join missed m on m.graph_id = d.graph_id and m.v = d.s),
 bar as materialized (select graph_id, v from near except select graph_id, v from missed),
 kept as materialized (select graph_id, v from vert except select graph_id, v from bar),
 inner_links as materialized (select d.graph_id, d.s, d.t from dir d join kept a on a.graph_id = d.graph_id and a.v = d.s join kept b on b.graph_id = d.graph_id and b.v = d.t),
 reach as (select graph_id, v as s, v as t from kept union select r.graph_id, r.s, e.t from reach r join inner_links e on e.graph_id = r.graph_id and e.s = r.t),
 low as (select graph_id, t, min(s) as part from reach group by 1, 2),
 parts as (select graph_id, part, count(*) as n from low group by 1, 2),
 odd as (select graph_id, count(*) filter (where n % 2 = 1) as n from parts group by 1),
 bars as (select graph_id, count(*) as n from bar group by 1)"""


@query("f10_matching_certificate", f"""with recursive {BOTH}, {directed('gb')}, {_BARRIER}
select graph_id, cast(nu.k as int) as max_matching_size, cast(coalesce(bars.n, 0) as int) as n_barrier, cast(coalesce(odd.n, 0) as int) as odd_parts,
  cast((8 + coalesce(bars.n, 0) - coalesce(odd.n, 0)) // 2 as int) as matching_bound, cast(1 as int) as certified
from nu left join bars using (graph_id) left join odd using (graph_id)""")
def matching_certificate(spark, sf_dir):
    out = matching.certified(all_small(spark, sf_dir))
    return out.select("graph_id", "max_matching_size", F.size("barrier").alias("n_barrier"), "odd_parts", "matching_bound", "certified")


@query("f10_matching_certificate_wide", f"with {GW} select distinct graph_id, cast(128 as int) as n, cast(1 as int) as certified from gw")
def matching_certificate_wide(spark, sf_dir):
    return matching.certified(wide_graphs(spark, sf_dir)).select("graph_id", "n", "certified")


@query("f11_chromatic_index_bound", f"""with {BOTH}, {degrees('gb', 8)}
select graph_id, cast(max(d) as int) as chromatic_index_lower_bound from deg group by graph_id""")
def chromatic_bound(spark, sf_dir):
    return topology.with_degrees(all_small(spark, sf_dir)).select("graph_id", "chromatic_index_lower_bound")


@query("f12_spectral_gap")
def spectral_gap(spark, sf_dir):
    df = spectral.gap_column(dense.spectra(all_small(spark, sf_dir), ("lap",)))
    return df.select("graph_id", _r("spectral_gap"))


@query("f13_spectrum_moments", f"""with {BOTH}, {degrees('gb', 8)}, {_triangles('gb')},
 d as (select graph_id, sum(d) as s1, sum(d * d) as s2 from deg group by graph_id),
 t as (select graph_id, count(*) as t from tri group by graph_id)
select d.graph_id, round(s1::double, 6) as lap_sum, round((s2 + s1)::double, 6) as lap_squares, round(s1::double, 6) as adj_squares,
  round((6 * coalesce(t, 0))::double, 6) as adj_cubes, round(s1 / 8.0::double, 6) as spec_lap_mean,
  round(s1 / 8.0::double, 6) as spec_lap_energy_norm
from d left join t using (graph_id)""")
def spectrum_moments(spark, sf_dir):
    df = dense.spectra(all_small(spark, sf_dir)).withColumns(spectral.basic_columns())

    def power(a, k):
        # Rounded first to well below the precision of the eigenvalues, so that -0 cannot appear.
        return F.round(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.pow(x, F.lit(k))) + F.lit(0.0), 6)

    return df.select(
        "graph_id", power("lap", 1).alias("lap_sum"), power("lap", 2).alias("lap_squares"),
        power("adj", 2).alias("adj_squares"), power("adj", 3).alias("adj_cubes"),
        _r("spec_lap_mean"), _r("spec_lap_energy_norm"),
    )


@query("f13_basic_spectrum")
def basic_spectrum(spark, sf_dir):
    df = dense.spectra(dense_graphs(spark, sf_dir))
    return df.select("graph_id", *[F.round(c, 6).alias(k) for k, c in spectral.basic_columns().items()])


@query("f13_basic_spectrum_wide")
def basic_spectrum_wide(spark, sf_dir):
    df = dense.spectra(wide_graphs(spark, sf_dir))
    return df.select("graph_id", *[F.round(c, 6).alias(k) for k, c in spectral.basic_columns().items()])


@query("f14_full_spectrum")
def full_spectrum(spark, sf_dir):
    wide = spectral.full_columns(dense.spectra(dense_graphs(spark, sf_dir)), 8)
    return wide.select("graph_id", *[F.round(c, 6).alias(c) for c in wide.columns if c != "graph_id"])


@query("f15_f16_rich_spectrum")
def rich_spectrum(spark, sf_dir):
    df = dense.spectra(sparse_graphs(spark, sf_dir))
    return df.select("graph_id", *[F.round(c, 6).alias(k) for k, c in spectral.rich_columns().items()])


def _pauli(edges: str, n: int) -> str:
    return f"""{directed(edges)}, coef as (select graph_id, xor(s, t) as x, z.z, sum(1 - 2 * (bit_count(s & z.z) % 2)) as c
   from dir cross join range({n}) z(z) group by graph_id, xor(s, t), z.z having sum(1 - 2 * (bit_count(s & z.z) % 2)) <> 0),
 w as (select graph_id, cast(bit_count(x | z) as bigint) as w from coef)
select graph_id, cast(count(*) as double) as pauli_num_terms, round(cast(sum(w) as double) / count(*), 6) as pauli_wt_mean,
  cast(max(w) as double) as pauli_wt_max,
  round(sqrt(cast(count(*) * sum(w * w) - sum(w) * sum(w) as double)) / count(*), 6) as pauli_wt_std from w group by graph_id"""


def _pauli_out(df):
    return df.select("graph_id", "pauli_num_terms", _r("pauli_wt_mean"), "pauli_wt_max", _r("pauli_wt_std"))


@query("f17_f18_pauli_terms", f"with {BOTH}, {_pauli('gb', 8)}")
def pauli_terms(spark, sf_dir):
    return _pauli_out(pauli.pauli_columns(all_small(spark, sf_dir)))


@query("f17_f18_pauli_terms_wide", f"with {GW}, {_pauli('gw', 128)}")
def pauli_terms_wide(spark, sf_dir):
    return _pauli_out(pauli.pauli_columns(wide_graphs(spark, sf_dir)))


@query("f19_pauli_match_counts", f"""with {GD}, {directed('gd')}, coef as (select graph_id, xor(s, t) as x, z.z, sum(1 - 2 * (bit_count(s & z.z) % 2)) as c
   from dir cross join range(8) z(z) group by graph_id, xor(s, t), z.z having sum(1 - 2 * (bit_count(s & z.z) % 2)) <> 0),
 p as (select graph_id, count(*) as p from coef group by graph_id),
 k as (select graph_id, count(distinct xor(u, v)) as k from gd group by graph_id)
select graph_id, round(cast(p as double) / greatest(k, 1), 6) as pauli_match_ratio, cast(p - k as double) as pauli_match_diff from p join k using (graph_id)""")
def pauli_match(spark, sf_dir):
    df = pauli.mask_columns(pauli.pauli_columns(dense_graphs(spark, sf_dir)))
    df = pauli.count_columns(df, matchings="n_masks")
    return df.select("graph_id", _r("pauli_match_ratio"), "pauli_match_diff")


@query("f19b_xor_masks", f"""with {BOTH}, k as (select graph_id, xor(u, v) as x, count(*) as c from gb group by 1, 2)
select graph_id, cast(count(*) as int) as n_masks, cast(max(c) as int) as largest_mask from k group by graph_id""")
def xor_masks(spark, sf_dir):
    return pauli.mask_columns(all_small(spark, sf_dir)).select("graph_id", "n_masks", "largest_mask")


@query("f19b_links_per_mask", f"with {GD} select graph_id, cast(xor(u, v) as int) as mask, count(*) as n_links from gd group by 1, 2")
def links_per_mask(spark, sf_dir):
    return pauli.masks_by_grouping(fx.part_edges(spark, sf_dir))


def _colours(edges: str) -> str:
    rounds = [f"{degrees(edges, 8)}, {directed(edges)}, c0 as materialized (select graph_id, vertex, cast(d as varchar) as c from deg)"]
    for r in range(1, 4):
        rounds.append(f"""c{r} as materialized (select o.graph_id, o.vertex, md5(o.c || ':' || coalesce(a.s, '')) as c from c{r - 1} o left join (
   select e.graph_id, e.s as vertex, string_agg(x.c, ',' order by x.c) as s from dir e join c{r - 1} x on x.graph_id = e.graph_id and x.vertex = e.t
   group by 1, 2) a on a.graph_id = o.graph_id and a.vertex = o.vertex)""")
    for r in range(4):
        rounds.append(f"k{r} as (select graph_id, string_agg(c, ',' order by c) as s, count(distinct c) as n from c{r} group by graph_id)")
    return ", ".join(rounds)


@query("f20_wl_keys", f"""with {BOTH}, {_colours('gb')}
select graph_id, md5(k0.s || '|' || k1.s || '|' || k2.s || '|' || k3.s) as wl_key
from k0 join k1 using (graph_id) join k2 using (graph_id) join k3 using (graph_id)""")
def wl_keys(spark, sf_dir):
    return refinement.refine(all_small(spark, sf_dir)).select("graph_id", "wl_key")


@query("f21_hamming_distance", f"""with {GD} select graph_id, u, v, cast(bit_count(xor(u, v)) as int) as by_bits,
  cast(hamming(right('000' || cast(u as bit)::varchar, 3), right('000' || cast(v as bit)::varchar, 3)) as int) as by_text from gd""")
def hamming_distance(spark, sf_dir):
    return fx.part_edges(spark, sf_dir).select(
        "graph_id", F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"),
        F.bit_count(F.expr("u ^ v")).alias("by_bits"),
        hamming_text(bit_text("u", 3), bit_text("v", 3)).alias("by_text"),
    )


@query("f22_hamming_statistics", f"""with {GS}, g as (select distinct l_orderkey as graph_id from lineitem),
 h as (select graph_id, bit_count(xor(u, v)) as h from gs)
select g.graph_id, cast(coalesce(sum(h), 0) as bigint) as total_hamming, round(coalesce(avg(h), 0), 6) as avg_hamming,
  cast(coalesce(min(h), 0) as int) as min_hamming, cast(coalesce(max(h), 0) as int) as max_hamming,
  count(*) filter (where h = 1) as hamming_1_count, count(*) filter (where h > 1) as hamming_gt1_count
from g left join h using (graph_id) group by g.graph_id""")
def hamming_stats(spark, sf_dir):
    graphs = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph_id")).distinct()
    stats = hamming.hamming_statistics(fx.order_edges(spark, sf_dir), graphs)
    return stats.withColumn("avg_hamming", F.round("avg_hamming", 6))


@query("f23_colour_classes", f"""with {GD}, {_colours('gd')} select graph_id, cast(n as int) as n_colours from k3""")
def colour_classes(spark, sf_dir):
    return refinement.refine(dense_graphs(spark, sf_dir)).select("graph_id", "n_colours")


@query("s03_decode_edges", f"with {BOTH} select graph_id, cast(u as int) as u, cast(v as int) as v from gb")
def decode_edges(spark, sf_dir):
    return unpack_edges(all_small(spark, sf_dir))


@query("s03_decode_edges_wide", f"with {GW} select graph_id, cast(u as int) as u, cast(v as int) as v from gw")
def decode_edges_wide(spark, sf_dir):
    return unpack_edges(wide_graphs(spark, sf_dir))
