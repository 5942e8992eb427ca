"""Queries over graph text, tables at rest, the feature table and its increments."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.catalog.graphs import _pauli, _triangles, all_small, dense_graphs, sparse_graphs, wide_graphs
from graphloom.catalog.registry import query
from graphloom.catalog.sqltext import BOTH, DEC, FEAT, FEATURES, GD, GS, GW, degrees, directed, distances, text
from graphloom.functions import graph6
from graphloom.operators.packed import unpack_edges
from graphloom.plans import features
from graphloom.session import fresh_path, written
from graphloom.sources import fixtures as fx
from graphloom.sources import g6, tables
from graphloom.streaming import incremental

_BAD = """case when graph_id % 97 = 0 then 'G?' when graph_id % 89 = 0 then substr(g6, 1, 2) || ' ' || substr(g6, 4)
  when graph_id % 83 = 0 then '~~' || g6 else g6 end"""
LINES_SQL = f"{BOTH}, {text('gb', 8)}, lines as (select graph_id as seq, {_BAD} as g6 from txt)"
_FAULT = """case when regexp_matches(g6, '[^?-~]') then 'character' when g6 like '~~%' then 'header'
  when length(g6) <> 6 then 'length' end"""


def text_lines(spark, sf_dir):
    """Text of all small graphs, some lines spoilt, as a table of lines at rest."""
    t = all_small(spark, sf_dir).select("graph_id", graph6.to_text().alias("g6"))
    k = F.col("graph_id")
    spoilt = F.concat(F.substring("g6", 1, 2), F.lit(" "), F.expr("substring(g6, 4)"))
    return written(t.select(k.alias("seq"), F.when(k % 97 == 0, "G?").when(k % 89 == 0, spoilt)
                            .when(k % 83 == 0, F.concat(F.lit("~~"), "g6")).otherwise(F.col("g6")).alias("g6")), "lines")


@query("s01_read_text", f"with {LINES_SQL} select g6, count(*) as n_lines from lines group by g6")
def read_text(spark, sf_dir):
    path = fresh_path(spark, "lines")
    padded = F.when(F.col("seq") % 10 == 0, F.concat(F.lit("  "), "g6", F.lit(" \n"))).otherwise(F.col("g6"))
    text_lines(spark, sf_dir).select(padded.alias("value")).write.text(path)
    return g6.read_lines(spark, path).groupBy("g6").agg(F.count("*").alias("n_lines"))


@query("s02_vertex_count_from_header", f"""with {GD}, {GW}, {text('gd', 8, 'ta')}, {text('gw', 128, 'tw')}
select graph_id, length(g6) as n_chars, cast(case when g6[1] = '~' then (ascii(g6[2]) - 63) * 4096 + (ascii(g6[3]) - 63) * 64 + ascii(g6[4]) - 63 else ascii(g6[1]) - 63 end as int) as n
from (select * from ta union all select * from tw) t""")
def header_count(spark, sf_dir):
    both = dense_graphs(spark, sf_dir).unionByName(wide_graphs(spark, sf_dir))
    t = both.select("graph_id", graph6.to_text().alias("g6"))
    return t.select("graph_id", F.length("g6").cast("bigint").alias("n_chars"), graph6.vertex_count("g6").alias("n"))


@query("s03_decode_text", f"with {BOTH} select graph_id, cast(u as int) as u, cast(v as int) as v from gb")
def decode_text(spark, sf_dir):
    t = all_small(spark, sf_dir).select("graph_id", graph6.to_text().alias("g6"))
    return unpack_edges(graph6.pack_text(t))


@query("s03_decode_text_wide", f"with {GW} select graph_id, cast(u as int) as u, cast(v as int) as v from gw")
def decode_text_wide(spark, sf_dir):
    t = wide_graphs(spark, sf_dir).select("graph_id", graph6.to_text().alias("g6"))
    return unpack_edges(graph6.pack_text(t))


@query("s04_malformed_lines", f"with {LINES_SQL} select coalesce({_FAULT}, 'readable') as outcome, count(*) as n_lines from lines group by 1")
def malformed(spark, sf_dir):
    c = g6.checked(text_lines(spark, sf_dir))
    return c.groupBy(F.coalesce("fault", F.lit("readable")).alias("outcome")).agg(F.count("*").alias("n_lines"))


@query("s05_encode_text", f"with {BOTH}, {text('gb', 8)} select graph_id, g6 from txt")
def encode_text(spark, sf_dir):
    return all_small(spark, sf_dir).select("graph_id", graph6.to_text().alias("g6"))


@query("s05_encode_text_wide", f"with {GW}, {text('gw', 128)} select graph_id, g6 from txt")
def encode_text_wide(spark, sf_dir):
    return wide_graphs(spark, sf_dir).select("graph_id", graph6.to_text().alias("g6"))


@query("s06_graph_key", f"with {LINES_SQL} select distinct substr(sha1(g6), 1, 16) as graph_id, g6 from lines")
def graph_key(spark, sf_dir):
    return text_lines(spark, sf_dir).select("g6").distinct().select(graph6.graph_key("g6").alias("graph_id"), "g6")


@query("s07_read_table", f"with {FEAT} select graph_id, n_vertices, source_dataset, f_size, f_price, f_items, round(f_disc, 9) as f_disc, round(f_var, 9) as f_var, f_supp from feat")
def read_table(spark, sf_dir):
    path = fresh_path(spark, "features")
    df = fx.decision_features(spark, sf_dir)
    tables.write_csv(df, path, digits=12)
    out = tables.read_csv(spark, path, df.schema)
    return out.withColumn("f_disc", F.round("f_disc", 9)).withColumn("f_var", F.round("f_var", 9))


@query("s08_write_table", f"with {DEC} select n_vertices, count(*) as n_rows, cast(sum(delta_cx) as bigint) as delta_sum from dec group by 1")
def write_table(spark, sf_dir):
    path = fresh_path(spark, "labels")
    tables.write_table(fx.decisions(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("n_vertices").agg(F.count("*").alias("n_rows"), F.sum("delta_cx").alias("delta_sum"))


_CON = f"""{directed('gb')}, re as (select graph_id, 0 as t from (select distinct graph_id from gb) g
   union select r.graph_id, e.t from re r join dir e on e.graph_id = r.graph_id and e.s = r.t),
 con as (select graph_id, count(*) = 8 as c from re group by graph_id)"""
_COUNTED = f"""with recursive {LINES_SQL}, {_CON}, tx as (select l.g6, count(*) as copies, bool_or(con.c) as c, max({_FAULT}) as fault from lines l join con on con.graph_id = l.seq group by 1),
 oc as (select 'parse_error' as outcome, copies from tx where fault is not null union all select 'disconnected', copies from tx where fault is null and not c
  union all select 'parsed', 1 from tx where fault is null and c union all select 'duplicate', copies - 1 from tx where fault is null and c)"""


@query("s10_f25_manifest", f"{_COUNTED} select 'features' as stage, outcome as counter, cast(sum(copies) as bigint) as value from oc group by 2 union all select 'features', 'lines', count(*) from lines")
def manifest(spark, sf_dir):
    _, stats = features.counted_graphs(text_lines(spark, sf_dir))
    path = fresh_path(spark, "manifest")
    tables.write_manifest(tables.counted(spark, "features", stats), {"source": "line items"}, path)
    return tables.read_manifest(spark, path)


@query("f25_line_outcomes", f"{_COUNTED} select outcome, cast(sum(copies) as bigint) as n_lines from oc group by 1")
def line_outcomes(spark, sf_dir):
    return features.line_outcomes(text_lines(spark, sf_dir)).groupBy("outcome").agg(F.sum("copies").alias("n_lines"))


@query("s11_first_lines", f"with {LINES_SQL} select seq, g6 from lines order by g6, seq limit 50")
def first_lines(spark, sf_dir):
    return g6.first_lines(text_lines(spark, sf_dir), 50, ["g6", "seq"])


# One graph stands for all lines with its text.
_TABLE = f"""with recursive {LINES_SQL}, pick as (select min(l.seq) as graph_id, l.g6 from lines l where {_FAULT} is null group by l.g6),
 ge as (select gb.graph_id, gb.u, gb.v from gb join pick using (graph_id)), {directed('ge')}, {distances('ge', 8)}, {degrees('ge', 8)}, {_triangles('ge')},
 cover2 as (select graph_id, i as s, i as t, 0 as par from (select distinct graph_id from ge) g cross join range(8) r(i)
   union select c.graph_id, c.s, e.t, 1 - c.par from cover2 c join dir e on e.graph_id = c.graph_id and e.s = c.t),
 bip as (select graph_id, cast(max(case when s = t and par = 1 then 1 else 0 end) = 0 as int) as is_bipartite from cover2 group by 1),
 dia as (select graph_id, cast(max(d) as int) as diameter from dist group by 1 having count(*) = 64),
 dg as (select graph_id, cast(min(d) as int) as min_degree, cast(max(d) as int) as max_degree, avg(d) as avg_degree, var_pop(d) as degree_variance, sum(d) / 2 as m from deg group by 1),
 tc as (select graph_id, count(*) as triangle_count from tri group by 1),
 corner as (select graph_id, vertex, count(*) as t from (select graph_id, x as vertex from tri union all select graph_id, y from tri union all select graph_id, z from tri) a group by 1, 2),
 clu as (select d.graph_id, round(avg(case when d.d < 2 then 0.0::double else 2.0::double * coalesce(a.t, 0) / (d.d * (d.d - 1)) end), 6) as avg_clustering from deg d left join corner a on a.graph_id = d.graph_id and a.vertex = d.vertex group by 1),
 cover as (select distinct graph_id, 0 as mask, 0 as k from ge union select c.graph_id, c.mask | (1 << cast(e.u as int)) | (1 << cast(e.v as int)), c.k + 1 from cover c join ge e on e.graph_id = c.graph_id
   where (c.mask & ((1 << cast(e.u as int)) | (1 << cast(e.v as int)))) = 0),
 mat as (select graph_id, cast(max(k) as int) as max_matching_size from cover group by 1)
select substr(sha1(p.g6), 1, 16) as graph_id, cast(8 as int) as n_vertices, round(m / 28.0::double, 6) as edge_density, is_bipartite, cast(m = 7 as int) as is_tree, coalesce(triangle_count, 0) as triangle_count, diameter,
  min_degree, max_degree, round(avg_degree, 6) as avg_degree, round(degree_variance, 6) as degree_variance, cast(min_degree = max_degree as int) as is_regular, avg_clustering, max_matching_size
from pick p join dia using (graph_id) join bip using (graph_id) join dg using (graph_id) left join tc using (graph_id) join clu using (graph_id) join mat using (graph_id)"""


@query("f24_feature_table", _TABLE)
def feature_table(spark, sf_dir):
    return features.feature_table(text_lines(spark, sf_dir).select("g6"), with_gap=False)


@query("f24_feature_table_with_gap")
def feature_table_gap(spark, sf_dir):
    return features.feature_table(text_lines(spark, sf_dir).select("g6"))


@query("f24_feature_table_wide")
def feature_table_wide(spark, sf_dir):
    t = written(wide_graphs(spark, sf_dir).select(graph6.to_text().alias("g6")), "lines")
    return features.feature_table(t)


@query("f26_size_gates", f"""with {GD}, {GW}, pd as (with {_pauli('gd', 8)})
select graph_id, cast(8 as int) as n, pauli_num_terms, 1 as has_spectrum from pd union all select distinct graph_id + 10000000, cast(128 as int), null, 0 from gw""")
def size_gates(spark, sf_dir):
    w = wide_graphs(spark, sf_dir).withColumn("graph_id", F.col("graph_id") + 10000000)
    both = written(dense_graphs(spark, sf_dir).unionByName(w), "graphs")
    out = features.gated_enrichment(both, 64, 16)
    return out.select("graph_id", "n", "pauli_num_terms", F.col("spec_lap_max").isNotNull().cast("int").alias("has_spectrum"))


def _increment(spark, sf_dir):
    lines = text_lines(spark, sf_dir)
    return lines.where("seq % 3 = 0").select("g6"), lines.where("seq % 3 <> 0").select("g6"), lines.select("g6")


@query("i01_incremental_features", _TABLE)
def incremental_features(spark, sf_dir):
    first, second, everything = _increment(spark, sf_dir)
    path = fresh_path(spark, "table")
    for lines in (first, second, everything):  # the last one finds nothing new
        incremental.append_features(lines, path, with_gap=False)
    return incremental.existing_table(spark, path).drop("spectral_gap")


@query("i01_i02_streamed_features", _TABLE)
def streamed_features(spark, sf_dir):
    first, second, everything = _increment(spark, sf_dir)
    source, target, marks = (fresh_path(spark, n) for n in ("arrivals", "table", "marks"))
    for lines in (first, second, everything):
        lines.select(F.col("g6").alias("value")).write.mode("append").text(source)
        run = incremental.stream_features(spark, source, target, marks, with_gap=False)
        run.awaitTermination()
    return incremental.existing_table(spark, target).drop("spectral_gap")


@query("i02_once_per_key", f"with {GS}, {text('gs', 8)} select g6, min(graph_id) as first_seen, count(*) as copies from txt group by g6")
def once_per_key(spark, sf_dir):
    t = sparse_graphs(spark, sf_dir).select(F.col("graph_id").alias("first_seen"), graph6.to_text().alias("g6"))
    return g6.distinct_texts(t, "first_seen")


@query("i03_refresh", f"with {DEC} select graph_id, case when n_vertices <= 32 and coalesce(case when graph_id % 3 <> 0 then graph_id % 2 end, 1) <> 0 then f_var else 0 end as value, n_vertices <= 32 or coalesce(graph_id % 3 <> 0 and graph_id % 2 = 0, false) as stamp from dec")
def refresh(spark, sf_dir):
    k = F.col("graph_id")
    d = fx.decisions(spark, sf_dir)
    table = d.select("graph_id", "n_vertices", F.lit(0.0).alias("value"), F.when(k % 3 != 0, k % 2 == 0).alias("stamp"))
    variances = d.select("graph_id", F.col("f_var").alias("__v"))

    def computed(rows):
        return rows.select("graph_id").join(variances, "graph_id").select("graph_id", F.col("__v").alias("value"))

    return incremental.refresh(table, computed, "stamp", 32).select("graph_id", "value", "stamp")
