"""Queries that draw graphs from the keys of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog.graphs import sparse_graphs
from graphloom.catalog.registry import query
from graphloom.catalog.sqltext import GS, directed
from graphloom.functions.scalars import is_power_of_two
from graphloom.operators import generate, refinement, topology
from graphloom.operators.packed import unpack_edges
from graphloom.session import fresh_path, spread, written
from graphloom.sources import fixtures as fx
from graphloom.sources import tables


def _draw(seed: str, graph: str, place: str) -> str:
    t = f"((({seed}) * 104729 + (({graph}) % 1000003) * 7919 + ({place}) * 1299709 + 12345) % 1000003)"
    a = f"(({t} * {t} + 12345 * {t} + 7) % 1000003)"
    return f"(({a} * {a} + 54321 * {a} + 11) % 1000003)"


# --- random graphs, one attempt per part --------------------------------------

_ER = f"""at as materialized (select p_partkey as seq, cast(case when p_partkey % 2 = 0 then 8 else 16 end as bigint) as n, 1 + p_partkey % 4 as tenths from part),
 er as materialized (select seq as graph_id, u.i as u, v.i as v from (select *, cast(100 + floor(tenths / 10.0::double * 1000) + n as bigint) as seed from at) a join range(16) v(i) on v.i < a.n join range(16) u(i) on u.i < v.i
   where {_draw('seed', 'seq', 'v.i * (v.i - 1) // 2 + u.i')} < tenths / 10.0::double * 1000003)""".replace(
    "at as materialized", "att as materialized").replace("from at)", "from att)")


def _er_attempts(spark, sf_dir):
    k = F.col("p_partkey")
    a = fx.table(spark, sf_dir, "part").select(
        k.alias("seq"), F.when(k % 2 == 0, 8).otherwise(16).alias("n"), (k % 4 + 1).alias("tenths"))
    a = a.withColumn("p", F.col("tenths") / F.lit(10.0)).withColumn("seed", generate.cell_seed(F.lit(100), F.col("n"), F.col("p")))
    want = a.groupBy("n", "tenths").agg(F.expr("count(*) div 4").alias("want"))
    return spread(a.join(want, ["n", "tenths"]), "seq").withColumn("tri", generate.random_graph(graph="seq")).drop("p", "seed")


@query("g01_random_links", f"with {_ER} select graph_id, cast(u as int) as u, cast(v as int) as v from er")
def random_links(spark, sf_dir):
    return unpack_edges(_er_attempts(spark, sf_dir).withColumnRenamed("seq", "graph_id"))


def _judge(edges: str, attempts: str) -> str:
    """Connectivity and refinement keys of graphs of mixed size: `keys (graph_id, k)`, `con (graph_id)`."""
    out = [f"""{directed(edges)}, re as (select seq as graph_id, 0::bigint as t from {attempts}
   union select r.graph_id, e.t from re r join dir e on e.graph_id = r.graph_id and e.s = r.t),
 con as (select graph_id from re join {attempts} on seq = graph_id group by graph_id, n having count(*) = n),
 c0 as materialized (select a.seq as graph_id, r.i as vertex, cast(count(d.t) as varchar) as c from {attempts} a join range(16) r(i) on r.i < a.n left join dir d on d.graph_id = a.seq and d.s = r.i group by 1, 2)"""]
    for r in range(1, 4):
        out.append(f"""c{r} as materialized (select o.graph_id, o.vertex, md5(o.c || ':' || coalesce(a.s, '')) as c from c{r - 1} o left join (
   select e.graph_id, e.s as vertex, string_agg(x.c, ',' order by x.c) as s from dir e join c{r - 1} x on x.graph_id = e.graph_id and x.vertex = e.t group by 1, 2) a
   on a.graph_id = o.graph_id and a.vertex = o.vertex)""")
    for r in range(4):
        out.append(f"k{r} as (select graph_id, string_agg(c, ',' order by c) as s from c{r} group by graph_id)")
    out.append("keys as (select graph_id, md5(k0.s || '|' || k1.s || '|' || k2.s || '|' || k3.s) as k from k0 join k1 using (graph_id) join k2 using (graph_id) join k3 using (graph_id))")
    return ", ".join(out)


_ER_OUT = f"""with recursive {_ER}, {_judge('er', 'att')}, wa as (select n, tenths, count(*) // 4 as want from att group by 1, 2),
 st as (select a.*, k.k, case when not exists (select 1 from er where er.graph_id = a.seq) then 'empty' when c.graph_id is null then 'disconnected' end as o from att a left join con c on c.graph_id = a.seq left join keys k on k.graph_id = a.seq),
 fi as (select n, tenths, k, min(seq) as seq from st where o is null group by 1, 2, 3),
 rk as (select *, row_number() over (partition by n, tenths order by seq) as rank from fi),
 ta as (select rk.*, want from rk join wa using (n, tenths) where rank <= want),
 la as (select n, tenths, max(case when rank = want then seq end) as last from ta group by 1, 2)"""


@query("g01_g06_g07_random_graphs", f"{_ER_OUT} select cast(n as int) as n, tenths, seq from ta")
def random_graphs(spark, sf_dir):
    kept, _ = generate.accept(_er_attempts(spark, sf_dir), ["n", "tenths"], "seq", "want")
    return kept.select("n", "tenths", "seq")


@query("g09_run_counters", f"""{_ER_OUT} select cast(st.n as int) as n, st.tenths, coalesce(o, case when ta.seq is not null then 'generated' else 'duplicate' end) as outcome, count(*) as n_graphs
from st left join la on la.n = st.n and la.tenths = st.tenths left join ta on ta.seq = st.seq where la.last is null or st.seq <= la.last group by 1, 2, 3""")
def run_counters(spark, sf_dir):
    _, counters = generate.accept(_er_attempts(spark, sf_dir), ["n", "tenths"], "seq", "want")
    return counters


# A second run against a file that holds every third of the first run's graphs.
_AGAIN = _ER_OUT.replace(" fi as (", """ ex as (select distinct st.n, st.k from st where st.o is null and st.seq % 3 = 0),
 fi as (""").replace("from st where o is null group by", "from st where o is null and not exists (select 1 from ex where ex.n = st.n and ex.k = st.k) group by")


def _accepted_again(spark, sf_dir):
    attempts = written(generate.judged(_er_attempts(spark, sf_dir)), "attempts")
    existing = attempts.where("seq % 3 = 0 and outcome is null").select("n", "wl_key").distinct()
    return generate.accept(attempts, ["n", "tenths"], "seq", "want", existing=written(existing, "existing"))


@query("g08_kept_beside_existing", f"{_AGAIN} select cast(n as int) as n, tenths, seq from ta")
def kept_beside_existing(spark, sf_dir):
    return _accepted_again(spark, sf_dir)[0].select("n", "tenths", "seq")


@query("g09_counters_beside_existing", f"""{_AGAIN} select cast(st.n as int) as n, st.tenths, coalesce(o, case when ta.seq is not null then 'generated' else 'duplicate' end) as outcome, count(*) as n_graphs
from st left join la on la.n = st.n and la.tenths = st.tenths left join ta on ta.seq = st.seq where la.last is null or st.seq <= la.last group by 1, 2, 3""")
def counters_beside_existing(spark, sf_dir):
    return _accepted_again(spark, sf_dir)[1]


@query("s10_g09_generation_manifest", f"""{_ER_OUT}, oc as (select coalesce(o, case when ta.seq is not null then 'generated' else 'duplicate' end) as counter
 from st left join la on la.n = st.n and la.tenths = st.tenths left join ta on ta.seq = st.seq where la.last is null or st.seq <= la.last)
select 'generation' as stage, counter, count(*) as value from (select counter from oc union all select 'attempts' from oc) t group by 2""")
def generation_manifest(spark, sf_dir):
    _, stats = generate.attempts(_er_attempts(spark, sf_dir), ["n", "tenths"], "seq", "want")
    path = fresh_path(spark, "manifest")
    tables.write_manifest(tables.counted(spark, "generation", stats), {"cells": "n, tenths"}, path)
    return tables.read_manifest(spark, path).where("value > 0")


@query("g09_short_runs", f"""{_ER_OUT} select cast(wa.n as int) as n, wa.tenths, want, count(ta.seq) as n_graphs from wa left join ta using (n, tenths, want) group by 1, 2, 3 having count(ta.seq) < want""")
def short_runs(spark, sf_dir):
    a = _er_attempts(spark, sf_dir)
    _, counters = generate.accept(a, ["n", "tenths"], "seq", "want")
    wanted = a.select("n", "tenths", "want").distinct()
    return generate.short_runs(counters, wanted, ["n", "tenths"], "want")


# --- structured paths, one per part -------------------------------------------

_PP = "pp as (select p_partkey as graph_id, cast(case p_partkey % 3 when 0 then 8 when 1 then 16 else 32 end as bigint) as n from part)"


def _parts(spark, sf_dir):
    k = F.col("p_partkey")
    return spread(fx.table(spark, sf_dir, "part").select(
        k.alias("graph_id"), F.when(k % 3 == 0, 8).when(k % 3 == 1, 16).otherwise(32).alias("n")), "graph_id")


def _path_sql(orders: str) -> str:
    return f"""with {_PP}, od as ({orders}) select a.graph_id, cast(least(a.x, b.x) as int) as u, cast(greatest(a.x, b.x) as int) as v
  from od a join od b on a.graph_id = b.graph_id and b.i = a.i + 1"""


@query("g02_counting_paths", _path_sql("select graph_id, r.i, case when graph_id % 2 = 1 then (n - 1 - r.i + graph_id % n) % n else (r.i + graph_id % n) % n end as x from pp join range(32) r(i) on r.i < n"))
def counting_paths(spark, sf_dir):
    order = generate.counting_order("graph_id % n", "graph_id % 2 = 1")
    return unpack_edges(_parts(spark, sf_dir).withColumn("tri", generate.path_graph(order)))


@query("g03_xor_paths", _path_sql("select graph_id, r.i, xor(r.i, graph_id % n) as x from pp join range(32) r(i) on r.i < n"))
def xor_paths(spark, sf_dir):
    return unpack_edges(_parts(spark, sf_dir).withColumn("tri", generate.path_graph(generate.xor_order("cast(graph_id % n as int)"))))


_SWAP = "1 + {} % (n - 2)"
_S = [_SWAP.format(_draw("7", "graph_id", str(t))) for t in (1, 2)]
_AFTER = "case when {x} = {a} then {a} + 1 when {x} = {a} + 1 then {a} else {x} end"


@query("g04_perturbed_paths", _path_sql(
    f"select graph_id, i, {_AFTER.format(x='j', a='a1')} as x from (select *, case when graph_id % 2 = 1 then {_AFTER.format(x='i', a='a2')} else i end as j from (select graph_id, n, r.i, {_S[0]} as a1, {_S[1]} as a2 from pp join range(32) r(i) on r.i < n) q) z"))
def perturbed_paths(spark, sf_dir):
    order = generate.perturbed_order("1 + cast(graph_id % 2 as int)", "7", "graph_id")
    return unpack_edges(_parts(spark, sf_dir).withColumn("tri", generate.path_graph(order)))


@query("g05_segment_reversed_paths", _path_sql(
    f"select graph_id, r.i, case when {_draw('9', 'graph_id', 'r.i // 4')} * 2 > 1000003 then (r.i // 4) * 4 + least((r.i // 4) * 4 + 4, n) - 1 - r.i else r.i end as x from pp join range(32) r(i) on r.i < n"))
def segment_paths(spark, sf_dir):
    return unpack_edges(_parts(spark, sf_dir).withColumn("tri", generate.path_graph(generate.segment_order("4", "9", "graph_id"))))


@query("g05b_paths_with_extra_links", f"""with {_PP}, pr as (select graph_id, n, u.i as u, v.i as v, v.i * (v.i - 1) // 2 + u.i as p from pp join range(32) v(i) on v.i < n join range(32) u(i) on u.i < v.i),
 ex as (select *, row_number() over (partition by graph_id order by {_draw('5', 'graph_id', 'p')}, p) as rk from pr where v <> u + 1)
select graph_id, cast(u as int) as u, cast(v as int) as v from pr where v = u + 1 union all select graph_id, cast(u as int), cast(v as int) from ex where rk <= 1 + graph_id % 4""")
def extra_links(spark, sf_dir):
    tri = generate.path_with_extra_links("sequence(0, n - 1)", "1 + graph_id % 4", "5", "graph_id")
    return unpack_edges(_parts(spark, sf_dir).withColumn("tri", tri))


@query("g05c_isolated_vertices", f"""with {GS}, e as (select distinct graph_id, x from (select graph_id, u as x from gs union all select graph_id, v from gs) t)
select graph_id, 8 - count(*) as n_isolated from e group by graph_id""")
def isolated_vertices(spark, sf_dir):
    edges = fx.order_edges(spark, sf_dir)
    graphs = edges.select("graph_id").distinct().withColumn("n", F.lit(8))
    return topology.degrees_by_grouping(edges, graphs).groupBy("graph_id").agg(F.count_if(F.col("d") == 0).alias("n_isolated"))


_ST = f"""sz as (select 16::bigint as n, count(*) // 40 as want, 21 as seed from part),
 att as materialized (select n, want, seed, 1000000000000000 + k.i as seq, 'counting_path' as variant, k.i as k from sz join range(32) k(i) on true
  union all select n, want, seed, 2000000000000000 + k.i, 'xor_permuted', k.i from sz join range(1, 16) k(i) on true
  union all select n, want, seed, 3000000000000000 + k, 'extra_edges', k from (select *, unnest(range(want * 6)) as k from sz) a
  union all select n, want, seed, 4000000000000000 + 2 * k, 'segment_reversed', k from (select *, unnest(range(want * 4)) as k from sz) a
  union all select n, want, seed, 4000000000000000 + 2 * k + 1, 'perturbed', k from (select *, unnest(range(want * 4)) as k from sz) a),
 od as (select seq, r.i, case variant when 'counting_path' then case when k % 2 = 1 then (n - 1 - r.i + k // 2) % n else (r.i + k // 2) % n end when 'xor_permuted' then xor(r.i, k) when 'extra_edges' then r.i
   when 'segment_reversed' then case when {_draw('seed', 'k', 'r.i // 4')} * 2 > 1000003 then (r.i // 4) * 4 + least((r.i // 4) * 4 + 4, n) - 1 - r.i else r.i end
   else {_AFTER.format(x='r.i', a='(1 + ' + _draw('seed + 1', 'k', '1') + ' % (n - 2))')} end as x from att join range(16) r(i) on r.i < n),
 pr as (select seq as graph_id, u.i as u, v.i as v, row_number() over (partition by seq order by {_draw('seed + 1000', 'k', 'v.i * (v.i - 1) // 2 + u.i')}, v.i * (v.i - 1) // 2 + u.i) as rk, k from att join range(16) v(i) on v.i < n join range(16) u(i) on u.i < v.i - 1 where variant = 'extra_edges'),
 er as materialized (select a.seq as graph_id, least(a.x, b.x) as u, greatest(a.x, b.x) as v from od a join od b on a.seq = b.seq and b.i = a.i + 1 union all select graph_id, u, v from pr where rk <= 1 + k % 4)"""


@query("g05d_g08_structured_mix", f"""with recursive {_ST}, {_judge('er', 'att')}, fi as (select a.n, a.want, k.k, min(a.seq) as seq from att a join con c on c.graph_id = a.seq join keys k on k.graph_id = a.seq group by 1, 2, 3),
 rk as (select *, row_number() over (order by seq) as rank from fi) select cast(a.n as int) as n, a.variant, a.seq from rk join att a using (seq) where rank <= rk.want""")
def structured_mix(spark, sf_dir):
    size = fx.table(spark, sf_dir, "part").agg(F.expr("count(*) div 40").alias("want")).select(F.lit(16).alias("n"), "want", F.lit(21).alias("seed"))
    kept, _ = generate.accept(generate.structured_attempts(size, "want"), ["n"], "seq", "want")
    return kept.select("n", "variant", "seq")


@query("g08_first_of_each_key", f"""with {GS}, sg as (select graph_id, string_agg(u || '-' || v, ',' order by u, v) as s from gs group by 1), d as (select s, min(graph_id) as graph_id from sg group by 1)
select count(*) as n_texts, min(graph_id) as lowest from d""")
def first_of_each_text(spark, sf_dir):
    first = refinement.first_of_each(sparse_graphs(spark, sf_dir), ["tri"], "graph_id", ["graph_id"])
    return first.agg(F.count("*").alias("n_texts"), F.min("graph_id").alias("lowest"))


@query("g10_power_of_two", "select p_partkey as graph_id, cast(p_size > 0 and (p_size & (p_size - 1)) = 0 as int) as is_power from part")
def power_of_two(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("graph_id"), is_power_of_two("p_size").cast("int").alias("is_power"))


@query("u03_edge_set_operations", f"""with {GS}, p as (select distinct graph_id, r.i as u, r.i + 1 as v from gs cross join range(7) r(i))
select 'union' as op, count(*) as n_links from (select * from gs union select * from p) a union all select 'difference', count(*) from (select * from gs except select * from p) b""")
def set_operations(spark, sf_dir):
    e = fx.order_edges(spark, sf_dir)
    path = e.select("graph_id").distinct().withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("v", F.col("u") + 1)
    both = e.union(path).distinct().agg(F.lit("union").alias("op"), F.count("*").alias("n_links"))
    return both.union(e.subtract(path).agg(F.lit("difference").alias("op"), F.count("*").alias("n_links")))
