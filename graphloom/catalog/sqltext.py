"""Common table expressions used by the oracle statements (DuckDB dialect)."""

GD = """gd as (select distinct l_partkey as graph_id, least(a, b) as u, greatest(a, b) as v
  from (select l_partkey, l_orderkey % 8 as a, (l_suppkey + l_linenumber) % 8 as b from lineitem) t where a <> b)"""

GS = """gs as (select distinct l_orderkey as graph_id, least(a, b) as u, greatest(a, b) as v
  from (select l_orderkey, l_partkey % 8 as a, l_suppkey % 8 as b from lineitem) t where a <> b)"""

GW = """gw as (select distinct l_suppkey as graph_id, least(a, b) as u, greatest(a, b) as v
  from (select l_suppkey, l_orderkey % 128 as a, l_partkey % 128 as b from lineitem) t where a <> b)"""

# Both eight-vertex collections in one: order graphs get odd ids, part graphs even.
BOTH = f"""{GD}, {GS}, gb as (select graph_id * 2 as graph_id, u, v from gd
  union all select graph_id * 2 + 1, u, v from gs)"""


def degrees(edges: str, n: int, name: str = "deg") -> str:
    return f"""{name} as (select g.graph_id, r.i as vertex, coalesce(d.d, 0) as d
  from (select distinct graph_id from {edges}) g cross join range({n}) r(i)
  left join (select graph_id, x, count(*) as d from (select graph_id, u as x from {edges}
    union all select graph_id, v from {edges}) e group by graph_id, x) d
  on d.graph_id = g.graph_id and d.x = r.i)"""


def directed(edges: str, name: str = "dir") -> str:
    return f"{name} as (select graph_id, u as s, v as t from {edges} union all select graph_id, v, u from {edges})"


def distances(edges: str, n: int, name: str = "dist") -> str:
    """Shortest distances between all ordered pairs; needs `dir` and `recursive`."""
    return f"""walk as (select graph_id, i as s, i as t, 0 as d from (select distinct graph_id from {edges}) g
    cross join range({n}) r(i)
  union select w.graph_id, w.s, e.t, w.d + 1 from walk w join dir e on e.graph_id = w.graph_id and e.s = w.t
    where w.d < {n - 1}),
  {name} as (select graph_id, s, t, min(d) as d from walk group by graph_id, s, t)"""


def text(edges: str, n: int, name: str = "txt") -> str:
    """graph6 text of a link table, all graphs on n vertices."""
    bits = n * (n - 1) // 2
    chars = -(-bits // 6)
    header = f"chr({n + 63})" if n < 63 else f"'~' || chr({(n >> 12) + 63}) || chr({(n >> 6 & 63) + 63}) || chr({(n & 63) + 63})"
    return f"""{name} as (select g.graph_id, {header} || string_agg(chr(cast(63 + coalesce(b.val, 0) as int)), '' order by c.k) as g6
  from (select distinct graph_id from {edges}) g cross join range({chars}) c(k)
  left join (select graph_id, (v * (v - 1) // 2 + u) // 6 as k, sum(1 << cast(5 - (v * (v - 1) // 2 + u) % 6 as int)) as val
    from {edges} group by 1, 2) b on b.graph_id = g.graph_id and b.k = c.k
  group by g.graph_id)"""


DEC = """dec as (select p.p_partkey as graph_id,
  cast(8 * (case p.p_partkey % 4 when 0 then 1 when 1 then 2 when 2 then 4 else 8 end) as int) as n_vertices,
  case when p.p_partkey % 3 = 0 then 'a' else 'b' end as source_dataset,
  p.p_size as f_size, p.p_retailprice as f_price, a.f_items, a.f_disc, a.f_var, a.f_supp,
  a.cx_matching, a.cx_pauli, a.cx_pauli - a.cx_matching as delta_cx
  from part p join (select l_partkey, count(*) as f_items,
    sum(cast(round(l_discount * 100) as bigint)) / (cast(count(*) as double) * 100) as f_disc,
    (cast(count(*) as double) * sum(l_quantity * l_quantity) - sum(l_quantity) * sum(l_quantity))
      / (cast(count(*) as double) * cast(count(*) as double)) as f_var,
    count(distinct l_suppkey) as f_supp,
    cast(sum(case when l_returnflag = 'A' then l_quantity else 0 end) as bigint) as cx_matching,
    cast(sum(case when l_returnflag = 'R' then l_quantity else 0 end) as bigint) as cx_pauli
    from lineitem group by l_partkey) a on p.p_partkey = a.l_partkey)"""

FEAT = f"{DEC}, feat as (select graph_id, n_vertices, source_dataset, f_size, f_price, f_items, f_disc, f_var, f_supp from dec)"
LAB = "lab as (select graph_id, n_vertices, cx_matching, cx_pauli, delta_cx from dec where graph_id % 50 <> 0)"

PRED = f"""{DEC}, pred as (select d.graph_id, d.n_vertices, d.source_dataset, d.delta_cx, cast(d.delta_cx > 0 as int) as y,
  m.i as model, s.i as seed,
  round(1 / (1 + exp(-(d.delta_cx / 60.0::double + ((d.graph_id * 37 + s.i * 13 + m.i * 7) % 101 - 50) / 25.0::double))), 6) as score
  from dec d cross join range(3) m(i) cross join range(5) s(i) where d.delta_cx <> 0),
 pr as (select *, cast(score >= 0.5 as int) as pred from pred)"""

FEATURES = ["f_size", "f_price", "f_items", "f_disc", "f_var", "f_supp"]


def mix(key: str, seed: str = "0") -> str:
    return f"cast('0x' || substr(md5(concat_ws(':', cast({key} as varchar), cast({seed} as varchar))), 1, 15) as bigint) % 1000003"
