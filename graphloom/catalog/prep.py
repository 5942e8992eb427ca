"""Queries over the decision table: filters, joins, samples, splits, scaling, reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from graphloom.catalog.registry import query
from graphloom.catalog.sqltext import DEC, FEAT, FEATURES, LAB, mix
from graphloom.functions.scalars import bit_text, signed_log, tie_winner
from graphloom.operators import ordering, prep, reports, sampling, scaling
from graphloom.plans import balanced as plan
from graphloom.session import fresh_path
from graphloom.sources import fixtures as fx
from graphloom.sources import tables

FS = ", ".join(FEATURES)
LABELLED = f"{DEC}, d0 as (select *, cast(delta_cx > 0 as int) as y from dec where delta_cx <> 0)"
H = mix("graph_id")


def labelled_decisions(spark, sf_dir):
    return sampling.label(fx.decisions(spark, sf_dir))


@query("p01_label_and_winner", f"""with {DEC} select graph_id, cast(delta_cx > 0 as int) as y,
  case when delta_cx > 0 then 'matching' when delta_cx < 0 then 'pauli' else 'tie' end as winner from dec""")
def label_and_winner(spark, sf_dir):
    return fx.decisions(spark, sf_dir).select(
        "graph_id", (F.col("delta_cx") > 0).cast("int").alias("y"), tie_winner("delta_cx").alias("winner"))


@query("p02_drop_ties_and_cap_size", f"with {DEC} select graph_id, n_vertices, delta_cx from dec where delta_cx <> 0 and n_vertices <= 32")
def drop_ties(spark, sf_dir):
    return fx.decisions(spark, sf_dir).where("delta_cx <> 0 and n_vertices <= 32").select("graph_id", "n_vertices", "delta_cx")


_GAPS = """gaps as (select graph_id, n_vertices, case when graph_id % 7 = 0 then null else f_var end as a,
  case when graph_id % 5 = 0 then null else f_disc end as b from dec)"""


def _gaps(spark, sf_dir):
    k = F.col("graph_id")
    return fx.decisions(spark, sf_dir).select(
        "graph_id", "n_vertices", F.when(k % 7 != 0, F.col("f_var")).alias("a"), F.when(k % 5 != 0, F.col("f_disc")).alias("b"))


@query("p03_complete_rows", f"with {DEC}, {_GAPS} select * from gaps where a is not null and b is not null")
def complete_rows(spark, sf_dir):
    return prep.complete_rows(_gaps(spark, sf_dir), ["a", "b"])


@query("a20_filled_rows", f"""with {DEC}, {_GAPS} select count(*) as n_rows, count(*) filter (where a is not null and b is not null) as all_filled,
  count(*) filter (where (a is null) <> (b is null)) as partly_filled, count(*) filter (where a is null and b is null) as none_filled from gaps""")
def filled_rows(spark, sf_dir):
    return reports.filled_rows(_gaps(spark, sf_dir), ["a", "b"])


@query("p04_modal_size", f"""with {DEC}, m as (select f_items, count(*) as c from dec group by 1 order by c desc, f_items limit 1)
select graph_id, d.f_items from dec d join m on d.f_items = m.f_items""")
def modal_size(spark, sf_dir):
    d = fx.decisions(spark, sf_dir)
    mode = reports.mode_of(d, "f_items").select("f_items")
    return d.join(F.broadcast(mode), "f_items", "left_semi").select("graph_id", "f_items")  # one row


@query("p04_listed_sizes", f"with {DEC} select graph_id, n_vertices from dec where n_vertices in (8, 32)")
def listed_sizes(spark, sf_dir):
    return fx.decisions(spark, sf_dir).where(F.col("n_vertices").isin(8, 32)).select("graph_id", "n_vertices")


@query("p06_signed_log", f"with {DEC} select graph_id, round(sign(delta_cx) * log10(abs(delta_cx) + 1), 6) + 0 as slog from dec")
def signed_log_query(spark, sf_dir):
    return fx.decisions(spark, sf_dir).select("graph_id", (F.round(signed_log("delta_cx"), 6) + F.lit(0.0)).alias("slog"))


@query("p07_cost_deltas", f"with {DEC} select graph_id, cx_pauli - cx_matching as delta_cx, f_items - f_supp as delta_items from dec")
def cost_deltas(spark, sf_dir):
    return fx.decisions(spark, sf_dir).select(
        "graph_id", (F.col("cx_pauli") - F.col("cx_matching")).alias("delta_cx"), (F.col("f_items") - F.col("f_supp")).alias("delta_items"))


@query("p08_round_and_blank", f"""with {DEC} select graph_id, case when f_items = f_supp then null
  else round(f_disc / ((f_items - f_supp) * pi()), 6) end as ratio from dec""")
def round_and_blank(spark, sf_dir):
    gap = (F.col("f_items") - F.col("f_supp")).cast("double")
    ratio = F.when(gap == 0, F.lit(float("nan"))).otherwise(F.col("f_disc") / (gap * F.pi()))
    return fx.decisions(spark, sf_dir).select("graph_id", F.round(F.when(~F.isnan(ratio), ratio), 6).alias("ratio"))


@query("p10_stratum_key", f"with {LABELLED} select graph_id, n_vertices || '_' || y as stratum from d0")
def stratum_key(spark, sf_dir):
    return sampling.stratum(labelled_decisions(spark, sf_dir), ["n_vertices", "y"]).select("graph_id", "stratum")


@query("p11_seeded_sample", f"with {DEC} select graph_id, n_vertices from dec order by {mix('graph_id', '7')}, graph_id limit 300")
def seeded_sample(spark, sf_dir):
    return sampling.sample_rows(fx.decisions(spark, sf_dir).select("graph_id", "n_vertices"), 300, "graph_id", 7)


@query("j01_features_join_labels", f"with {FEAT}, {LAB} select f.graph_id, f.n_vertices, f_size, delta_cx from feat f join lab using (graph_id)")
def join_labels(spark, sf_dir):
    return prep.labelled(fx.decision_features(spark, sf_dir), fx.decision_labels(spark, sf_dir), ["delta_cx"]).select(
        "graph_id", "n_vertices", "f_size", "delta_cx")


@query("j02_keep_left_copy", f"""with {FEAT}, {LAB} select l.graph_id, l.n_vertices, l.cx_matching, l.cx_pauli, l.delta_cx,
  f.source_dataset, {', '.join('f.' + f for f in FEATURES)} from lab l join feat f using (graph_id)""")
def keep_left(spark, sf_dir):
    return prep.labelled(fx.decision_labels(spark, sf_dir), fx.decision_features(spark, sf_dir))


@query("j03_unlabelled", f"with {FEAT}, {LAB} select f.* from feat f where not exists (select 1 from lab l where l.graph_id = f.graph_id)")
def unlabelled(spark, sf_dir):
    return prep.unlabelled(fx.decision_features(spark, sf_dir), fx.decision_labels(spark, sf_dir))


@query("j04_not_yet_written", f"with {FEAT} select graph_id, n_vertices from feat where graph_id % 3 <> 0")
def not_yet_written(spark, sf_dir):
    f = fx.decision_features(spark, sf_dir).select("graph_id", "n_vertices")
    return prep.unlabelled(f, f.where("graph_id % 3 = 0"))


@query("j05_enrichment", f"""with {FEAT} select graph_id, f_size, case when n_vertices <= 32 then f_var * 2 end as spec_a from feat""")
def enrichment(spark, sf_dir):
    f = fx.decision_features(spark, sf_dir)
    extra = f.where("n_vertices <= 32").select("graph_id", (F.col("f_var") * 2).alias("spec_a"))
    return prep.enrich(f.select("graph_id", "f_size"), extra)


@query("j06_fill_missing", f"with {DEC}, {_GAPS} select graph_id, n_vertices, coalesce(a, case when graph_id % 2 = 0 then -1.0::double end) as a, b from gaps")
def fill_missing(spark, sf_dir):
    g = _gaps(spark, sf_dir)
    todo = prep.work_list(g, "a").where("graph_id % 2 = 0").select("graph_id", F.lit(-1.0).alias("a"))
    return prep.fill_missing(g, todo)


@query("j07_semi_join", f"with {FEAT}, {LAB} select graph_id, f_price from feat where graph_id in (select graph_id from lab)")
def semi_join(spark, sf_dir):
    return prep.with_labels_only(fx.decision_features(spark, sf_dir), fx.decision_labels(spark, sf_dir)).select("graph_id", "f_price")


@query("j11_fixed_feature_order", f"""with {LABELLED}, means as (unpivot (select avg(f_size)::double as f_size, avg(f_disc) as f_disc from d0) on f_size, f_disc into name feature value mean)
select o.ord, o.feature, round(m.mean, 6) as mean from (values (0, 'f_disc'), (1, 'f_items'), (2, 'f_size')) o(ord, feature) left join means m using (feature)""")
def fixed_order(spark, sf_dir):
    d = labelled_decisions(spark, sf_dir)
    means = reports.long_features(d, [], ["f_size", "f_disc"]).groupBy("feature").agg(F.round(F.avg("value"), 6).alias("mean"))
    order = spark.createDataFrame([(0, "f_disc"), (1, "f_items"), (2, "f_size")], "ord int, feature string")
    return order.join(means, "feature", "left").select("ord", "feature", "mean")


@query("u01_tagged_union", f"""with {DEC}, {LAB} select 'labelled' as part, graph_id, delta_cx from lab
  union all select 'all', graph_id, null from dec""")
def tagged_union(spark, sf_dir):
    lab = fx.decision_labels(spark, sf_dir).select(F.lit("labelled").alias("part"), "graph_id", "delta_cx")
    every = fx.decisions(spark, sf_dir).select(F.lit("all").alias("part"), "graph_id")
    return lab.unionByName(every, allowMissingColumns=True)


_BAL = f"""bal as (select * from (select *, row_number() over (partition by n_vertices, y order by {H}, graph_id) as rk,
    count(*) filter (where y = 1) over (partition by n_vertices) as cp, count(*) filter (where y = 0) over (partition by n_vertices) as cn
   from d1) t where rk <= least(cp, cn))"""
_D1 = f"""{FEAT}, {LAB}, d1 as (select f.*, l.delta_cx, cast(l.delta_cx > 0 as int) as y from feat f join lab l using (graph_id) where l.delta_cx <> 0)"""


def _labelled(spark, sf_dir):
    both = prep.labelled(fx.decision_features(spark, sf_dir), fx.decision_labels(spark, sf_dir), ["delta_cx"])
    return sampling.label(both)


@query("w01_balanced_within_size", f"with {_D1}, {_BAL} select graph_id, n_vertices, source_dataset, delta_cx, y from bal")
def balanced(spark, sf_dir):
    return sampling.balance_within(_labelled(spark, sf_dir), "n_vertices", "y", "graph_id").select(
        "graph_id", "n_vertices", "source_dataset", "delta_cx", "y")


@query("u02_balanced_with_unlabelled", f"""with {_D1}, {_BAL} select source_dataset, graph_id, n_vertices, {FS} from bal
  union all select source_dataset, graph_id, n_vertices, {FS} from feat where graph_id not in (select graph_id from lab)""")
def balanced_with_unlabelled(spark, sf_dir):
    cols = ["source_dataset", "graph_id", "n_vertices", *FEATURES]
    rows, _, _ = plan.build(fx.decision_features(spark, sf_dir), fx.decision_labels(spark, sf_dir))
    return rows.select(*cols)


@query("u02_balanced_labels", f"with {_D1}, {_BAL} select b.source_dataset, l.* from bal b join lab l using (graph_id)")
def balanced_labels(spark, sf_dir):
    _, rows, _ = plan.build(fx.decision_features(spark, sf_dir), fx.decision_labels(spark, sf_dir))
    return rows


@query("s10_balanced_manifest", f"""with {_D1}, {_BAL}, c as (select count(*) as l, count(*) filter (where y = 1) as m, count(*) filter (where y = 0) as p from bal),
 u as (select count(*) as u from feat where graph_id not in (select graph_id from lab))
select 'balanced' as stage, counter, value from c cross join u, lateral (values ('graphs', l + u), ('labelled', l), ('matching', m), ('pauli', p), ('unlabelled', u)) t(counter, value)""")
def balanced_manifest(spark, sf_dir):
    path = fresh_path(spark, "balanced")
    plan.write(*plan.build(fx.decision_features(spark, sf_dir), fx.decision_labels(spark, sf_dir)), path)
    return tables.read_manifest(spark, f"{path}/manifest")


@query("a19_composition", f"""with {_D1}, {_BAL}, av as (select n_vertices, count(*) filter (where y = 1) as ma, count(*) filter (where y = 0) as pa from d1 group by 1),
s as (select n_vertices, source_dataset, count(*) filter (where y = 1) as m, count(*) filter (where y = 0) as p from bal group by 1, 2)
select n_vertices, max(ma) as matching_avail, max(pa) as pauli_avail, least(max(ma), max(pa)) as take_per_class,
  '{{' || string_agg('"' || source_dataset || '":' || m, ',' order by source_dataset) filter (where m > 0) || '}}' as matching_from,
  '{{' || string_agg('"' || source_dataset || '":' || p, ',' order by source_dataset) filter (where p > 0) || '}}' as pauli_from,
  2 * least(max(ma), max(pa)) as total from av left join s using (n_vertices) group by n_vertices""")
def composition(spark, sf_dir):
    return plan.build(fx.decision_features(spark, sf_dir), fx.decision_labels(spark, sf_dir))[2]


_FIFTH = "cast(floor(({} * 2 + 5) / 10.0) as bigint)"


def _split(rank_from: str, stratum: str, seed: str = "0") -> str:
    t = _FIFTH.format("sz")
    v = _FIFTH.format(f"(sz - {t})")
    return f"""(select *, case when rk <= {t} then 'test' when rk <= {t} + {v} then 'val' else 'train' end as split
   from (select *, row_number() over (partition by {stratum} order by {mix('graph_id', seed)}, graph_id) as rk,
     count(*) over (partition by {stratum}) as sz from {rank_from}) r)"""


@query("w02_stratified_split", f"""with {LABELLED}, s as (select *, n_vertices || '_' || y as st from d0),
 k as (select min(c) as c from (select st, count(*) as c from s group by st) z),
 e as (select s.*, case when k.c >= 2 then st else 'all' end as st2, sd.i as seed from s cross join k cross join range(3) sd(i))
select graph_id, seed, split from {_split('e', 'seed, st2', 'seed')} x""")
def stratified_split(spark, sf_dir):
    d = labelled_decisions(spark, sf_dir).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))))
    return sampling.split_three(d, "graph_id", ["n_vertices", "y"], F.col("seed"), ["seed"]).select("graph_id", "seed", "split")


@query("w02_split_fallback", f"""with {LABELLED}, s as (select *, f_items || '_' || y as st from d0),
 k as (select min(c) as c from (select st, count(*) as c from s group by st) z),
 e as (select s.*, case when k.c >= 2 then st else 'all' end as st2 from s cross join k)
select graph_id, split from {_split('e', 'st2')} x""")
def split_fallback(spark, sf_dir):
    return sampling.split_three(labelled_decisions(spark, sf_dir), "graph_id", ["f_items", "y"]).select("graph_id", "split")


def _tiers(size: str) -> str:
    t = _FIFTH.format("sz")
    return f"""s as (select *, {size} || '_' || y as st from d0),
 k as (select min(c) as c from (select st, count(*) as c from s group by st) z),
 ky as (select min(c) as c from (select y, count(*) as c from s group by y) z),
 e as (select s.*, case when k.c >= 2 then st when ky.c >= 4 then 'y' || y else 'all' end as first from s cross join k cross join ky),
 r as (select *, row_number() over (partition by first order by {H}, graph_id) as rk, count(*) over (partition by first) as sz from e),
 c as (select *, rk <= {t} as is_test from r),
 d as (select * exclude (rk, sz), case when first = 'all' then 'all' else cast(y as varchar) end as second from c where not is_test),
 d2 as (select *, row_number() over (partition by second order by {mix('graph_id', '1')}, graph_id) as rk, count(*) over (partition by second) as sz from d)
select graph_id, case when rk <= {t} then 'val' else 'train' end as split from d2 union all select graph_id, 'test' from c where is_test"""


@query("w03_three_tier_split", f"with {LABELLED}, {_tiers('n_vertices')}")
def three_tier(spark, sf_dir):
    return sampling.split_three_tiers(labelled_decisions(spark, sf_dir), "graph_id", "n_vertices", "y").select("graph_id", "split")


@query("w03_three_tier_split_by_class", f"with {LABELLED}, {_tiers('f_items')}")
def three_tier_class(spark, sf_dir):
    return sampling.split_three_tiers(labelled_decisions(spark, sf_dir), "graph_id", "f_items", "y").select("graph_id", "split")


@query("w04_two_way_split", f"""with {LABELLED} select graph_id, case when rk <= {_FIFTH.format('sz')} then 'test' else 'train' end as split
 from (select *, row_number() over (partition by n_vertices, y order by {mix('graph_id', '42')}, graph_id) as rk, count(*) over (partition by n_vertices, y) as sz from d0) r""")
def two_way(spark, sf_dir):
    return sampling.split_two(labelled_decisions(spark, sf_dir), "graph_id", ["n_vertices", "y"], 42).select("graph_id", "split")


@query("m10_folds", f"""with {LABELLED} select graph_id, cast(rk % 5 as int) as fold from (select graph_id,
  row_number() over (partition by y order by {H}, graph_id) as rk from d0) t""")
def fold_query(spark, sf_dir):
    return sampling.folds(labelled_decisions(spark, sf_dir), "graph_id", ["y"]).select("graph_id", "fold")


@query("w05_cheap_first_order", f"with {DEC} select graph_id, n_vertices, row_number() over (order by n_vertices, graph_id) as position from dec")
def cheap_first(spark, sf_dir):
    d = fx.decisions(spark, sf_dir).select("graph_id", "n_vertices")
    return ordering.rank_in_group(d, [], [F.col("n_vertices"), F.col("graph_id")], "position")


@query("w08_keep_first", f"with {DEC} select f_items, min(graph_id) as graph_id from dec group by f_items")
def keep_first(spark, sf_dir):
    from graphloom.operators.refinement import first_of_each

    return first_of_each(fx.decisions(spark, sf_dir), ["f_items"], "graph_id", ["graph_id"]).select("f_items", "graph_id")


@query("w10_mixed_size_most_positives", f"""with {LABELLED} select source_dataset, n_vertices, pos as n_pos from (select source_dataset, n_vertices, pos,
  row_number() over (partition by source_dataset order by pos desc, n_vertices) as rk from (select source_dataset, n_vertices, sum(y)::bigint as pos, count(*) - sum(y) as neg
   from d0 group by 1, 2 having sum(y) > 0 and count(*) > sum(y)) a) b where rk = 1""")
def mixed_size(spark, sf_dir):
    c = labelled_decisions(spark, sf_dir).groupBy("source_dataset", "n_vertices").agg(
        F.sum("y").alias("n_pos"), F.count_if(F.col("y") == 0).alias("neg")).where("n_pos > 0 and neg > 0")
    return reports.top_per_group(c, ["source_dataset"], "n_pos", "n_vertices")


# --- scaling -----------------------------------------------------------------


def _z(over: str, sd: str = "stddev_pop") -> str:
    return ", ".join(
        f"round(({f} - avg({f}) over ({over})) / case when min({f}) over ({over}) = max({f}) over ({over}) then 1 else {sd}({f}) over ({over}) end, 6) + 0 as {f}_z"
        for f in FEATURES)


def _zcols(df):
    return df.select("graph_id", *[(F.round(f"{f}_z", 6) + F.lit(0.0)).alias(f"{f}_z") for f in FEATURES])


@query("t01_zscore_by_dataset", f"with {DEC} select graph_id, {_z('partition by source_dataset')} from dec")
def zscore_dataset(spark, sf_dir):
    return _zcols(scaling.standardize(fx.decisions(spark, sf_dir), FEATURES, ["source_dataset"]))


@query("t02_zscore_pooled", f"with {DEC} select graph_id, {_z('')} from dec")
def zscore_pooled(spark, sf_dir):
    return _zcols(scaling.standardize(fx.decisions(spark, sf_dir), FEATURES))


@query("t02_zscore_pooled_sample_deviation", f"with {DEC} select graph_id, {_z('', 'stddev_samp')} from dec")
def zscore_pooled_sample(spark, sf_dir):
    return _zcols(scaling.standardize(fx.decisions(spark, sf_dir), FEATURES, ddof=1))


@query("t03_zscore_within_size", f"with {DEC} select graph_id, {_z('partition by source_dataset, n_vertices')} from dec")
def zscore_size(spark, sf_dir):
    return _zcols(scaling.standardize(fx.decisions(spark, sf_dir), FEATURES, ["source_dataset", "n_vertices"]))


_SPLIT42 = f"""sp as (select *, case when rk <= {_FIFTH.format('sz')} then 'test' else 'train' end as split
 from (select *, row_number() over (partition by n_vertices, y order by {mix('graph_id', '42')}, graph_id) as rk, count(*) over (partition by n_vertices, y) as sz from d0) r)"""


def _split42(spark, sf_dir):
    return sampling.split_two(labelled_decisions(spark, sf_dir), "graph_id", ["n_vertices", "y"], 42)


@query("t04_fit_on_train_apply_to_test", f"""with {LABELLED}, {_SPLIT42}, mo as (select {', '.join(f'avg({f}) as m_{f}, stddev_pop({f}) as s_{f}' for f in FEATURES)} from sp where split = 'train')
select graph_id, {', '.join(f'round(({f} - m_{f}) / s_{f}, 6) + 0 as {f}_z' for f in FEATURES)} from sp cross join mo where split = 'test'""")
def fit_apply(spark, sf_dir):
    sp = _split42(spark, sf_dir)
    fitted = scaling.moments(sp.where("split = 'train'"), FEATURES)
    return _zcols(scaling.apply_moments(sp.where("split = 'test'"), fitted, FEATURES))


@query("t05_principal_axes")
def principal_axes(spark, sf_dir):
    d = fx.decisions(spark, sf_dir)
    out, shares = scaling.two_axes(d.where("source_dataset = 'a'"), d, FEATURES)
    return out.select("graph_id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"),
                      F.lit(round(shares[0], 6)).alias("share1"), F.lit(round(shares[1], 6)).alias("share2"))


@query("t06_mahalanobis")
def mahalanobis(spark, sf_dir):
    sp = _split42(spark, sf_dir)
    train = sp.where("split = 'train'")
    fitted = scaling.moments(train, FEATURES)
    z = [f"{f}_z" for f in FEATURES]
    scaled = scaling.apply_moments(sp, fitted, FEATURES)
    inverse = scaling.inverse_covariance(scaled.where("split = 'train'"), z)
    out = scaling.mahalanobis(scaled.where("split = 'test'"), z, [0.0] * len(z), inverse)
    return out.select("graph_id", F.round("mahalanobis", 6).alias("mahalanobis"))


@query("t07_a11_out_of_range", f"""with {LABELLED}, {_SPLIT42}, r as (select {', '.join(f'min({f}) as lo_{f}, max({f}) as hi_{f}' for f in FEATURES)} from sp where split = 'train')
select graph_id, cast({' + '.join(f'cast({f} < lo_{f} or {f} > hi_{f} as int)' for f in FEATURES)} as int) as features_oob from sp cross join r where split = 'test'""")
def out_of_range(spark, sf_dir):
    sp = _split42(spark, sf_dir)
    r = scaling.ranges(sp.where("split = 'train'"), FEATURES)
    return scaling.out_of_range(sp.where("split = 'test'"), r, FEATURES).select("graph_id", "features_oob")


# --- reports -----------------------------------------------------------------


@query("a01_balance_report", f"""with {DEC}, c as (select source_dataset, count(*) as n, count(*) filter (where delta_cx > 0) as m, count(*) filter (where delta_cx < 0) as p,
  count(*) filter (where delta_cx = 0) as t from dec where source_dataset = 'a' or delta_cx <= 0 or graph_id % 20 = 1 group by 1)
select source_dataset, n as n_graphs, m as matching_wins, p as pauli_wins, t as ties, round(m / n::double, 4) as matching_win_frac,
  round(least(m, p) / n::double, 4) as minority_frac, round(greatest(m, p) / greatest(least(m, p), 1)::double, 1) as imbalance_ratio,
  case when round(least(m, p) / n::double, 4) < 0.05 then 'severely imbalanced' when round(least(m, p) / n::double, 4) < 0.2 then 'imbalanced' else 'reasonably balanced' end as verdict from c""")
def balance_report(spark, sf_dir):
    d = fx.decisions(spark, sf_dir).where("source_dataset = 'a' or delta_cx <= 0 or graph_id % 20 = 1")
    return reports.balance_report(d, ["source_dataset"])


@query("a02_win_rate_by_size", f"""with {DEC} select source_dataset, n_vertices, count(*) as n_graphs, round(avg(cast(delta_cx > 0 as int)), 3) as matching_win_rate,
  round(avg(delta_cx), 1) as mean_delta_cx from dec group by 1, 2""")
def win_rate(spark, sf_dir):
    return reports.win_rate_by(fx.decisions(spark, sf_dir), ["source_dataset", "n_vertices"])


_LONG = f"""lf as (unpivot (select source_dataset, {', '.join(f'{f}::double as {f}' for f in FEATURES)} from dec) on {FS} into name feature value value)"""


@query("a03_modal_fractions", f"""with {DEC}, {_LONG}, c as (select source_dataset, feature, value, count(*) as c from lf group by 1, 2, 3)
select source_dataset, feature, round(max(c) / sum(c)::double, 3) as mode_frac, cast(round(max(c) / sum(c)::double, 3) >= 0.9 as int) as degenerate from c group by 1, 2""")
def modal_fractions(spark, sf_dir):
    return reports.modal_fractions(fx.decisions(spark, sf_dir), ["source_dataset"], FEATURES)


@query("a04_counts_by_key", f"with {DEC} select n_vertices, source_dataset, count(*) as n_rows from dec group by 1, 2 order by 1, 2")
def counts_by_key(spark, sf_dir):
    return fx.decisions(spark, sf_dir).groupBy("n_vertices", "source_dataset").agg(F.count("*").alias("n_rows")).orderBy("n_vertices", "source_dataset")


@query("a09_distinct_counts", f"with {LABELLED} select source_dataset, count(distinct n_vertices) as n_sizes, count(distinct y) as n_classes from d0 group by 1")
def distinct_counts(spark, sf_dir):
    return labelled_decisions(spark, sf_dir).groupBy("source_dataset").agg(
        F.countDistinct("n_vertices").alias("n_sizes"), F.countDistinct("y").alias("n_classes"))


@query("a10_medians", f"with {DEC}, {_LONG} select source_dataset, feature, round(quantile_cont(value, 0.5), 6) as median from lf group by 1, 2")
def medians(spark, sf_dir):
    return reports.medians(fx.decisions(spark, sf_dir), ["source_dataset"], FEATURES).withColumn("median", F.round("median", 6))


@query("a12_correlation", " union all ".join(
    f"select * from (with {DEC} select source_dataset, '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from dec group by 1)"
    for a in FEATURES + ["delta_cx"] for b in FEATURES + ["delta_cx"]))
def correlation(spark, sf_dir):
    return reports.correlation(fx.decisions(spark, sf_dir), FEATURES + ["delta_cx"], ["source_dataset"]).withColumn("r", F.round("r", 6))


_ALL = " union all ".join(f"select * from (select '{a}' as a, '{b}' as b, covar_samp({a}, {b}) + {1e-6 if a == b else 0.0} as c from dec)" for a in FEATURES for b in FEATURES)


@query("a14_covariance", f"with {DEC} select a, b, round(c, 6) as c from ({_ALL}) t")
def covariance(spark, sf_dir):
    c = scaling.covariance(fx.decisions(spark, sf_dir), FEATURES) + 1e-6 * np.eye(len(FEATURES))
    cells = [(a, b, float(c[i, j])) for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES)]
    return spark.createDataFrame(cells, "a string, b string, c double").withColumn("c", F.round("c", 6))


@query("a14_inverse_covariance", f"select a, b, cast(a = b as double) as cell from (values {', '.join(f'({f!r})' for f in FEATURES)}) x(a) cross join (values {', '.join(f'({f!r})' for f in FEATURES)}) y(b)")
def inverse_covariance(spark, sf_dir):
    """The inverse times the matrix is the identity."""
    d = fx.decisions(spark, sf_dir)
    c = scaling.covariance(d, FEATURES) + 1e-6 * np.eye(len(FEATURES))
    product = scaling.inverse_covariance(d, FEATURES) @ c
    cells = [(a, b, float(product[i, j])) for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES)]
    return spark.createDataFrame(cells, "a string, b string, cell double").withColumn("cell", F.round("cell", 3) + 0.0)


@query("a15_signed_log_histogram", f"""with {DEC}, x as (select source_dataset, sign(delta_cx) * log10(abs(delta_cx) + 1) as x from dec),
 e as (select source_dataset, min(x) as lo, max(x) as hi, count(*) as n from x group by 1)
select x.source_dataset, cast(least(floor((x - lo) / (hi - lo) * 60), 59) as int) as bin, round(lo + least(floor((x - lo) / (hi - lo) * 60), 59) * ((hi - lo) / 60), 6) as left_edge,
  count(*) as n_rows, round(count(*) / (n * ((hi - lo) / 60)), 6) as density from x join e using (source_dataset) group by x.source_dataset, lo, hi, n, least(floor((x - lo) / (hi - lo) * 60), 59)""")
def slog_histogram(spark, sf_dir):
    h = reports.histogram(fx.decisions(spark, sf_dir), signed_log("delta_cx"), 60, ["source_dataset"], shared=False)
    return h.withColumn("left_edge", F.round("left_edge", 6)).withColumn("density", F.round("density", 6))


@query("a15_class_histogram", f"""with {LABELLED}, e as (select min(f_price) as lo, max(f_price) as hi from d0), c as (select y, count(*) as n from d0 group by y)
select d0.y, cast(least(floor((f_price - lo) / (hi - lo) * 30), 29) as int) as bin, round(lo + least(floor((f_price - lo) / (hi - lo) * 30), 29) * ((hi - lo) / 30), 6) as left_edge, count(*) as n_rows,
  round(count(*) / (n * ((hi - lo) / 30)), 6) as density from d0 cross join e join c on c.y = d0.y group by d0.y, lo, hi, n, least(floor((f_price - lo) / (hi - lo) * 30), 29)""")
def class_histogram(spark, sf_dir):
    h = reports.histogram(labelled_decisions(spark, sf_dir), F.col("f_price"), 30, ["y"])
    return h.withColumn("left_edge", F.round("left_edge", 6)).withColumn("density", F.round("density", 6))


@query("a15_value_histogram", f"with {LABELLED} select y, cast(n_vertices as double) as n_vertices, count(*) as n_rows from d0 group by 1, 2")
def value_histogram(spark, sf_dir):
    return reports.value_histogram(labelled_decisions(spark, sf_dir), "n_vertices", ["y"])


@query("a15_value_histogram_binned", f"""with {LABELLED}, e as (select cast(min(f_items) as double) as lo, cast(max(f_items) as double) as hi, count(distinct f_items) as d from d0)
select y, case when d <= 12 then cast(f_items as double) else lo + least(floor((f_items - lo) / ((hi - lo) / 30)), 29) * ((hi - lo) / 30) end as f_items, count(*) as n_rows from d0 cross join e group by 1, 2""")
def value_histogram_binned(spark, sf_dir):
    return reports.value_histogram(labelled_decisions(spark, sf_dir), "f_items", ["y"])


@query("a17_cost_growth", f"""with {DEC}, f as (select source_dataset, regr_slope(ln(cx_matching), ln(f_items)) as b, regr_intercept(ln(cx_matching), ln(f_items)) as a
  from dec where cx_matching > 0 group by 1) select source_dataset, n_vertices, round(exp(a + b * ln(n_vertices)), 4) as projected_seconds, round(b, 6) as exponent_b
from f cross join (values (512), (1024)) t(n_vertices)""")
def cost_growth(spark, sf_dir):
    d = fx.decisions(spark, sf_dir).withColumn("seconds", F.col("cx_matching").cast("double"))
    g = reports.cost_growth(d, ["source_dataset"], "f_items", "seconds", [512, 1024])
    return g.select("source_dataset", "n_vertices", F.round("projected_seconds", 4).alias("projected_seconds"), F.round("exponent_b", 6).alias("exponent_b"))


@query("a18_cost_to_go", f"""with {DEC}, m as (select n_vertices, avg(cx_matching / 10.0::double) as a from dec where graph_id % 50 <> 0 and n_vertices < 64 group by 1),
 r as (select n_vertices, count(*) as remaining from dec where graph_id % 50 = 0 or n_vertices = 64 group by 1)
select r.n_vertices, remaining, round(remaining * coalesce(m.a, (select max(a) from m), 1.0), 4) as seconds_left from r left join m using (n_vertices)""")
def cost_to_go(spark, sf_dir):
    d = fx.decisions(spark, sf_dir).withColumn("t", F.col("cx_matching") / 10.0)
    done = d.where("graph_id % 50 <> 0 and n_vertices < 64")
    left = d.where("graph_id % 50 = 0 or n_vertices = 64")
    return reports.cost_to_go(done, left, "n_vertices", "t").withColumn("seconds_left", F.round("seconds_left", 4))


@query("m09_class_weights", f"with {LABELLED} select y, count(*) as n_class, round((select count(*) from d0) / (2.0::double * count(*)), 6) as weight from d0 group by y")
def class_weights(spark, sf_dir):
    return sampling.class_weights(labelled_decisions(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("i03_refresh_work_list", f"with {DEC} select graph_id, n_vertices from dec where n_vertices <= 32 and not coalesce(case when graph_id % 3 = 0 then null else graph_id % 2 = 0 end, false)")
def refresh_work_list(spark, sf_dir):
    k = F.col("graph_id")
    d = fx.decisions(spark, sf_dir).withColumn("decomp_refreshed", F.when(k % 3 != 0, k % 2 == 0))
    return prep.not_refreshed(d, "decomp_refreshed", 32).select("graph_id", "n_vertices")


@query("bits_as_text", f"with {DEC} select graph_id, right('000000' || ltrim(cast(n_vertices as bit)::varchar, '0'), 7) as bits from dec")
def bits_as_text(spark, sf_dir):
    return fx.decisions(spark, sf_dir).select("graph_id", bit_text("n_vertices", 7).alias("bits"))
