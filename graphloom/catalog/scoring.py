"""Queries over predictions: metrics, curves, estimates, neighbours, linear models."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog.prep import LABELLED, _split42, _SPLIT42, labelled_decisions
from graphloom.catalog.registry import query
from graphloom.catalog.sqltext import DEC, FEATURES, PRED, mix
from graphloom.functions import scalars
from graphloom.session import written
from graphloom.operators import labelfree, linear, metrics, neighbors, reports, scaling
from graphloom.sources import fixtures as fx

MS = ["model", "seed"]


def _round(df, names, digits=6):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})


_CONF = """cm as (select {k}, count(*) filter (where y = 0 and pred = 0) as tn, count(*) filter (where y = 0 and pred = 1) as fp,
  count(*) filter (where y = 1 and pred = 0) as fn, count(*) filter (where y = 1 and pred = 1) as tp,
  sum(case when pred = 1 then delta_cx else 0 end) as cap, sum(case when delta_cx > 0 then delta_cx else 0 end) as rea from pr group by {k}),
 me as (select *, (tp + tn) / n as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall,
  tn / nullif(tn + fp, 0) as specificity, tn / nullif(tn + fn, 0) as npv, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1,
  case when tp + fn > 0 and tn + fp > 0 then coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0) else 0 end as mcc,
  ((tp + tn) / n - ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n)) / nullif(1 - ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n), 0) as cohen_kappa,
  case when rea > 0 then cap / rea::double end as savings
  from (select {k}, tn::double as tn, fp::double as fp, fn::double as fn, tp::double as tp, (tn + fp + fn + tp)::double as n, cap, rea from cm) z)"""

_AUC = """sc as (select {k}, score, sum(y)::double as pos, sum(1 - y)::double as neg from pr group by {k}, score),
 ru as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by {k}) as np, sum(neg) over (partition by {k}) as nn
   from sc window w as (partition by {k} order by score desc)),
 au as (select {k}, sum(pos * (nn - fp + neg / 2)) / nullif(max(np) * max(nn), 0) as roc_auc,
   case when max(nn) > 0 then sum(pos * tp / (tp + fp)) / nullif(max(np), 0) end as pr_auc,
   case when max(np) > 0 and max(nn) > 0 then -sum(pos * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + neg * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15))) / (max(np) + max(nn)) end as log_loss
   from ru group by {k})"""

_TWELVE = ", ".join(f"round({m}, 6) + 0 as {m}" for m in metrics.METRICS)


def _score_sql(k: str) -> str:
    return f"{_CONF.format(k=k)}, {_AUC.format(k=k)}"


@query("e01_e09_all_metrics", f"""with {PRED}, {_score_sql('model, seed')}
select model, seed, {_TWELVE}, tn::bigint as tn, fp::bigint as fp, fn::bigint as fn, tp::bigint as tp from me join au using (model, seed)""")
def all_metrics(spark, sf_dir):
    return _round(metrics.score(fx.predictions(spark, sf_dir), MS), metrics.METRICS)


# In the second query the graphs on 8 vertices are of one class only.
_CONDITIONAL = [m for m in metrics.METRICS if m not in ("cohen_kappa", "log_loss")]
_ONE_CLASS = PRED.replace("d.delta_cx <> 0)", "d.delta_cx <> 0 and not (d.n_vertices = 8 and d.delta_cx < 0))")


def _per_size_sql(pred):
    single = "(tp + fn = 0 or tn + fp = 0)"
    names = [f"round({m}, 6) + 0 as {m}" if m == "accuracy" else f"case when not {single} then round({m}, 6) + 0 end as {m}" for m in _CONDITIONAL]
    return f"""with {pred}, {_score_sql('model, seed, n_vertices')}
select model, seed, n_vertices, (fn + tp)::bigint as matching_wins, cast({single} as int) as single_class, {', '.join(names)}
from me join au using (model, seed, n_vertices)"""


@query("e14_metrics_per_size", _per_size_sql(PRED))
def per_size(spark, sf_dir):
    return _round(metrics.per_size(fx.predictions(spark, sf_dir), MS), _CONDITIONAL)


@query("e14_metrics_of_one_class", _per_size_sql(_ONE_CLASS))
def per_size_one_class(spark, sf_dir):
    p = fx.predictions(spark, sf_dir).where("not (n_vertices = 8 and delta_cx < 0)")
    return _round(metrics.per_size(p, MS), _CONDITIONAL)


_SEEDS = f"""{_score_sql('model, seed')}, lo as (unpivot (select model, seed, {', '.join(metrics.METRICS)} from me join au using (model, seed)) on {', '.join(metrics.METRICS)} into name metric value value)"""


@query("a05_mean_over_seeds", f"with {PRED}, {_SEEDS} select model, metric, round(avg(value), 6) + 0 as mean, round(stddev_pop(value), 6) as std from lo group by 1, 2")
def over_seeds(spark, sf_dir):
    return _round(metrics.over_seeds(metrics.score(fx.predictions(spark, sf_dir), MS), ["model"]), ["mean", "std"])


@query("a06_a07_drop_against_full", f"""with {PRED}, {_SEEDS}, s as (select model, metric, avg(value) as mean, stddev_samp(value) as std from lo where metric in ('mcc', 'savings') group by 1, 2)
select s.model, s.metric, round(s.mean, 6) + 0 as mean, round(s.std, 6) as std, round(f.mean - s.mean, 6) + 0 as drop from s join s f on f.metric = s.metric and f.model = 0""")
def drop_against_full(spark, sf_dir):
    scored = metrics.score(fx.predictions(spark, sf_dir), MS)
    s = metrics.over_seeds(scored, ["model"], ["mcc", "savings"], ddof=1)
    full = s.where("model = 0").select("metric", F.col("mean").alias("full_mean"))
    out = s.join(full, "metric").withColumn("drop", F.col("full_mean") - F.col("mean")).drop("full_mean")
    return _round(out, ["mean", "std", "drop"])


@query("a08_w06_best_model", f"""with {PRED}, {_CONF.format(k='source_dataset, model')}
select source_dataset, model, round(mcc, 6) as mcc from (select *, row_number() over (partition by source_dataset order by mcc desc, model) as rk from me) t where rk = 1""")
def best_model(spark, sf_dir):
    scored = metrics.score(fx.predictions(spark, sf_dir), ["source_dataset", "model"], ranked=False)
    return _round(reports.top_per_group(scored, ["source_dataset"], "mcc", "model"), ["mcc"])


@query("a16_confusion_over_seeds", f"""with {PRED}, {_CONF.format(k='model, seed')}, lo as (unpivot (select model, seed, tn, fp, fn, tp from cm) on tn, fp, fn, tp into name metric value value)
select model, metric, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std from lo group by 1, 2""")
def confusion_over_seeds(spark, sf_dir):
    c = metrics.confusion(fx.predictions(spark, sf_dir), MS)
    return _round(metrics.over_seeds(c, ["model"], ["tn", "fp", "fn", "tp"]), ["mean", "std"])


@query("e10_w09_roc_points", f"""with {PRED}, {_AUC.format(k='model, seed')} select model, seed, score, round(fp / nn, 6) as fpr, round(tp / np, 6) as tpr from ru""")
def roc_points(spark, sf_dir):
    return _round(metrics.roc_points(fx.predictions(spark, sf_dir), MS), ["fpr", "tpr"])


@query("e11_pr_points", f"""with {PRED}, {_AUC.format(k='model, seed')} select model, seed, score, round(tp / np, 6) as recall, round(tp / (tp + fp), 6) as precision, round(np / (np + nn), 6) as no_skill from ru""")
def pr_points(spark, sf_dir):
    return _round(metrics.pr_points(fx.predictions(spark, sf_dir), MS), ["recall", "precision", "no_skill"])


@query("e12_calibration_uniform", f"""with {PRED} select model, cast(len(list_filter([{', '.join(repr(i / 10) + '::double' for i in range(1, 10))}], lambda e: e < score)) as int) as bin, round(avg(score), 6) as mean_score,
  round(avg(y), 6) as observed, count(*) as n_rows from pr group by 1, 2""")
def calibration_uniform(spark, sf_dir):
    return _round(metrics.uniform_calibration(fx.predictions(spark, sf_dir), ["model"]), ["mean_score", "observed"])


@query("e12_calibration_quantile", f"""with {PRED}, e as (select model, quantile_cont(score, [{', '.join(f'{i / 10}' for i in range(1, 10))}]) as edges from pr group by 1)
select pr.model, cast(len(list_filter(edges, lambda x: x < score)) as int) as bin, round(avg(score), 6) as mean_score, round(avg(y), 6) as observed, count(*) as n_rows from pr join e using (model) group by 1, 2""")
def calibration_quantile(spark, sf_dir):
    return _round(metrics.quantile_calibration(fx.predictions(spark, sf_dir), ["model"]), ["mean_score", "observed"])


@query("e13_threshold_rule", f"""with {LABELLED}, {_SPLIT42}, c as (select n_vertices, f_var as t, sum(y)::double as pos, sum(1 - y)::double as neg from sp where split = 'train' group by 1, 2),
 r as (select n_vertices, t, sum(pos) over w as lp, sum(neg) over w as ln, sum(pos) over (partition by n_vertices) as p, sum(neg) over (partition by n_vertices) as n from c window w as (partition by n_vertices order by t)),
 m as (select n_vertices, t, coalesce((lp * (n - ln) - ln * (p - lp)) / nullif(sqrt(lp + ln) * sqrt(p + n - lp - ln) * sqrt(p) * sqrt(n), 0), 0) as mcc from r),
 b as (select n_vertices, t, s.i as low_is_match, round(case when s.i = 1 then mcc else -mcc end, 12) as mcc from m cross join range(2) s(i)),
 best as (select * from (select *, row_number() over (partition by n_vertices order by mcc desc, t, low_is_match desc) as rk from b) z where rk = 1)
select te.n_vertices, round(max(threshold), 6) as threshold, max(low_is_match)::int as low_is_match, round(max(mcc), 6) as train_mcc,
  count(*) filter (where y = 1 and pred = 1) as tp, count(*) filter (where y = 0 and pred = 1) as fp
from (select sp.*, t as threshold, low_is_match, mcc, cast((f_var <= t) = (low_is_match = 1) as int) as pred from sp join best using (n_vertices) where split = 'test') te group by 1""")
def threshold_rule(spark, sf_dir):
    sp = _split42(spark, sf_dir)
    rule = metrics.threshold_rule(sp.where("split = 'train'"), ["n_vertices"], "f_var")
    te = sp.where("split = 'test'").join(rule, "n_vertices").withColumn(
        "pred", ((F.col("f_var") <= F.col("threshold")) == (F.col("low_is_match") == 1)).cast("int"))
    return te.groupBy("n_vertices").agg(
        F.round(F.max("threshold"), 6).alias("threshold"), F.max("low_is_match").alias("low_is_match"), F.round(F.max("mcc"), 6).alias("train_mcc"),
        F.count_if((F.col("y") == 1) & (F.col("pred") == 1)).alias("tp"), F.count_if((F.col("y") == 0) & (F.col("pred") == 1)).alias("fp"))


@query("e15_selective_prediction", f"""with {PRED}, c as (select *, greatest(score, 1 - score) as conf, cast(pred = y as int) as hit from pr)
select model, n_vertices, count(*) as n_graphs, round(avg(conf), 6) as mean_confidence, round(avg(hit), 6) as accuracy_all, round(avg(cast(conf >= 0.9 as int)), 6) as coverage,
  round(avg(hit) filter (where conf >= 0.9), 6) as accuracy_conf from c group by 1, 2""")
def selective(spark, sf_dir):
    return _round(metrics.selective(fx.predictions(spark, sf_dir), ["model", "n_vertices"]), ["mean_confidence", "accuracy_all", "coverage", "accuracy_conf"])


# A quantile level must be constant in DuckDB, so it is spelled out by rank.
_ATC = """va as (select *, greatest(score, 1 - score) as conf from pr where seed = 0 and graph_id % 5 = 0),
 vr as (select model, conf, row_number() over (partition by model order by conf) - 1 as i, greatest(0, 1 - avg(cast(pred = y as int)) over (partition by model)) * (count(*) over (partition by model) - 1) as pos from va),
 th as (select model, max(conf) filter (where i = floor(pos)) + (max(conf) filter (where i = ceil(pos)) - max(conf) filter (where i = floor(pos))) * (max(pos) - floor(max(pos))) as threshold from vr group by model),
 ta as (select t.*, greatest(score, 1 - score) as conf, threshold from pr t join th using (model) where seed = 0 and graph_id % 5 <> 0)"""


def _val_and_target(spark, sf_dir):
    p = fx.predictions(spark, sf_dir).where("seed = 0")
    return p.where("graph_id % 5 = 0"), p.where("graph_id % 5 <> 0")


@query("w11_confidence_quantile", f"with {PRED}, {_ATC} select model, round(threshold, 6) as threshold from th")
def confidence_quantile(spark, sf_dir):
    val, _ = _val_and_target(spark, sf_dir)
    return _round(labelfree.confidence_thresholds(val, ["model"]), ["threshold"])


@query("e16_estimated_accuracy", f"with {PRED}, {_ATC} select model, n_vertices, round(avg(cast(conf >= threshold as int)), 6) as atc_estimated_accuracy from ta group by 1, 2")
def estimated_accuracy(spark, sf_dir):
    val, target = _val_and_target(spark, sf_dir)
    th = labelfree.confidence_thresholds(val, ["model"])
    return _round(labelfree.estimated_accuracy(target, th, ["model"], ["model", "n_vertices"]), ["atc_estimated_accuracy"])


@query("e17_disagreement", f"""with {PRED} select source_dataset, n_vertices, round(avg(s), 6) as ensemble_disagreement from (select graph_id, source_dataset, n_vertices, cast(min(pred) <> max(pred) as int) as s
  from pr where seed = 0 group by 1, 2, 3) t group by 1, 2""")
def disagreement(spark, sf_dir):
    p = fx.predictions(spark, sf_dir).where("seed = 0")
    return _round(labelfree.disagreement(p, ["source_dataset", "n_vertices", "graph_id"], ["source_dataset", "n_vertices"]), ["ensemble_disagreement"])


# What lies outside the validation rows: features beyond their range, and the distance of
# two features from them (of two, because SQL can say the inverse of two by two).
_OUT = f"""ra as (select {', '.join(f'min({f}) as lo_{f}, max({f}) as hi_{f}' for f in FEATURES)},
   avg(f_price) as mp, avg(f_var) as mv, var_samp(f_price) + 1e-6 as a, covar_samp(f_price, f_var) as b, var_samp(f_var) + 1e-6 as c from dec where delta_cx <> 0 and graph_id % 5 = 0),
 ob as (select d.graph_id, {' + '.join(f'cast({f} < lo_{f} or {f} > hi_{f} as int)' for f in FEATURES)} as oob,
   sqrt(greatest(0, (c * (f_price - mp) * (f_price - mp) - 2 * b * (f_price - mp) * (f_var - mv) + a * (f_var - mv) * (f_var - mv)) / (a * c - b * b))) as far
   from dec d cross join ra where delta_cx <> 0 and d.graph_id % 5 <> 0)"""


def _outlying(spark, sf_dir):
    d = fx.decisions(spark, sf_dir).where("delta_cx <> 0")
    val = written(d.where("graph_id % 5 = 0"), "validation")
    out = scaling.out_of_range(d.where("graph_id % 5 <> 0"), scaling.ranges(val, FEATURES), FEATURES)
    two = ["f_price", "f_var"]
    centre = val.agg(*[F.avg(F.col(f).cast("double")) for f in two]).first()
    return scaling.mahalanobis(out, two, list(centre), scaling.inverse_covariance(val, two))


@query("t06_t07_outlying", f"with {DEC}, {_OUT} select graph_id, cast(oob as int) as features_oob, round(far, 6) as mahalanobis from ob")
def outlying(spark, sf_dir):
    out = _outlying(spark, sf_dir).select("graph_id", F.col("features_oob").cast("int").alias("features_oob"), "mahalanobis")
    return _round(out, ["mahalanobis"])


@query("e18_label_free_report", f"""with {PRED}, {_ATC}, {_OUT}, r as (select ta.source_dataset, ta.n_vertices, graph_id, avg(pred) filter (where model = 0) as lead, cast(min(pred) <> max(pred) as int) as s, avg(conf) as c, avg(cast(conf >= threshold as int)) as a,
  max(oob) as oob, max(far) as far from ta join ob using (graph_id) group by 1, 2, 3)
select source_dataset, n_vertices, count(*) as n_graphs, round(100 * avg(lead), 6) as pct_predicted_matching, round(avg(s), 6) as ensemble_disagreement, round(avg(c), 6) as mean_confidence,
  round(avg(a), 6) as atc_estimated_accuracy, round(avg(oob), 6) as mean_features_oob, round(avg(far), 6) as mean_mahalanobis from r group by 1, 2""")
def label_free_report(spark, sf_dir):
    val, target = _val_and_target(spark, sf_dir)
    th = labelfree.confidence_thresholds(val, ["model"])
    extra = written(_outlying(spark, sf_dir).select("graph_id", "features_oob", "mahalanobis"), "outlying")
    out = labelfree.report(target.join(extra, "graph_id"), th, ["source_dataset", "n_vertices"], "graph_id", 0, ["features_oob", "mahalanobis"])
    return _round(out, ["pct_predicted_matching", "ensemble_disagreement", "mean_confidence", "atc_estimated_accuracy", "mean_features_oob", "mean_mahalanobis"])


@query("e19_per_model_predictions", f"""with {PRED}, d as (select source_dataset, n_vertices, graph_id, cast(min(pred) <> max(pred) as int) as s from pr where seed = 0 group by 1, 2, 3),
 x as (select source_dataset, n_vertices, avg(s) as s from d group by 1, 2)
select p.source_dataset, p.n_vertices, round(100 * avg(pred) filter (where model = 0), 1) as "0", round(100 * avg(pred) filter (where model = 1), 1) as "1", round(100 * avg(pred) filter (where model = 2), 1) as "2",
  round(max(x.s), 6) as ensemble_disagreement from pr p join x using (source_dataset, n_vertices) where seed = 0 group by 1, 2""")
def per_model(spark, sf_dir):
    p = fx.predictions(spark, sf_dir).where("seed = 0")
    return _round(labelfree.per_model(p, ["source_dataset", "n_vertices"], [0, 1, 2], "graph_id"), ["ensemble_disagreement"])


# --- neighbours --------------------------------------------------------------

G = "source_dataset, n_vertices"
_Z = ", ".join(f"({f} - avg({f}) over w) / case when min({f}) over w = max({f}) over w then 1 else stddev_pop({f}) over w end as {f}_z" for f in FEATURES)
_PAIRS = f"""z as (select graph_id, {G}, y, {_Z} from d0 window w as (partition by {G})),
 pa as (select a.source_dataset, a.n_vertices, a.graph_id as qid, a.y as qy, b.graph_id as nid, b.y as ny,
   round(sqrt({' + '.join(f'(a.{f}_z - b.{f}_z) * (a.{f}_z - b.{f}_z)' for f in FEATURES)}), 9) as dist
   from z a join z b on a.source_dataset = b.source_dataset and a.n_vertices = b.n_vertices and a.graph_id <> b.graph_id),
 nn as (select * from (select *, row_number() over (partition by qid order by dist, nid) as rank from pa) t where rank <= 10)"""
KEYS = ["source_dataset", "n_vertices"]


def _points(spark, sf_dir):
    z = scaling.standardize(labelled_decisions(spark, sf_dir), FEATURES, KEYS)
    return written(z.select(*KEYS, "graph_id", "y", neighbors.feature_point([f"{f}_z" for f in FEATURES]).alias("__x")), "points")


@query("j08_nearest_neighbours", f"with {LABELLED}, {_PAIRS} select {G}, qid, rank, nid, round(dist, 6) as dist, ny::bigint as ny from nn")
def nearest_neighbours(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _round(neighbors.nearest(p, p, KEYS, "graph_id", F.col("__x"), 10, skip_self=True), ["dist"])


@query("j09_nearest_by_class", f"""with {LABELLED}, {_PAIRS} select {G}, qid, round(min(dist) filter (where ny = 1), 6) as same, round(min(dist) filter (where ny = 0), 6) as opposite from pa where qy = 1 group by 1, 2, 3""")
def nearest_by_class(spark, sf_dir):
    return _round(neighbors.class_gaps(_points(spark, sf_dir), KEYS, "graph_id"), ["same", "opposite"])


_OVERLAP = f"""with {LABELLED}, {_PAIRS}, si as (select {G}, count(*) as n_graphs, count(*) filter (where y = 1) as n_pos, count(*) filter (where y = 0) as n_neg from d0 group by 1, 2),
 pp as (select {G}, qid, qy, avg(cast(ny <> qy as int)) as dis, max(case when rank = 1 then cast(ny = 0 as int) end) as fneg from nn group by 1, 2, 3, 4),
 ne as (select {G}, avg(dis) filter (where qy = 1) as knn_disagree_pos, avg(dis) filter (where qy = 0) as knn_disagree_neg, avg(fneg) filter (where qy = 1) as pos_nn_is_neg from pp group by 1, 2),
 ga as (select {G}, qid, min(dist) filter (where ny = 1) as same, min(dist) filter (where ny = 0) as opp from pa where qy = 1 group by 1, 2, 3),
 ge as (select {G}, avg(cast(opp = 0 as int)) as collide_frac, avg(cast(opp = 0 or same / nullif(opp, 0) >= 1 as int)) filter (where same is not null) as embedded_frac, quantile_cont(same / nullif(opp, 0), 0.5) as sep_ratio_med from ga group by 1, 2)
select si.*, cast(n_pos = 0 or n_neg = 0 as int) as single_class, {', '.join(f'case when n_pos > 0 and n_neg > 0 then round({c}, 6) end as {c}' for c in ('knn_disagree_pos', 'knn_disagree_neg', 'pos_nn_is_neg', 'collide_frac', 'embedded_frac', 'sep_ratio_med'))}
from si left join ne using ({G}) left join ge using ({G})"""


@query("e20_overlap_report", _OVERLAP)
def overlap(spark, sf_dir):
    out = neighbors.overlap_report(labelled_decisions(spark, sf_dir), KEYS, "graph_id", FEATURES, 10)
    return _round(out, ["knn_disagree_pos", "knn_disagree_neg", "pos_nn_is_neg", "collide_frac", "embedded_frac", "sep_ratio_med"])


# The graphs on 16 vertices are of one class only.
@query("e20_overlap_of_one_class", _OVERLAP.replace(", z as (", ", d1 as (select * from d0 where not (n_vertices = 16 and y = 1)), z as (").replace("from d0 window", "from d1 window").replace("from d0 group", "from d1 group"))
def overlap_one_class(spark, sf_dir):
    d = labelled_decisions(spark, sf_dir).where("not (n_vertices = 16 and y = 1)")
    out = neighbors.overlap_report(d, KEYS, "graph_id", FEATURES, 10)
    return _round(out, ["knn_disagree_pos", "knn_disagree_neg", "pos_nn_is_neg", "collide_frac", "embedded_frac", "sep_ratio_med"])


_EMB_D = "round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::double - b.embedding[i]::double) * (a.embedding[i]::double - b.embedding[i]::double)))), 9)"


@query("j08_nearest_embeddings", f"""with p as (select a.vec_id as qid, b.vec_id as nid, b.label::bigint as ny, {_EMB_D} as dist from embeddings a join embeddings b on a.vec_id <> b.vec_id)
select qid, rank, nid, ny, round(dist, 6) as dist from (select *, row_number() over (partition by qid order by dist, nid) as rank from p) t where rank <= 5""")
def nearest_embeddings(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    x = F.col("embedding").cast("array<double>")
    return _round(neighbors.nearest(e, e, [], "vec_id", x, 5, y="label", skip_self=True), ["dist"])


_KNN = f"""{_SPLIT42}, mo as (select {', '.join(f'avg({f}) as m_{f}, stddev_pop({f}) as s_{f}' for f in FEATURES)} from sp where split = 'train'),
 zz as (select graph_id, y, split, {', '.join(f'({f} - m_{f}) / s_{f} as {f}_z' for f in FEATURES)} from sp cross join mo),
 pq as (select a.graph_id as qid, b.graph_id as nid, b.y as ny, round(sqrt({' + '.join(f'(a.{f}_z - b.{f}_z) * (a.{f}_z - b.{f}_z)' for f in FEATURES)}), 9) as dist
   from zz a join zz b on a.split = 'test' and b.split = 'train'),
 nk as (select * from (select *, row_number() over (partition by qid order by dist, nid) as rank, min(dist) over (partition by qid) as closest from pq) t where rank <= 5)"""


def _knn(spark, sf_dir, weighted, p=2):
    sp = _split42(spark, sf_dir)
    z = written(scaling.apply_moments(sp, scaling.moments(sp.where("split = 'train'"), FEATURES), FEATURES), "points")
    point = neighbors.feature_point([f"{f}_z" for f in FEATURES])
    out = neighbors.knn_vote(z.where("split = 'test'"), z.where("split = 'train'"), [], "graph_id", point, 5, weighted, p)
    return _round(out, ["score"])


@query("m05_knn_classifier", f"with {LABELLED}, {_KNN} select qid, round(avg(ny), 6) as score, cast(avg(ny) > 0.5 as int) as pred from nk group by qid")
def knn_classifier(spark, sf_dir):
    return _knn(spark, sf_dir, False)


@query("m05_knn_classifier_weighted", f"""with {LABELLED}, {_KNN}, w as (select qid, ny, case when closest = 0 then cast(dist = 0 as int) else 1.0::double / dist end as w from nk)
select qid, round(sum(w * ny) / sum(w), 6) as score, cast(sum(w * ny) / sum(w) > 0.5 as int) as pred from w group by qid""")
def knn_weighted(spark, sf_dir):
    return _knn(spark, sf_dir, True)


_KNN1 = _KNN.replace(f"sqrt({' + '.join(f'(a.{f}_z - b.{f}_z) * (a.{f}_z - b.{f}_z)' for f in FEATURES)})", f"({' + '.join(f'abs(a.{f}_z - b.{f}_z)' for f in FEATURES)})")


@query("m05_knn_manhattan", f"with {LABELLED}, {_KNN1} select qid, round(avg(ny), 6) as score, cast(avg(ny) > 0.5 as int) as pred from nk group by qid")
def knn_manhattan(spark, sf_dir):
    return _knn(spark, sf_dir, False, 1)


# --- linear models -----------------------------------------------------------

# A stored model: coefficient i is 0.3 * (-1)^i * (i + 1), fitted scaling from the data itself.
_B = {f: (0.3 * (i + 1) * (-1 if i % 2 else 1)) for i, f in enumerate(FEATURES)}
_LIN = " + ".join(f"({b!r}::double) * ({f} - m_{f}) / s_{f}" for f, b in _B.items())
_MO = f"""mo as (select source_dataset, {', '.join(f'avg({f}) as m_{f}, stddev_pop({f}) as s_{f}' for f in FEATURES)} from d0 group by 1)"""


def _coefficients(spark, sf_dir):
    d = labelled_decisions(spark, sf_dir)
    m = reports.long_features(d, ["source_dataset"], FEATURES).groupBy("source_dataset", "feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("scale"))
    coef = F.create_map(*[x for f, b in _B.items() for x in (F.lit(f), F.lit(b))])[F.col("feature")]
    rows = m.select("source_dataset", "feature", coef.alias("coef"), "mean", "scale")
    icpt = m.select("source_dataset").distinct().select(
        "source_dataset", F.lit(linear.INTERCEPT).alias("feature"), F.lit(0.1).alias("coef"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("scale"))
    return rows.unionByName(icpt)


@query("e24_stored_linear_model", f"with {LABELLED}, {_MO} select graph_id, round(1 / (1 + exp(-(0.1::double + {_LIN}))), 6) as score from d0 join mo using (source_dataset)")
def stored_linear(spark, sf_dir):
    out = linear.apply_linear(labelled_decisions(spark, sf_dir), _coefficients(spark, sf_dir), FEATURES, ["source_dataset"])
    return _round(out.select("graph_id", "score"), ["score"])


@query("e23_decision_grid", f"""with {LABELLED}, {_MO}, me as (select source_dataset, {', '.join(f'quantile_cont({f}, 0.5) as {f}' for f in FEATURES)}, min(f_price) as lo_p, max(f_price) as hi_p, min(f_var) as lo_v, max(f_var) as hi_v from d0 group by 1),
 gr as (select me.* exclude (f_price, f_var), i.i, j.i as j, lo_p + (hi_p - lo_p) * i.i / 20 as f_price, lo_v + (hi_v - lo_v) * j.i / 20 as f_var from me cross join range(21) i(i) cross join range(21) j(i))
select source_dataset, cast(i as int) as i, cast(j as int) as j, round(f_price, 6) as f_price, round(f_var, 6) as f_var, round(1 / (1 + exp(-(0.1::double + {_LIN}))), 6) as score from gr join mo using (source_dataset)""")
def decision_grid(spark, sf_dir):
    d = labelled_decisions(spark, sf_dir)
    r = d.groupBy("source_dataset").agg(*[e for f in ("f_price", "f_var") for e in (F.min(f).alias(f"__lo_{f}"), F.max(f).alias(f"__hi_{f}"))])
    med = reports.medians(d, ["source_dataset"], FEATURES)
    out = linear.decision_grid(med, r, _coefficients(spark, sf_dir), FEATURES, "f_price", "f_var", 21, ["source_dataset"])
    return _round(out, ["f_price", "f_var", "score"])


def _perm_sql() -> str:
    lin = " + ".join(f"({b!r}::double) * (case when permuted = '{f}' then o_{f} else {f} end - m_{f}) / s_{f}" for f, b in _B.items())
    return f"""{_MO}, po as (select *, row_number() over (order by {mix('graph_id', '0')}, graph_id) as pos from d0),
 dn as (select r.i as rep, {', '.join(f'{f} as o_{f}' for f in FEATURES)}, row_number() over (partition by r.i order by {mix('graph_id', 'r.i * 31 + 1')}, graph_id) as pos from d0 cross join range(3) r(i)),
 cp as (select po.*, dn.rep, dn.pos as p2, {', '.join('o_' + f for f in FEATURES)}, permuted from po join dn on po.pos = dn.pos cross join (values {', '.join(f"('{f}')" for f in FEATURES)}) v(permuted)),
 al as (select permuted, rep, y, cast({lin} + 0.1::double >= 0 as int) as pred from cp join mo using (source_dataset)
   union all select '(none)', 0, y, cast({_LIN} + 0.1::double >= 0 as int) from d0 join mo using (source_dataset)),
 cm as (select permuted, rep, count(*) filter (where y = 0 and pred = 0)::double as tn, count(*) filter (where y = 0 and pred = 1)::double as fp, count(*) filter (where y = 1 and pred = 0)::double as fn,
   count(*) filter (where y = 1 and pred = 1)::double as tp from al group by 1, 2),
 mc as (select permuted, rep, coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0) as mcc from cm),
 im as (select permuted as feature, avg((select mcc from mc where permuted = '(none)') - mcc) as importance, stddev_pop((select mcc from mc where permuted = '(none)') - mcc) as importance_std from mc where permuted <> '(none)' group by 1)"""


def _linear_predict(coefficients):
    return lambda frame: linear.apply_linear(frame, coefficients, FEATURES, ["source_dataset"]).withColumn(
        "pred", (F.col("score") >= 0.5).cast("int"))


@query("e21_permutation_importance", f"""with {LABELLED}, {_perm_sql()} select feature, round(importance, 6) + 0 as importance, round(importance_std, 6) as importance_std,
  round(greatest(importance, 0) / (select case when sum(greatest(importance, 0)) > 0 then sum(greatest(importance, 0)) else 1 end from im), 6) as share from im""")
def permutation_importance(spark, sf_dir):
    imp = linear.permutation_importance(labelled_decisions(spark, sf_dir), FEATURES, "graph_id", _linear_predict(_coefficients(spark, sf_dir)), 3)
    return _round(linear.normalised(imp), ["importance", "importance_std", "share"])


def _seeds_sql() -> str:
    lin = " + ".join(f"({b!r}::double) * (case when permuted = '{f}' then o_{f} else {f} end - m_{f}) / s_{f}" for f, b in _B.items())
    return f"""sx as (select d0.*, s.i as seed, {mix('graph_id', 's.i')} % 5 as part from d0 cross join range(5) s(i)),
 mo as (select seed, {', '.join(f'avg({f}) as m_{f}, stddev_pop({f}) as s_{f}' for f in FEATURES)} from sx where part <> 0 group by 1),
 te as (select * exclude (part) from sx where part = 0),
 po as (select *, row_number() over (partition by seed order by {mix('graph_id', '0')}, graph_id) as pos from te),
 dn as (select r.i as rep, seed, {', '.join(f'{f} as o_{f}' for f in FEATURES)}, row_number() over (partition by seed, r.i order by {mix('graph_id', 'r.i * 31 + 1')}, graph_id) as pos from te cross join range(3) r(i)),
 cp as (select po.*, dn.rep, {', '.join('o_' + f for f in FEATURES)}, permuted from po join dn on po.seed = dn.seed and po.pos = dn.pos cross join (values {', '.join(f"('{f}')" for f in FEATURES)}) v(permuted)),
 al as (select seed, permuted, rep, y, cast({lin} + 0.1::double >= 0 as int) as pred from cp join mo using (seed)
   union all select seed, '(none)', 0, y, cast({_LIN} + 0.1::double >= 0 as int) from te join mo using (seed)),
 cm as (select seed, permuted, rep, count(*) filter (where y = 0 and pred = 0)::double as tn, count(*) filter (where y = 0 and pred = 1)::double as fp, count(*) filter (where y = 1 and pred = 0)::double as fn,
   count(*) filter (where y = 1 and pred = 1)::double as tp from al group by 1, 2, 3),
 mc as (select seed, permuted, rep, coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0) as mcc from cm),
 own as (select a.seed, a.permuted as feature, avg(b.mcc - a.mcc) as m from mc a join mc b on b.seed = a.seed and b.permuted = '(none)' where a.permuted <> '(none)' group by 1, 2)"""


@query("e21_importance_over_seeds", f"""with {LABELLED}, {_seeds_sql()} select feature, round(avg(m), 6) + 0 as importance, round(stddev_pop(m), 6) + 0 as importance_std, count(*) as n_seeds from own group by 1""")
def importance_over_seeds(spark, sf_dir):
    rows = labelled_decisions(spark, sf_dir).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(4))))
    rows = written(rows.withColumn("part", scalars.mix("graph_id", F.col("seed")) % 5), "seeds")
    m = reports.long_features(rows.where("part <> 0"), ["seed"], FEATURES).groupBy("seed", "feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("scale"))
    coef = F.create_map(*[x for f, b in _B.items() for x in (F.lit(f), F.lit(b))])[F.col("feature")]
    fitted = m.select("seed", "feature", coef.alias("coef"), "mean", "scale").unionByName(m.select("seed").distinct().select(
        "seed", F.lit(linear.INTERCEPT).alias("feature"), F.lit(0.1).alias("coef"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("scale")))
    fitted = written(fitted, "fitted")

    def predict(frame):
        return linear.apply_linear(frame, fitted, FEATURES, ["seed"]).withColumn("pred", (F.col("score") >= 0.5).cast("int"))

    out = linear.importance_over_seeds(rows.where("part = 0").drop("part"), FEATURES, "graph_id", predict)
    return _round(out, ["importance", "importance_std"])


@query("w07_interleaved_rankings", f"""with {DEC}, im as ({' union all '.join(f"select source_dataset as dataset, '{f}' as feature, round(abs(corr({f}, delta_cx)), 9) as importance from dec group by 1" for f in FEATURES)}),
 r as (select *, row_number() over (partition by dataset order by importance desc, feature) as place, case dataset when 'a' then 0 else 1 end as turn from im),
 f as (select feature, min(place * 10 + turn) as pos from r group by 1)
select cast(row_number() over (order by pos) as int) as position, feature from f order by pos limit 4""")
def interleaved(spark, sf_dir):
    d = fx.decisions(spark, sf_dir)
    imp = reports.correlation(d, [*FEATURES, "delta_cx"], ["source_dataset"]).where("b = 'delta_cx' and a <> 'delta_cx'").select(
        F.col("source_dataset").alias("dataset"), F.col("a").alias("feature"), F.round(F.abs("r"), 9).alias("importance"))
    return reports.interleave_rankings(imp, {"a": 0, "b": 1}, 4)
