"""Queries that fit models on the decision table."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog.prep import LABELLED, _split42, _SPLIT42, labelled_decisions
from graphloom.catalog.registry import query
from graphloom.catalog.sqltext import FEATURES
from graphloom.operators import metrics, prep, sampling, scaling
from graphloom.plans import experiments, learners
from graphloom.session import written
from graphloom.sources import fixtures as fx


def _round(df, names, digits=6):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})


def _parts(spark, sf_dir):
    sp = written(_split42(spark, sf_dir), "split")
    return sp.where("split = 'train'"), sp.where("split = 'test'")


def _register(name: str, model: str):
    @query(name)
    def run(spark, sf_dir):
        train, test = _parts(spark, sf_dir)
        return _round(experiments.fit_and_score(train, test, FEATURES, model), ["score"])


for _name, _model in (("m01_logistic", "logistic"), ("m03_tree_depth_3", "dtree_d3"), ("m04_rbf_machine", "svm_rbf"),
                      ("m06_network", "mlp_small"), ("m08_boosting", "grad_boost")):
    _register(_name, _model)


@query("m07_random_forest")
def random_forest(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    out = learners.forest()(learners.vectors(train, FEATURES), learners.vectors(test, FEATURES))
    return _round(out.select("graph_id", "score", "pred"), ["score"])


_LIK = {k: " + ".join([f"ln(n_{k} / nn::double)"] + [
    f"(-ln((v_{f}_{k} + top * 1e-9) * 2 * pi()) / 2 - ({f} - m_{f}_{k}) * ({f} - m_{f}_{k}) / ((v_{f}_{k} + top * 1e-9) * 2))" for f in FEATURES]) for k in (0, 1)}


@query("m02_naive_bayes", f"""with {LABELLED}, {_SPLIT42}, tr as (select * from sp where split = 'train'),
 mo as (select {', '.join(f'count(*) filter (where y = {k}) as n_{k}' for k in (0, 1))}, count(*) as nn, greatest({', '.join(f'var_pop({f})' for f in FEATURES)}) as top,
  {', '.join(f'avg({f}) filter (where y = {k}) as m_{f}_{k}, var_pop({f}) filter (where y = {k}) as v_{f}_{k}' for f in FEATURES for k in (0, 1))} from tr)
select graph_id, round(1 / (1 + exp(-(({_LIK[1]}) - ({_LIK[0]})))), 6) as score, cast(({_LIK[1]}) > ({_LIK[0]}) as int) as pred from sp cross join mo where split = 'test'""")
def naive_bayes(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    return _round(learners.naive_bayes(train, test, FEATURES).select("graph_id", "score", "pred"), ["score"])


_STUMP = f"""{_SPLIT42}, tr as (select * from sp where split = 'train'),
 lo as (unpivot (select y, {', '.join(f'{f}::double as {f}' for f in FEATURES)} from tr) on {', '.join(FEATURES)} into name feature value value),
 ct as (select feature, value, sum(y)::double as pos, sum(1 - y)::double as neg from lo group by 1, 2),
 ru as (select *, sum(pos) over w as lp, sum(neg) over w as ln, sum(pos) over (partition by feature) as tp, sum(neg) over (partition by feature) as tn, lead(value) over (partition by feature order by value) as nx
   from ct window w as (partition by feature order by value)),
 gi as (select *, round((2 * lp * ln / (lp + ln) + 2 * (tp - lp) * (tn - ln) / (tp - lp + tn - ln)) / (tp + tn), 12) as impurity from ru where nx is not null),
 st as (select feature, (value + nx) / 2 as threshold, cast(lp > ln as int) as left_class, cast(tp - lp > tn - ln as int) as right_class, impurity from gi
   order by impurity, case feature {' '.join(f"when '{f}' then {i}" for i, f in enumerate(FEATURES))} end, value limit 1)"""


@query("m03_exact_stump", f"""with {LABELLED}, {_STUMP} select graph_id, case when case feature {' '.join(f"when '{f}' then {f}" for f in FEATURES)} end <= threshold then left_class else right_class end as pred,
  round(threshold, 6) as threshold, feature from sp cross join st where split = 'test'""")
def exact_stump(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    fitted = written(learners.stump(train, FEATURES), "fitted")
    out = learners.apply_stump(test, fitted, FEATURES).select("graph_id", "pred")
    return out.crossJoin(F.broadcast(fitted.select(F.round("threshold", 6).alias("threshold"), "feature")))  # one row


@query("m09_weighted_logistic")
def weighted_logistic(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    scarce = train.where("y = 0 or graph_id % 20 = 1")
    weighted = scarce.join(sampling.class_weights(scarce).select("y", "weight"), "y")
    fitted = scaling.moments(weighted, FEATURES)
    out = learners.logistic(learners.vectors(weighted, FEATURES, fitted), learners.vectors(test, FEATURES, fitted))
    return _round(out.select("graph_id", "score", "pred"), ["score"])


@query("m09_undersampled_logistic")
def undersampled_logistic(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    even = written(sampling.balance_within(train.where("y = 0 or graph_id % 20 = 1"), "n_vertices", "y", "graph_id"), "even")
    return _round(experiments.fit_and_score(even, test, FEATURES, "logistic"), ["score"])


@query("m10_grid_search")
def grid_search(spark, sf_dir):
    train, _ = _parts(spark, sf_dir)
    scaled = written(learners.vectors(train, FEATURES, scaling.moments(train, FEATURES)).select("graph_id", "features", "y"), "scaled")
    rows = [(name, str(p), float(m)) for name in ("logistic", "naive_bayes") for p, m in learners.sweep(scaled, name)[1]]
    return _round(spark.createDataFrame(rows, "model string, params string, mcc double"), ["mcc"])


@query("m11_training_curve")
def training_curve(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    fitted = scaling.moments(train, FEATURES)
    tr, va = (written(learners.vectors(x, FEATURES, fitted).select("y", "delta_cx", "features"), "curve") for x in (train, test))
    return _round(learners.training_curve(tr, va, 20), metrics.METRICS)


@query("m12_ensemble_report")
def ensemble_report(spark, sf_dir):
    features, labels = fx.decision_features(spark, sf_dir), fx.decision_labels(spark, sf_dir)
    labelled = sampling.label(prep.labelled(features, labels, ["delta_cx"]))
    out = experiments.ensemble_report(labelled, prep.unlabelled(features, labels), FEATURES,
                                      ["logistic", "dtree_d2", "svm_rbf", "rand_forest", "grad_boost"], ["source_dataset", "n_vertices"])
    return _round(out, [c for c in out.columns if c not in ("source_dataset", "n_vertices", "n_graphs")])


@query("m13_e21_forest_importance")
def forest_importance(spark, sf_dir):
    return _round(experiments.forest_importance(labelled_decisions(spark, sf_dir), FEATURES, 5, 200), ["importance", "share"])


@query("e22_model_ladder")
def model_ladder(spark, sf_dir):
    return _round(experiments.ladder(labelled_decisions(spark, sf_dir), FEATURES, ["logistic", "dtree_d1", "dtree_d2", "dtree_d3"], [0, 1, 2, 3, 4]), ["mean", "std"])


@query("e22_drop_one")
def drop_one(spark, sf_dir):
    return _round(experiments.drop_one(labelled_decisions(spark, sf_dir), FEATURES, [0, 1, 2, 3, 4]), ["mean", "std", "drop"])


@query("e22_feature_sets")
def feature_sets(spark, sf_dir):
    sets = {"shape": ["f_size", "f_price"], "counts": ["f_items", "f_supp"], "full": FEATURES}
    return _round(experiments.feature_sets(labelled_decisions(spark, sf_dir), sets, "dtree_d2", [0, 1, 2, 3, 4]), ["mean", "std"])


@query("e22_family_transfer")
def family_transfer(spark, sf_dir):
    out = experiments.family_transfer(written(labelled_decisions(spark, sf_dir), "rows"), "source_dataset", [("a", "b"), ("b", "a")], FEATURES)
    return _round(out, metrics.METRICS)


@query("e22_per_size_models")
def per_size_models(spark, sf_dir):
    return _round(experiments.per_size(written(labelled_decisions(spark, sf_dir), "rows"), FEATURES, [0], "logistic"), ["mean", "std"])
