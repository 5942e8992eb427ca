"""Sampling, splitting, balancing and neighbours on text keys, as the engine makes them."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog import prep, scoring  # noqa: F401  (their SQL is repeated here)
from graphloom.catalog.registry import ORACLES, query
from graphloom.catalog.sqltext import FEATURES, mix
from graphloom.operators import neighbors, sampling
from graphloom.operators.scaling import standardize
from graphloom.session import written
from graphloom.sources import fixtures as fx

KEYS = ["source_dataset", "n_vertices"]


def _sql(sql: str) -> str:
    return sql.replace("p.p_partkey as graph_id", "substr(sha1(cast(p.p_partkey as varchar)), 1, 16) as graph_id")


def _decisions(spark, sf_dir):
    key = F.substring(F.sha1(F.col("graph_id").cast("string").cast("binary")), 1, 16)
    return fx.decisions(spark, sf_dir).withColumn("graph_id", key)


def _labelled(spark, sf_dir):
    return sampling.label(_decisions(spark, sf_dir))


@query("k01_sample_text_keys", _sql(ORACLES["p11_seeded_sample"]))
def sample(spark, sf_dir):
    return sampling.sample_rows(_decisions(spark, sf_dir).select("graph_id", "n_vertices"), 300, "graph_id", 7)


@query("k02_balance_text_keys", _sql(f"""with {prep.LABELLED},
c as (select n_vertices, least(count(*) filter (where y = 1), count(*) filter (where y = 0)) as take from d0 group by 1),
r as (select *, row_number() over (partition by n_vertices, y order by {mix('graph_id')}, graph_id) as rk from d0)
select graph_id, n_vertices, y from r join c using (n_vertices) where rk <= take"""))
def balance(spark, sf_dir):
    return sampling.balance_within(_labelled(spark, sf_dir), "n_vertices", "y", "graph_id").select("graph_id", "n_vertices", "y")


@query("k03_split_text_keys", _sql(ORACLES["w02_stratified_split"]))
def split(spark, sf_dir):
    d = _labelled(spark, sf_dir).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))))
    return sampling.split_three(d, "graph_id", ["n_vertices", "y"], F.col("seed"), ["seed"]).select("graph_id", "seed", "split")


@query("k04_three_tier_text_keys", _sql(ORACLES["w03_three_tier_split"]))
def tiers(spark, sf_dir):
    return sampling.split_three_tiers(_labelled(spark, sf_dir), "graph_id", "n_vertices", "y").select("graph_id", "split")


@query("k05_two_way_text_keys", _sql(ORACLES["w04_two_way_split"]))
def two_way(spark, sf_dir):
    return sampling.split_two(_labelled(spark, sf_dir), "graph_id", ["n_vertices", "y"], 42).select("graph_id", "split")


@query("k06_folds_text_keys", _sql(ORACLES["m10_folds"]))
def folds(spark, sf_dir):
    return sampling.folds(_labelled(spark, sf_dir), "graph_id", ["y"]).select("graph_id", "fold")


@query("k07_neighbours_text_keys", _sql(ORACLES["j08_nearest_neighbours"]))
def nearest(spark, sf_dir):
    z = standardize(_labelled(spark, sf_dir), FEATURES, KEYS).withColumn("__x", neighbors.feature_point([f"{f}_z" for f in FEATURES]))
    z = written(z.select(*KEYS, "graph_id", "y", "__x"), "points")
    near = neighbors.nearest(z, z, KEYS, "graph_id", F.col("__x"), 10, skip_self=True)
    return near.withColumn("dist", F.round("dist", 6))


@query("k08_overlap_text_keys", _sql(ORACLES["e20_overlap_report"]))
def overlap(spark, sf_dir):
    out = neighbors.overlap_report(_labelled(spark, sf_dir), KEYS, "graph_id", FEATURES, 10)
    return out.withColumns({c: F.round(c, 6) for c in ("knn_disagree_pos", "knn_disagree_neg", "pos_nn_is_neg", "collide_frac", "embedded_frac", "sep_ratio_med")})
