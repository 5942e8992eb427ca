"""Graphs, decisions and predictions derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import dealt

DECISION_FEATURES = ["f_size", "f_price", "f_items", "f_disc", "f_var", "f_supp"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(df: DataFrame, key: str, a, b) -> DataFrame:
    pairs = df.select(F.col(key).alias("graph_id"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    return pairs.where("a <> b").select("graph_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the dense 8-vertex graphs, one graph per part; may repeat a link."""
    li = table(spark, sf_dir, "lineitem")
    return _edges(li, "l_partkey", F.col("l_orderkey") % 8, (F.col("l_suppkey") + F.col("l_linenumber")) % 8)


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the sparse 8-vertex graphs, one graph per order; may repeat a link."""
    li = table(spark, sf_dir, "lineitem")
    return _edges(li, "l_orderkey", F.col("l_partkey") % 8, F.col("l_suppkey") % 8)


def supplier_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of 128-vertex graphs, one graph per supplier; may repeat a link."""
    li = table(spark, sf_dir, "lineitem")
    return _edges(li, "l_suppkey", F.col("l_orderkey") % 128, F.col("l_partkey") % 128)


def _distinct(links: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links once each, with the links of a graph in one task."""
    return dealt(links, table(spark, sf_dir, "lineitem").count(), "graph_id").distinct()


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct(part_links(spark, sf_dir), spark, sf_dir)


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct(order_links(spark, sf_dir), spark, sf_dir)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled decision per part: six features and two measured costs."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    quantity = F.col("l_quantity")
    flag = F.col("l_returnflag")
    count = F.count("*").cast("double")
    per_part = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("f_items"),
        # Whole-number sums with one division at the end: the same value whatever
        # the order in which partial sums are merged.
        (F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / (count * 100)).alias("f_disc"),
        ((count * F.sum(quantity * quantity) - F.sum(quantity) * F.sum(quantity)) / (count * count)).alias("f_var"),
        F.countDistinct("l_suppkey").alias("f_supp"),
        F.sum(F.when(flag == "A", quantity).otherwise(0)).cast("bigint").alias("cx_matching"),
        F.sum(F.when(flag == "R", quantity).otherwise(0)).cast("bigint").alias("cx_pauli"),
    )
    key = F.col("p_partkey")
    size = F.when(key % 4 == 0, 1).when(key % 4 == 1, 2).when(key % 4 == 2, 4).otherwise(8) * 8
    return part.join(per_part, key == F.col("l_partkey")).select(
        key.alias("graph_id"),
        size.cast("int").alias("n_vertices"),
        F.when(key % 3 == 0, "a").otherwise("b").alias("source_dataset"),
        F.col("p_size").alias("f_size"),
        F.col("p_retailprice").alias("f_price"),
        "f_items", "f_disc", "f_var", "f_supp", "cx_matching", "cx_pauli",
        (F.col("cx_pauli") - F.col("cx_matching")).alias("delta_cx"),
    )


def decision_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature side of the decisions, all graphs."""
    return decisions(spark, sf_dir).select("graph_id", "n_vertices", "source_dataset", *DECISION_FEATURES)


def decision_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label side; every fiftieth graph has not been labelled."""
    return decisions(spark, sf_dir).where("graph_id % 50 <> 0").select(
        "graph_id", "n_vertices", "cx_matching", "cx_pauli", "delta_cx"
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions of three models under five seeds, ties left out."""
    d = decisions(spark, sf_dir).where("delta_cx <> 0")
    grid = d.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn(
        "seed", F.explode(F.sequence(F.lit(0), F.lit(4)))
    )
    noise = ((F.col("graph_id") * 37 + F.col("seed") * 13 + F.col("model") * 7) % 101 - 50) / 25.0
    score = F.round(1 / (1 + F.exp(-(F.col("delta_cx") / 60.0 + noise))), 6)
    return grid.select(
        "graph_id", "n_vertices", "source_dataset", "delta_cx",
        (F.col("delta_cx") > 0).cast("int").alias("y"),
        "model", "seed", score.alias("score"),
    ).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
