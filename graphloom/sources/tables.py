"""Feature and label tables at rest, and the record of a run beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the tables.
FEATURE_SCHEMA = T.StructType([
    T.StructField("graph_id", T.StringType()), T.StructField("n_vertices", T.IntegerType()),
    T.StructField("edge_density", T.DoubleType()), T.StructField("is_bipartite", T.IntegerType()),
    T.StructField("is_tree", T.IntegerType()), T.StructField("triangle_count", T.LongType()),
    T.StructField("diameter", T.IntegerType()), T.StructField("min_degree", T.IntegerType()),
    T.StructField("max_degree", T.IntegerType()), T.StructField("avg_degree", T.DoubleType()),
    T.StructField("degree_variance", T.DoubleType()), T.StructField("is_regular", T.IntegerType()),
    T.StructField("avg_clustering", T.DoubleType()), T.StructField("spectral_gap", T.DoubleType()),
    T.StructField("max_matching_size", T.IntegerType()),
])
LABEL_SCHEMA = T.StructType([
    T.StructField("graph_id", T.StringType()), T.StructField("n_vertices", T.IntegerType()),
    *[T.StructField(c, T.LongType()) for c in
      ("cx_matching", "cx_pauli", "depth_matching", "depth_pauli", "delta_cx", "delta_depth")],
    T.StructField("labeling_time", T.DoubleType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, digits: int = 6) -> None:
    """Write with a header; doubles rounded, NaN and NULL left blank."""
    out = []
    for c in columns or df.columns:
        if isinstance(df.schema[c].dataType, T.DoubleType):
            out.append(F.round(F.when(~F.isnan(c), F.col(c)), digits).alias(c))
        else:
            out.append(F.col(c))
    df.select(*out).write.option("header", True).csv(path)


def write_table(df: DataFrame, path: str, by: str = "n_vertices") -> None:
    """Parquet partitioned by size, so that a size gate prunes files."""
    df.write.partitionBy(by).parquet(path)


def counters(df: DataFrame, outcome: str, stage: str) -> DataFrame:
    """`(stage, counter, value)` of a run from an outcome column with weights `copies`."""
    weight = F.sum("copies") if "copies" in df.columns else F.count("*")
    return df.groupBy(F.col(outcome).alias("counter")).agg(weight.alias("value")).select(
        F.lit(stage).alias("stage"), "counter", "value")


def counted(spark: SparkSession, stage: str, stats: dict[str, int]) -> DataFrame:
    """The same from counters of a pass."""
    return spark.createDataFrame([(stage, name, int(n or 0)) for name, n in stats.items()], "stage string, counter string, value bigint")


def write_manifest(counted: DataFrame, parameters: dict[str, str], path: str) -> None:
    """One JSON document with the parameters and the counters (a handful of rows)."""
    doc = counted.groupBy("stage").agg(F.map_from_entries(F.collect_list(F.struct("counter", "value"))).alias("stats"))
    given = [x for k, v in parameters.items() for x in (F.lit(k), F.lit(v))]
    doc.withColumn("parameters", F.create_map(*given)).coalesce(1).write.json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """`(stage, counter, value)` of a written document."""
    schema = "stage string, stats map<string,bigint>, parameters map<string,string>"
    return spark.read.schema(schema).json(path).select("stage", F.explode("stats").alias("counter", "value"))
