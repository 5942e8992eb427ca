"""Featurising what is new: append in batches, or from a stream of text files.

The target is laid out by key: graph keys are digests, and a row lies in the folder
`depth=D/prefix=p...` of its first D hex digits. D is chosen when a row is written, from
the number of rows there are by then, so folders of every depth stay below ROWS_PER_PART
rows. A batch looks for its graphs only in the folders of its own prefixes, a few at each
depth, whatever the size of the target."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators import prep
from graphloom.plans.features import feature_table
from graphloom.session import written
from graphloom.sources import g6
from graphloom.sources.tables import FEATURE_SCHEMA

ROWS_PER_PART = 1_000_000
#: At most 16 ** MAX_DEPTH folders of a depth; beyond ROWS_PER_PART rows each, they grow.
MAX_DEPTH = 4
LAYOUT = [T.StructField("depth", T.IntegerType()), T.StructField("prefix", T.StringType())]
LINES = T.StructType([T.StructField("value", T.StringType())])


def _written_so_far(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def existing_table(spark: SparkSession, path: str, schema: T.StructType = FEATURE_SCHEMA) -> DataFrame:
    """The table written so far, empty if there is none."""
    return _written_so_far(spark, path, T.StructType([*schema, *LAYOUT])).drop("depth", "prefix")


def _depths(spark: SparkSession, path: str) -> list[int]:
    """The depths of the folders there are, as the file system lists them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(hadoop)] if files.exists(hadoop) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("depth="))


def _log(path: str) -> str:
    """One row (depth, n) per batch, beside the table. A batch missing here only makes
    later folders larger."""
    return path.rstrip("/") + ".batches"


def _depth(rows: int, rows_per_part: int) -> int:
    return min(MAX_DEPTH, max(0, ceil(log(max(1, rows) / rows_per_part, 16))))


def finished(spark: SparkSession, path: str, prefixes: list[str]) -> DataFrame:
    """(graph_id): what the folders of these prefixes (of MAX_DEPTH digits) hold."""
    schema = T.StructType([T.StructField("graph_id", T.StringType()), *LAYOUT])
    table = _written_so_far(spark, path, schema)
    wanted = []
    for depth in _depths(spark, path):
        some = sorted({prefix[:depth] for prefix in prefixes})
        among = "" if len(some) == 16**depth else " and prefix in (" + ", ".join(f"'p{p}'" for p in some) + ")"
        wanted.append(f"(depth = {depth}{among})")
    return table.where(" or ".join(wanted) or "false").select("graph_id")


def append_features(lines: DataFrame, path: str, with_gap: bool = True, rows_per_part: int = ROWS_PER_PART) -> None:
    """Featurise the graphs of `lines (g6)` that the table at `path` lacks, and append.
    The same lines given again add nothing, also after a batch of which only some rows
    were written: what is looked up are the rows themselves."""
    spark = lines.sparkSession
    key = F.substring("graph_id", 1, MAX_DEPTH).alias("key")
    counts = g6.readable(lines).groupBy(key).agg(F.count("*").alias("n")).collect()  # at most 16 ** MAX_DEPTH rows
    if not counts:
        return
    done = finished(spark, path, [r["key"] for r in counts])
    before = _written_so_far(spark, _log(path), T.StructType([T.StructField("n", T.LongType())])).agg(F.sum("n")).first()[0] or 0
    depth = _depth(before + sum(r["n"] for r in counts), rows_per_part)
    rows = written(feature_table(lines, done, with_gap), "new-features")
    placed = rows.withColumn("depth", F.lit(depth)).withColumn("prefix", F.concat(F.lit("p"), F.substring("graph_id", 1, depth)))
    placed.hint("rebalance", "prefix").write.mode("append").partitionBy("depth", "prefix").parquet(path)
    spark.createDataFrame([(depth, rows.count())], "depth int, n long").coalesce(1).write.mode("append").parquet(_log(path))


def stream_features(spark: SparkSession, source: str, target: str, checkpoint: str,
                    files_per_batch: int = 1000, with_gap: bool = True):
    """A query that featurises text files as they arrive in `source`.

    Each micro-batch goes through `append_features`: a batch that is repeated after a
    failure finds its graphs in the table and adds them no second time."""
    lines = spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_batch).text(source)
    clean = lines.select(F.trim("value").alias("g6")).where("g6 <> ''")

    def batch(df: DataFrame, _: int) -> None:
        append_features(df, target, with_gap)

    return clean.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh(table: DataFrame, computed, stamp: str, max_n: int, key: str = "graph_id") -> DataFrame:
    """Recompute columns of rows without a stamp, and stamp them. `computed(rows)`
    gives `(key, columns...)`; stamped rows and rows over the gate keep what they had."""
    todo = prep.not_refreshed(table, stamp, max_n)
    fresh = computed(todo).withColumn("__done", F.lit(True))
    new = [c for c in fresh.columns if c not in (key, "__done")]
    renamed = fresh.select(key, "__done", *[F.col(c).alias(f"__new_{c}") for c in new])
    joined = table.join(renamed, key, "left")
    done = F.coalesce(F.col("__done"), F.lit(False))
    out = [F.when(done, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
           for c in table.columns if c != stamp]
    return joined.select(*out, (done | F.coalesce(F.col(stamp), F.lit(False))).alias(stamp))
