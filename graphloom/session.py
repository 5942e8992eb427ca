"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphloom")
        .config("spark.driver.memory", os.environ.get("GRAPHLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: what the cluster names in
    spark.checkpoint.dir, or the context's own checkpoint folder. Only on one machine
    (a master of local threads) is a temporary folder made and remembered for the
    session; elsewhere a missing folder is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    made = getattr(context, "_graphloom_scratch", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context._graphloom_scratch = made
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has written."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df, *keys: str):
    """Rows dealt out over all cores by key, before work that is heavy per row. The
    number is given outright: AQE would merge partitions by their few bytes."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


#: Rows of a task where partitions are made by the size of a table.
TASK_ROWS = 500_000


def dealt(df, rows: int, *keys: str):
    """df dealt out by keys for about TASK_ROWS of its `rows` in a task: what a task sorts
    or groups doesn't grow with the table, its number of tasks does."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-rows // TASK_ROWS)), *keys)


def written(df, name: str = "stage", *parts: str):
    """The frame as a table in the shared folder, computed once, with a folder for each
    value of the columns `parts` (few values): who asks for one reads no other.

    For frames that a plan would otherwise repeat many times over. A lost executor
    costs the stages after the table and not those before it."""
    path = fresh_path(df.sparkSession, name)
    (df.write.partitionBy(*parts) if parts else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_in(table, *counters) -> dict[str, int]:
    """Counters over a table just written, 0 where there are no rows: a scan of the
    columns they name. A pyspark Observation would save it, but leaves an object in the
    session that can't be serialised, and fitted models with a training summary take
    the session along to the tasks."""
    return {name: value or 0 for name, value in table.agg(*counters).first().asDict().items()}
