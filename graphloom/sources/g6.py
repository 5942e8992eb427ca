"""Graph text files: reading, checking, writing, run counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.graph6 import fault, graph_key, pack_text, to_text, vertex_count


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """`(g6)`: stripped lines of one or many text files, blank ones dropped."""
    return spark.read.text(path).select(F.trim("value").alias("g6")).where("g6 <> ''")


def write_lines(packed: DataFrame, path: str) -> None:
    """One line of graph text per packed row."""
    packed.select(to_text().alias("value")).write.text(path)


def checked(lines: DataFrame) -> DataFrame:
    """Adds n and `fault` (NULL where the line can be read). Nothing is dropped."""
    sized = lines.withColumn("n", vertex_count("g6"))
    return sized.withColumn("fault", fault("g6", "n"))


def readable(lines: DataFrame) -> DataFrame:
    """Lines that can be read, with n and the graph key."""
    return checked(lines).where("fault is null").drop("fault").withColumn("graph_id", graph_key("g6"))


def packed(lines: DataFrame) -> DataFrame:
    """Packed rows of all readable lines, one per line. Narrow."""
    return pack_text(readable(lines))


def distinct_texts(lines: DataFrame, seq: str) -> DataFrame:
    """One row per graph text with the number of copies and the first place of them.
    Copies are counted map-side first, so a text that fills a third of a file does
    not reach one task as that many rows."""
    return lines.groupBy("g6").agg(F.count("*").alias("copies"), F.min(seq).alias(seq))


def distinct_packed(lines: DataFrame) -> DataFrame:
    """`(graph_id, tri, n, copies)`: one packed row per readable graph text.

    Text is packed before the shuffle that merges copies: the words are smaller than
    the text. n comes out of the aggregation, which keeps Catalyst from moving later
    filters on computed columns back over the decoding and working that out twice."""
    return packed(lines).groupBy("graph_id", "tri").agg(F.max("n").alias("n"), F.count("*").alias("copies"))


def first_lines(lines: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n lines in a stated order."""
    return lines.orderBy(*order).limit(n)
