"""Documents to training mix: five operators as stages, each on what the one before kept.

run(spark, sf_dir) applies STAGES in order to the documents table; each result is
written as Parquet in the shared folder and read again, so that a lost executor costs
one stage at most.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import budget_mix, decision_rules, decontaminate, line_windows, probminhash
from graphloom.llm.common import table
from graphloom.session import fresh_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rules or the learned decision list reject go."""
    rules = decision_rules.fit(docs, table(spark, sf_dir, "labels"))
    return decision_rules.judge(docs, rules).where("kept").select(*COLUMNS)


def line_dedup(spark, docs, sf_dir):
    """Lines of repeated three-line windows go, but for their first occurrence; texts
    left without a word go; n_chars is counted anew."""
    cut = line_windows.remove_repeated(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """One document of each class of near duplicates stays, that of the smallest doc_id."""
    return probminhash.one_of_each(docs).select(*COLUMNS)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a copy of a benchmark item, edited or not, go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixing(spark, docs, sf_dir):
    """What the mix takes of each document that is left."""
    return budget_mix.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
]

#: The learned stage has no SQL; tests/llm/test_pipeline.py checks the rows instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
