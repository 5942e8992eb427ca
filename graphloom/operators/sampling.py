"""Class balancing, seeded samples, stratified splits and folds.

All of them pick by position in a hash order of the key. Rows are counted by slots of
the hash; only those of a slot where a part ends are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import mix
from graphloom.operators.ordering import label_by_hash, rank_by_hash
from graphloom.session import written


def label(df: DataFrame, delta: str = "delta_cx") -> DataFrame:
    """Drop ties and add y = 1 where matching is cheaper."""
    return df.where(F.col(delta) != 0).withColumn("y", (F.col(delta) > 0).cast("int"))


def balance_within(df: DataFrame, group: str, y: str, key: str, seed: int = 0) -> DataFrame:
    """Equally many rows of both classes within each group: the smaller count of the
    two, taken in hash order. Groups with one class give no rows."""
    counts = df.groupBy(group).agg(
        F.least(F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).alias("__take")
    )
    kind = df.schema[y].dataType
    limits = written(counts.select(group, F.explode(F.array(F.lit(0).cast(kind), F.lit(1).cast(kind))).alias(y), "__take"), "takes")
    taken = label_by_hash(df, [group, y], mix(key, seed), key, lambda rank, _: rank <= F.col("__take"), "__in", limits)
    return taken.where("__in").drop("__in")


def sample_rows(df: DataFrame, size: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly `size` rows (or all, if fewer), the first in hash order. What is ranked
    are the rows of one hash value in a million: where the sample ends."""
    taken = label_by_hash(df, [], mix(key, seed), key, lambda rank, _: rank <= size, "__in", widths=(1024, 1))
    return taken.where("__in").drop("__in")


def stratum(df: DataFrame, parts: list[str], name: str = "stratum") -> DataFrame:
    return df.withColumn(name, F.concat_ws("_", *[F.col(p).cast("string") for p in parts]))


def _fifth(c: Column) -> Column:
    """A fifth of a count, halves rounded up."""
    return F.floor((c * 2 + 5) / 10)


def _split_by(df: DataFrame, keys: list[str], key: str, seed: Column | int) -> DataFrame:
    def part(rank: Column, size: Column) -> Column:
        test = _fifth(size)
        return F.when(rank <= test, "test").when(rank <= test + _fifth(size - test), "val").otherwise("train")

    return label_by_hash(df, keys, mix(key, seed), key, part, "split")


def split_three(df: DataFrame, key: str, parts: list[str], seed: Column | int = 0, within: list[str] | None = None) -> DataFrame:
    """Adds `split`: about 64 / 16 / 20 per stratum of `parts`. Where some stratum has
    a single row the whole set is split without strata."""
    within = within or []
    named = stratum(df, parts, "__stratum")
    sizes = named.groupBy(*within, "__stratum").agg(F.count("*").alias("__c"))
    if within:
        small = sizes.groupBy(*within).agg(F.min("__c").alias("__least"))
        named = named.join(written(small, "sizes"), within)  # one row per group, its size known to the planner
        named = named.withColumn("__stratum", F.when(F.col("__least") >= 2, F.col("__stratum")).otherwise("all")).drop("__least")
    elif _least(sizes) < 2:
        named = named.withColumn("__stratum", F.lit("all"))
    return _split_by(named, [*within, "__stratum"], key, seed).drop("__stratum")


def _least(sizes: DataFrame) -> int:
    """Rows of the smallest stratum: one number."""
    return sizes.agg(F.min("__c")).first()[0] or 0


def split_three_tiers(df: DataFrame, key: str, size: str, y: str, seed: int = 0) -> DataFrame:
    """As above with three tiers: (size, class) if each stratum has two rows, else
    class if each class has four, else none; the second cut goes by class alone."""
    named = stratum(df, [size, y], "__stratum")
    if _least(named.groupBy("__stratum").agg(F.count("*").alias("__c"))) >= 2:
        first = F.col("__stratum")
    elif _least(df.groupBy(y).agg(F.count("*").alias("__c"))) >= 4:
        first = F.concat(F.lit("y"), F.col(y).cast("string"))
    else:
        first = F.lit("all")
    named = named.withColumn("__first", first)
    cut = label_by_hash(named, ["__first"], mix(key, seed), key, lambda rank, n: rank <= _fifth(n), "__test")
    cut = written(cut, "cut")  # read for both parts below
    dev = cut.where(~F.col("__test")).withColumn(
        "__second", F.when(F.col("__first") == "all", "all").otherwise(F.col(y).cast("string"))
    )
    dev = label_by_hash(dev, ["__second"], mix(key, seed + 1), key, lambda rank, n: F.when(rank <= _fifth(n), "val").otherwise("train"), "split")
    test = cut.where("__test").withColumn("split", F.lit("test"))
    out = [c for c in df.columns] + ["split"]
    return dev.select(*out).unionByName(test.select(*out))


def split_two(df: DataFrame, key: str, strata: list[str], seed: Column | int = 0) -> DataFrame:
    """Adds `split`: 80 / 20 per stratum, `train` and `test`."""
    return label_by_hash(df, strata, mix(key, seed), key, lambda rank, n: F.when(rank <= _fifth(n), "test").otherwise("train"), "split")


def folds(df: DataFrame, key: str, strata: list[str], k: int = 5, seed: int = 0) -> DataFrame:
    """Adds `fold` 0..k-1, even within each stratum."""
    ranked = rank_by_hash(df, strata, mix(key, seed), key, "__rank")
    return ranked.withColumn("fold", F.pmod(F.col("__rank"), F.lit(k)).cast("int")).drop("__rank")


def class_weights(df: DataFrame, y: str = "y", keys: list[str] | None = None) -> DataFrame:
    """Rows and weight N / (2 N_y) of each class."""
    keys = keys or []
    counts = df.groupBy(*keys, y).agg(F.count("*").alias("n_class"))
    if keys:
        total = counts.groupBy(*keys).agg(F.sum("n_class").alias("__n"))
        both = counts.join(total, keys)
    else:
        both = counts.crossJoin(F.broadcast(counts.agg(F.sum("n_class").alias("__n"))))  # one row
    return both.select(*keys, y, "n_class", (F.col("__n") / (F.col("n_class") * 2)).alias("weight"))
