"""Ranks, running totals and exact quantiles of groups of any size.

A plain window over a group sorts the whole group in one task. Here a group is cut at
splitters, which are a sample of its own values: one value in CUT_ROWS, chosen by its
hash. So cuts hold about as many rows each, their number grows with the group, and values
that are close together spread as well as any others. Windows work inside one cut, and
the totals of the cuts before it are added. Splitters follow from the values alone, so a
lost and repeated task sees the same cuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import written

CUT = "__cut"
CUT_ROWS = 100_000  # rows in a cut, on average
STEP = 256  # splitters are looked up in two steps of about this many
ABOVE = 1024  # cuts are added up in two levels of this width
HASH_SLOT = 1024  # hash values in a slot of a histogram


def with_cuts(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df with the column CUT, which never decreases along `order` (ascending, nulls
    first) in a group. Groups without a chosen value are one cut."""
    made = df.withColumn("__order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    chosen = made.where(F.pmod(F.xxhash64("__order"), F.lit(CUT_ROWS)) == 0)
    splits = chosen.groupBy(*keys).agg(F.sort_array(F.collect_set("__order")).alias("__s"))
    splits = splits.withColumn("__coarse", F.expr(f"transform(filter(sequence(1, size(__s)), i -> i > 0 and i % {STEP} = 0), i -> __s[i - 1])"))
    joined = made.join(splits, keys, "left") if keys else made.crossJoin(F.broadcast(splits))  # one row
    first = F.expr("size(filter(__coarse, e -> e < __order))") * STEP
    joined = joined.withColumn("__cut_first", F.when(F.size("__s") > 0, first))
    cut = F.col("__cut_first") + F.expr(f"size(filter(slice(__s, __cut_first + 1, {STEP}), e -> e < __order))")
    return joined.withColumn(CUT, F.coalesce(cut, F.lit(0)).cast("bigint")).drop("__order", "__s", "__coarse", "__cut_first")


def _before(totals: DataFrame, keys: list[str], sums: list[str], descending: bool, whole: bool) -> DataFrame:
    """For each cut, the sums over the cuts before it (and over the whole group), in two
    levels: a task sees ABOVE cuts, and one in ABOVE of them on the level above."""
    def direction(c: Column) -> Column:
        return c.desc() if descending else c.asc()

    blocks = totals.withColumn("__block", F.expr(f"{CUT} div {ABOVE}"))
    upper = blocks.groupBy(*keys, "__block").agg(*[F.sum(c).alias(c) for c in sums])
    ahead = Window.partitionBy(*keys).orderBy(direction(F.col("__block"))).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    cols = [F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"__up_{c}") for c in sums]
    if whole:
        cols += [F.sum(c).over(every).alias(f"__all_{c}") for c in sums]
    upper = upper.select(*keys, "__block", *cols)
    inside = Window.partitionBy(*keys, "__block").orderBy(direction(F.col(CUT))).rowsBetween(Window.unboundedPreceding, -1)
    near = blocks.withColumns({f"__near_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    out = near.join(upper, [*keys, "__block"])
    kept = [(F.col(f"__near_{c}") + F.col(f"__up_{c}")).alias(f"__before_{c}") for c in sums]
    kept += [F.col(f"__all_{c}") for c in sums] if whole else []
    return out.select(*keys, CUT, *[F.col(c) for c in sums], *kept)


def rank_in_group(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank", size: str | None = None) -> DataFrame:
    """Adds the 1-based position within `keys` by `order` (ascending columns that tell
    the rows of a group apart), and the group's size."""
    cut_df = with_cuts(df, keys, order)
    totals = cut_df.groupBy(*keys, CUT).agg(F.count("*").alias("__n"))
    ahead = _before(totals, keys, ["__n"], False, size is not None).drop("__n")
    inside = Window.partitionBy(*keys, CUT).orderBy(*order)
    out = cut_df.join(ahead, [*keys, CUT]).withColumn(
        rank, F.row_number().over(inside).cast("bigint") + F.col("__before___n")
    )
    if size is not None:
        out = out.withColumn(size, F.col("__all___n"))
    return out.drop(CUT, "__before___n", "__all___n")


def rank_by_hash(df: DataFrame, keys: list[str], hashed: Column, tie: str, rank: str = "rank",
                 size: str | None = None) -> DataFrame:
    """Position in a hash order, ties by `tie`."""
    out = rank_in_group(df.withColumn("__h", hashed), keys, [F.col("__h"), F.col(tie)], rank, size)
    return out.drop("__h")


def label_by_hash(df: DataFrame, keys: list[str], hashed: Column, tie: str, label: Callable[[Column, Column], Column], name: str,
                  limits: DataFrame | None = None, widths: tuple[int, ...] = (HASH_SLOT,)) -> DataFrame:
    """Adds `name`: label(position in the hash order, size of the group), where the label
    never returns to an earlier value along the order. `limits (keys, ...)` holds more
    columns the label may use.

    Rows aren't sorted for it. A histogram of the hashes tells which slots lie wholly
    within one label; only the rows of a slot with a boundary are ranked. More `widths`
    narrow those slots further first."""
    columns = [*df.columns, name]
    extra = [c for c in (limits.columns if limits is not None else []) if c not in keys]
    rest, out = df.withColumn("__h", hashed), None
    known, slot = [], "__slot"
    for width in widths:
        rest = rest.withColumn(slot, F.expr(f"__h div {width}"))
        per = [*keys, *known, slot]
        counts = rest.groupBy(*per, *([] if not known else ["__from", "__size", *extra])).agg(F.count("*").alias("__n"))
        if not known:
            counts = counts.withColumn(CUT, F.col(slot))
            counts = _before(counts, keys, ["__n"], False, True).withColumnRenamed(CUT, slot)
            counts = counts.withColumnsRenamed({"__before___n": "__from", "__all___n": "__size"})
            counts = counts.join(limits, keys) if limits is not None else counts
        else:
            near = Window.partitionBy(*keys, *known).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
            counts = counts.withColumn("__from", F.col("__from") + F.coalesce(F.sum("__n").over(near), F.lit(0)))
        ends = counts.withColumn("__low", label(F.col("__from") + 1, F.col("__size"))).withColumn(
            "__high", label(F.col("__from") + F.col("__n"), F.col("__size")))
        ends = written(ends.select(*per, "__from", "__size", *extra, "__low", F.col("__low").eqNullSafe(F.col("__high")).alias("__sure")), "hash-slots")
        rows = rest.drop("__from", "__size", *extra)
        sure = rows.join(ends.where("__sure").select(*per, F.col("__low").alias(name)), per).select(*columns)
        out = sure if out is None else out.unionByName(sure)
        rest = rows.join(ends.where("not __sure").drop("__low", "__sure"), per)
        known, slot = [*known, slot], slot + "_"
    ranked = rank_in_group(rest, [*keys, *known], [F.col("__h"), F.col(tie)], "__place")
    return out.unionByName(ranked.withColumn(name, label(F.col("__from") + F.col("__place"), F.col("__size"))).select(*columns))


def running_totals(df: DataFrame, keys: list[str], value: str, sums: dict[str, str], totals: dict[str, str] | None = None,
                   descending: bool = False) -> DataFrame:
    """Running sums in the order of `value`, the current row included.

    `df` has one row per (keys, value). `sums` maps a column to the name of its
    running sum, `totals` maps columns to the name of the sum over the group."""
    totals = totals or {}
    columns = sorted(set(sums) | set(totals))
    cut_df = with_cuts(df, keys, [F.col(value)])
    per_cut = cut_df.groupBy(*keys, CUT).agg(*[F.sum(c).alias(c) for c in columns])
    ahead = _before(per_cut, keys, columns, descending, bool(totals)).drop(*columns)
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy(*keys, CUT).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut_df.join(ahead, [*keys, CUT])
    for c, name in sums.items():
        out = out.withColumn(f"__run_{name}", F.sum(c).over(inside) + F.col(f"__before_{c}"))
    for c, name in totals.items():
        out = out.withColumn(f"__tot_{name}", F.col(f"__all_{c}"))
    kept = [F.col(c) for c in df.columns]
    kept += [F.col(f"__run_{name}").alias(name) for name in sums.values()]
    kept += [F.col(f"__tot_{name}").alias(name) for name in totals.values()]
    return out.select(*kept)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, levels: DataFrame | list[float],
                    level: str = "level", out: str = "quantile") -> DataFrame:
    """Quantiles with linear interpolation, `(keys, level, out)`.

    Equal values are merged first, then found by running counts. `levels` is either
    one list for all groups, or a frame `(keys, level)`."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    placed = running_totals(counted, keys, value, {"__c": "__upto"}, {"__c": "__n"})
    if isinstance(levels, list):
        asked = placed.withColumn(level, F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    else:
        asked = placed.join(levels.select(*keys, level), keys)
    at = F.col(level) * (F.col("__n") - 1)
    low, high = F.floor(at), F.ceil(at)
    start = F.col("__upto") - F.col("__c")
    hit = asked.where(((low >= start) & (low < F.col("__upto"))) | ((high >= start) & (high < F.col("__upto"))))
    lo = F.max(F.when((low >= start) & (low < F.col("__upto")), F.col(value)))
    hi = F.max(F.when((high >= start) & (high < F.col("__upto")), F.col(value)))
    return (
        hit.groupBy(*keys, level)
        .agg(lo.alias("__lo"), hi.alias("__hi"), F.first(at - low).alias("__part"))
        .select(*keys, level, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__part")).alias(out))
    )
