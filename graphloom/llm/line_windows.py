"""Line dedup: windows of three consecutive lines, repeated ones removed but the first.

Lines with a word are hashed in overlapping windows of three. A window's first
occurrence in the corpus, by (doc_id, text, line), stays; lines covered by any later
occurrence go. All of it is DataFrame work: one small row per window, counts combined
before the shuffle, and only windows that repeat are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_of
from graphloom.session import written

SPACES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _windows(keyed: DataFrame, size: int) -> DataFrame:
    """doc keys, the window's two hashes, its first and last line (from 0)."""
    lines = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("i"), F.regexp_replace(line, SPACES, "").alias("l")))
    full = keyed.select("_id", "_th", F.filter(lines, lambda x: F.length(x.l) > 0).alias("_l")).where(F.size("_l") >= size)

    def window(k):
        part = F.slice("_l", k, size)
        text = F.transform(part, lambda x: x.l)
        return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.element_at(part, 1).i.alias("a"), F.element_at(part, size).i.alias("b"))

    starts = F.sequence(F.lit(1), F.size("_l") - size + 1)
    return full.select("_id", "_th", F.explode(F.transform(starts, window)).alias("_w")).select("_id", "_th", "_w.*")


def _merged(spans):
    """Sorted (a, b) spans joined where they touch or overlap."""
    kind = "array<struct<a:int,b:int>>"

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last.a.alias("a"), F.greatest(last.b, s.b).alias("b"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)).b >= s.a - 1), joined.cast(kind)).otherwise(F.concat(done, F.array(s)).cast(kind))

    return F.aggregate(spans, F.array().cast(kind), add)


def remove_repeated(docs: DataFrame, size: int = 3) -> DataFrame:
    """docs with `text` cut and two more columns: n_lines, n_removed (lines).

    Lines end at newlines; lines without a word take part in no window, and go only
    where they lie inside a covered one. Lines compare without outer white space. Texts
    of fewer than `size` such lines stay as they are; null stays null (0 lines). Rows
    that repeat doc_id and text are one document and are cut alike; null doc_ids come
    last. Other columns pass through."""
    own = docs.columns
    keyed = docs.select(F.col("doc_id").alias("_id"), text_of().alias("text")).withColumn("_th", F.xxhash64("text"))
    windows = _windows(keyed, size)
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_th").alias("th"), F.col("a").alias("a"))
    firsts = written(windows.groupBy("h1", "h2").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
                     .where("not (_first <=> _last)").select("h1", "h2", "_first"), "line-firsts")
    later = windows.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("_first")))
    spans = later.groupBy("_id", "_th").agg(_merged(F.array_sort(F.collect_set(F.struct("a", "b")))).alias("_spans"))
    spans = spans.select(F.col("_id").alias("_id2"), F.col("_th").alias("_th2"), "_spans")
    joined = docs.withColumn("_th", F.xxhash64(text_of())).join(spans, F.col("doc_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2")), "left")
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.exists("_spans", lambda s: (i >= s.a) & (i <= s.b)))
    cut = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    gone = F.coalesce(F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s.b - s.a + 1), F.lit(0).cast("long"))
    size_of = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    rest = [c for c in own if c not in ("n_lines", "n_removed")]
    return joined.select(*[cut.alias(c) if c == "text" else F.col(c) for c in rest], size_of.alias("n_lines"), gone.alias("n_removed"))
