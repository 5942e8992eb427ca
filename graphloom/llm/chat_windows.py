"""Chat formatting: conversations cut into windows of a token budget.

Prefix sums of turn tokens choose spans of whole turns. Every window repeats the system
turn and a limited history before its new turns; only new assistant texts are targets,
so each of them is one exactly once. A conversation of any length is planned from sums
per range of turns and packed in segments of bounded size, never as one group.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import schema_of
from graphloom.session import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_BACK = {"n": "\n"}
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
WINDOWS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("window", T.LongType()),
    T.StructField("repeated_turns", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(SPAN)),
])


def escape(text: str) -> str:
    """No control string is left: '<|' becomes '<' + backslash + '|'; backslashes double."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK.get(m[1], m[1]), text, flags=re.S)


def format_turns(turns: list[tuple[str, str]], repeated: int) -> tuple[str, list[dict]]:
    """The formatted window and its loss mask (code points): texts of assistant turns
    after the first `repeated` turns."""
    parts, spans, place = [], [], 0
    for k, (role, text) in enumerate(turns):
        head, body = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        if k >= repeated and role == "assistant":
            spans.append({"start": place + len(head), "end": place + len(head) + len(body)})
        parts += [head, body, CLOSE, "\n"]
        place += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def word_tokens(text: Column) -> Column:
    """Tokens of a turn: words plus four for its marks."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 4


def _placed(turns: DataFrame) -> DataFrame:
    """Ordinal and tokens before each turn in its conversation. Rows are ranged over
    tasks by (conversation, order); identical rows may stand in several tasks. Sums per
    task and conversation give what lies before."""
    keys = turns.select("_uid", "conv_id", "turn", "role", "_hash", "_tokens").repartitionByRange("conv_id", "turn", "role", "_hash", "_uid")
    ranged = written(keys.withColumn("_part", F.spark_partition_id()), "chat-order")
    sums = ranged.groupBy("conv_id", "_part").agg(F.sum("_tokens").alias("_t"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("conv_id", "_part", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t0"),
                         F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0")).where("_n0 > 0")
    # A conversation that goes on from an earlier task: at most one for each task.
    before = before.select(F.col("conv_id").alias("_c"), F.col("_part").alias("_p"), "_t0", "_n0")
    inner = Window.partitionBy("conv_id", "_part").orderBy("turn", "role", "_hash", "_uid")
    here = ranged.withColumn("_end", F.sum("_tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rank", F.row_number().over(inner))
    here = here.join(F.broadcast(before), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")), "left")
    end = F.col("_end") + F.coalesce("_t0", F.lit(0))
    return here.select("_uid", (F.col("_rank") + F.coalesce("_n0", F.lit(0))).alias("_rank"), end.alias("_end"), (end - F.col("_tokens")).alias("_begin"))


def windows(turns: DataFrame, budget: int = 2048, history: int = 512, segment: int = 64, tokens=word_tokens) -> DataFrame:
    """One row per window: conv_id, segment, window, repeated_turns, n_tokens, formatted,
    loss_spans.

    turns has conv_id, turn, role, text; other columns are left out. Order: turn (null
    first), role, hash of the text; null roles and texts are empty. Null conv_id is one
    conversation of its own. A turn over the budget has a window to itself, without
    history. The system turn is the first turn if its role is system. No rows, no
    windows. A segment holds `segment` budgets; its last window may be less full."""
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = written(turns.withColumn("_hash", F.xxhash64("text")).withColumn("_tokens", tokens(F.col("text")))
                    .withColumn("_uid", F.monotonically_increasing_id()), "chat-turns")
    size = budget * segment
    rows = turns.join(_placed(turns), "_uid")
    rows = rows.withColumn("segment", F.floor(F.col("_begin") / size))
    own = rows.withColumn("_kind", F.lit(2))
    tail = rows.where(F.col("_end") > (F.col("segment") + 1) * size - history).withColumn("segment", F.col("segment") + 1).withColumn("_kind", F.lit(1))
    last = rows.groupBy("conv_id").agg(F.max("segment").alias("_last")).where("_last > 0").select(F.col("conv_id").alias("_c"), "_last")
    system = (rows.where("_rank = 1 and role = 'system'").join(last, F.col("conv_id").eqNullSafe(F.col("_c")))
              .withColumn("segment", F.explode(F.sequence(F.lit(1).cast("long"), "_last"))).withColumn("_kind", F.lit(0)))
    columns = ["conv_id", "segment", "_kind", "_rank", "_begin", "_end", "_tokens", "role", "text"]
    every = own.select(columns).unionByName(tail.select(columns)).unionByName(system.select(columns))

    def pack(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("_kind", "ascending"), ("_rank", "ascending")]).to_pydict()
        conv, seg = rows["conv_id"][0], rows["segment"][0]
        kind = np.array(rows["_kind"])
        if not (kind == 2).any():
            return pa.Table.from_pylist([], schema)
        said = list(zip(rows["role"], rows["text"], strict=True))
        cost, rank = np.array(rows["_tokens"]), np.array(rows["_rank"])
        lead = [i for i in range(len(kind)) if rank[i] == 1 and rows["role"][i] == "system"][:1]
        body = [i for i in range(len(kind)) if kind[i] > 0 and i not in lead]
        body.sort(key=lambda i: rank[i])
        fresh = next((k for k, i in enumerate(body) if kind[i] == 2), len(body))
        sums = np.concatenate([[0], np.cumsum(cost[body])])
        fixed = int(cost[lead].sum()) if lead else 0
        out, k, number = [], fresh, 0
        new_lead = bool(lead) and kind[lead[0]] == 2
        while k < len(body) or (number == 0 and new_lead):
            first = int(np.searchsorted(sums, sums[k] - history))
            stop = int(np.searchsorted(sums, sums[first] + budget - fixed, "right")) - 1
            if stop <= k:
                first, stop = k, max(min(k + 1, len(body)), int(np.searchsorted(sums, sums[k] + budget - fixed, "right")) - 1)
            shown = [*lead, *body[first:stop]]
            again = k - first + (len(lead) if number or not new_lead else 0)
            formatted, spans = format_turns([said[i] for i in shown], again)
            out.append({"conv_id": conv, "segment": seg, "window": number, "repeated_turns": again,
                        "n_tokens": fixed + int(sums[stop] - sums[first]), "formatted": formatted, "loss_spans": spans})
            k, number = stop, number + 1
        return pa.Table.from_pylist(out, schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), *WINDOWS.fields[1:]])
    schema = to_arrow_schema(kinds)
    return every.groupBy("conv_id", "segment").applyInArrow(pack, kinds)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation say when read back: turns that aren't
    repeats, and the text under the loss mask. Windows stream past in order; only the
    state of one conversation is held."""

    def run(batches):
        import hashlib

        schema, now, state = None, object(), None

        def done():
            return {"conv_id": now, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2],
                    "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        for batch in batches:
            rows = []
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                                          ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != now:
                    if state is not None:
                        rows.append(done())
                    now, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                new = read_turns(r["formatted"])[r["repeated_turns"]:]
                state[0] += len(new)
                for role, text in new:
                    state[1].update(f"{role}\n{text}\n".encode())
                for s in r["loss_spans"]:
                    text = unescape(r["formatted"][s["start"]:s["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(r["formatted"])
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([done()], schema)

    kinds = T.StructType([T.StructField("conv_id", formatted.schema["conv_id"].dataType), *schema_of(DIGEST).fields[1:]])
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return ordered.mapInArrow(run, kinds)
