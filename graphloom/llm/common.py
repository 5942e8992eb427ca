"""Small things the operators share: tables, keys, Arrow functions over whole texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.bytewords import Texts, slices

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query of this subpackage."""

    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remainder(key: str, m: int) -> Column:
    """crc32 of the key's text modulo m; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def smallest(df: DataFrame, key: Column, k: int, *ties: str) -> DataFrame:
    """The k rows with the smallest 64-bit hashes `key`. Rows are counted first and only
    those under a bound that leaves a few more than k are ordered, so that what is sent
    to one place doesn't grow with the number of tasks."""
    share = (k + 8 * k**0.5 + 64) / max(1, df.count())
    if share < 1:
        df = df.where(key <= F.lit(int(-(2**63) + share * 2**64)))
    return df.orderBy(key, *ties).limit(k)


KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
         "boolean": T.BooleanType(), "binary": T.BinaryType(), "float": T.FloatType()}


def schema_of(text: str) -> T.StructType:
    """Schema from "name kind, ..."; needs no session, so that workers can import it."""
    pairs = [part.split() for part in text.split(",")]
    many = {f"array<{k}>": T.ArrayType(v) for k, v in KINDS.items()}
    return T.StructType([T.StructField(name, (KINDS | many)[kind]) for name, kind in pairs])


def text_function(fields: str | T.StructType, fn: Callable[[Texts], dict[str, np.ndarray | pa.Array | list]]):
    """An Arrow function text -> struct: fn gets some texts at a time, whole ones, and
    returns an array per field. Marked as not deterministic, so that Spark computes it
    once and doesn't copy it into filters."""
    schema = fields if isinstance(fields, T.StructType) else schema_of(fields)
    kind = to_arrow_type(schema)

    def run(column: pa.Array) -> pa.Array:
        parts = []
        for _, _, texts in slices(column):
            got = fn(texts)
            parts.append(pa.StructArray.from_arrays([pa.array(got[f.name], f.type) for f in kind], fields=list(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, schema).asNondeterministic()
