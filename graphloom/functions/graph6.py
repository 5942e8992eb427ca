"""graph6 text as column expressions: header, validity, packing and printing.

The format (public, from the nauty documentation): the vertex count comes first,
as one character for up to 62 vertices, or `~` and three characters (18 bits);
then the upper triangle by columns, six bits per character, 63 added to each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.packed import WORD, bind

# Fixed values of the text format.
OFFSET = 63
LOWEST, HIGHEST = 63, 126
LONG_MARK = "~"
FILE_MARK = ">>graph6<<"


def _text(g6: str) -> str:
    return f"if(startswith({g6}, '{FILE_MARK}'), substring({g6}, {len(FILE_MARK) + 1}), {g6})"


def vertex_count(g6: str = "g6") -> Column:
    """Vertices by the header alone; NULL for empty text and the 36-bit header."""
    t = _text(g6)
    short = f"ascii({t}) - {OFFSET}"
    long_ = (f"shiftleft(ascii(substring({t}, 2, 1)) - {OFFSET}, 12) + "
             f"shiftleft(ascii(substring({t}, 3, 1)) - {OFFSET}, 6) + ascii(substring({t}, 4, 1)) - {OFFSET}")
    return F.expr(
        f"""case when length({t}) = 0 then null
                 when substring({t}, 1, 2) = '{LONG_MARK}{LONG_MARK}' then null
                 when substring({t}, 1, 1) = '{LONG_MARK}' then if(length({t}) < 4, null, {long_})
                 else {short} end"""
    ).cast("int")


def body(g6: str = "g6") -> str:
    t = _text(g6)
    return f"if(substring({t}, 1, 1) = '{LONG_MARK}', substring({t}, 5), substring({t}, 2))"


def fault(g6: str = "g6", n: str = "n") -> Column:
    """Why a line cannot be read, or NULL if it can."""
    return F.expr(
        f"""case when length({g6}) = 0 then 'blank'
                 when {_text(g6)} rlike '[^?-~]' then 'character'
                 when {n} is null or {n} < 0 then 'header'
                 when length({body(g6)}) <> cast(ceil({n} * ({n} - 1) / 12) as int) then 'length'
            end"""
    )


def packed_triangle(g6: str = "g6") -> Column:
    """`tri` words of valid text whose vertex count is in column n; padding bits
    at the end of the last character are ignored."""
    return F.expr(bind(
        "n",
        f"""if(n < 2, cast(array() as array<bigint>),
          transform(array(transform(split({body(g6)}, ''), c -> cast(ascii(c) - {OFFSET} as bigint))), sextets ->
            transform(sequence(0, cast(ceil((n * (n - 1) / 2) / {WORD}) as int) - 1), w ->
              aggregate(sequence(0, 9), 0L, (acc, k) -> shiftleft(acc, 6) | coalesce(get(sextets, w * 10 + k), 0L))
              & shiftleft(-1L, cast(greatest(0, {WORD} - (n * (n - 1) div 2 - w * {WORD})) as int))))[0])""",
    ))


def to_text() -> Column:
    """graph6 text of a packed row `(n, tri)`."""
    header = f"""if(n < {OFFSET}, char(n + {OFFSET}), concat('{LONG_MARK}', char({OFFSET} + (shiftright(n, 12) & 63)),
        char({OFFSET} + (shiftright(n, 6) & 63)), char({OFFSET} + (n & 63))))"""
    chars = bind(
        "tri",
        f"""array_join(transform(sequence(0, cast(ceil(n * (n - 1) / 12) as int) - 1), c ->
              char({OFFSET} + (shiftright(tri[c div 10], cast(54 - 6 * (c % 10) as int)) & 63))), '')""",
    )
    return F.expr(f"concat({header}, if(n < 2, '', {chars}))")


def graph_key(g6: str = "g6") -> Column:
    """Stable key of a graph text: the first 16 hex digits of its SHA-1."""
    return F.substring(F.sha1(F.col(g6)), 1, 16)


def pack_text(lines: DataFrame, g6: str = "g6") -> DataFrame:
    """Packed rows from valid graph text, other columns kept. Narrow."""
    return lines.withColumn("n", vertex_count(g6)).withColumn("tri", packed_triangle(g6))
