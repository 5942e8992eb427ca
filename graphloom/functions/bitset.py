"""SQL fragments for vertex sets, as one BIGINT or as an array of BIGINT.

Each function returns expression text, so that the graph operators can be written
once for both widths."""

from __future__ import annotations


class Narrow:
    """Sets of up to 64 vertices in one BIGINT."""

    empty = "0L"
    kind = "bigint"

    @staticmethod
    def single(i: str) -> str:
        return f"shiftleft(1L, {i})"

    @staticmethod
    def union(a: str, b: str) -> str:
        return f"({a} | {b})"

    @staticmethod
    def meet(a: str, b: str) -> str:
        return f"({a} & {b})"

    @staticmethod
    def size(a: str) -> str:
        return f"bit_count({a})"

    @staticmethod
    def has(a: str, i: str) -> str:
        return f"((shiftright({a}, {i}) & 1L) = 1L)"

    @staticmethod
    def above(i: str) -> str:
        """All vertices greater than i."""
        return f"shiftleft(-2L, {i})"


class Wide:
    """Larger sets, 64 vertices per array element; n is in scope as a column."""

    empty = "array_repeat(0L, cast((n - 1) div 64 + 1 as int))"
    kind = "array<bigint>"

    @staticmethod
    def single(i: str) -> str:
        return (f"transform(sequence(0, cast((n - 1) div 64 as int)), "
                f"blk -> if(blk = {i} div 64, shiftleft(1L, cast({i} % 64 as int)), 0L))")

    @staticmethod
    def union(a: str, b: str) -> str:
        return f"zip_with({a}, {b}, (p, q) -> p | q)"

    @staticmethod
    def meet(a: str, b: str) -> str:
        return f"zip_with({a}, {b}, (p, q) -> p & q)"

    @staticmethod
    def size(a: str) -> str:
        return f"aggregate({a}, 0, (cnt, w) -> cnt + bit_count(w))"

    @staticmethod
    def has(a: str, i: str) -> str:
        return f"((shiftright({a}[cast({i} div 64 as int)], cast({i} % 64 as int)) & 1L) = 1L)"

    @staticmethod
    def above(i: str) -> str:
        return (f"transform(sequence(0, cast((n - 1) div 64 as int)), blk -> case when blk > {i} div 64 then -1L "
                f"when blk = {i} div 64 then shiftleft(-2L, cast({i} % 64 as int)) else 0L end)")


def sets(wide: bool):
    return Wide if wide else Narrow
