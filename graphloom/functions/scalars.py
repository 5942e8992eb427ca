"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_MODULUS = 1_000_003


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mix(key: Column | str, seed: Column | int = 0) -> Column:
    """Portable hash of a key of any type and a seed into [0, HASH_MODULUS): 60 bits of
    the digest of their text, so that orders under different seeds are independent.

    Every sample, split and shuffle orders by this value and then by the key, so
    results depend on keys and seeds only and never on partitioning."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    digest = F.md5(F.concat_ws(":", col(key).cast("string"), seed.cast("string")).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return F.pmod(bits, F.lit(HASH_MODULUS).cast("bigint"))


def safe_div(a: Column, b: Column) -> Column:
    """a / b as DOUBLE, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def nan_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def signed_log(c: Column | str) -> Column:
    """sign(x) * log10(|x| + 1)."""
    c = col(c).cast("double")
    return F.signum(c) * F.log10(F.abs(c) + 1.0)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def is_power_of_two(c: Column | str) -> Column:
    c = col(c).cast("bigint")
    return (c > 0) & (c.bitwiseAND(c - 1) == 0)


def tie_winner(delta: Column | str) -> Column:
    d = col(delta)
    return F.when(d > 0, "matching").when(d < 0, "pauli").otherwise("tie")


def hamming_int(u: Column | str, v: Column | str) -> Column:
    return F.bit_count(col(u).bitwiseXOR(col(v)))


def hamming_text(a: Column | str, b: Column | str) -> Column:
    """Number of positions in which two texts differ, up to the shorter length."""
    width = F.least(F.length(col(a)), F.length(col(b)))
    left, right = F.split(F.substring(col(a), F.lit(1), width), ""), F.split(F.substring(col(b), F.lit(1), width), "")
    return F.when(width > 0, F.size(F.filter(F.zip_with(left, right, lambda x, y: x != y), lambda d: d))).otherwise(0)


def bit_text(c: Column | str, width: int) -> Column:
    """Zero-padded binary text of an integer, for display."""
    return F.lpad(F.conv(col(c).cast("string"), 10, 2), width, "0")
