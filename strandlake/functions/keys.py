"""Columns over unsigned 64-bit keys, held as the same 64 bits in a long.

All order, shifts and arithmetic on keys go through here: Spark has no unsigned type, and its ANSI arithmetic raises
where keys must wrap. A null key has no place in the order: operators that order, split or add up keys fail on one
(require_keys) when they run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = -(1 << 63)
MODULUS = 1 << 64
_LOW = (1 << 32) - 1


def flip(k: Column) -> Column:
    """Orders as a long the way the key orders unsigned."""
    return k.bitwiseXOR(F.lit(TOP).cast("long"))


def modulus() -> Column:
    """2^64 as a decimal."""
    return F.lit(str(MODULUS)).cast("decimal(38,0)")


def unsigned(k: Column) -> Column:
    """The key's value as decimal(20, 0)."""
    d = k.cast("decimal(38,0)")
    return F.when(k < 0, d + modulus()).otherwise(d).cast("decimal(20,0)")


def text_of(k: Column) -> Column:
    return unsigned(k).cast("string")


def hashed_key(c: Column) -> Column:
    """The first 64 bits of the MD5 of the value's text: keys over the whole unsigned range."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 16), 16, -10).cast("long")


def digit(k: Column, shift: int, bits: int | None = None) -> Column:
    """(k >> shift), logical, and its low bits. A negative shift counts as none."""
    d = F.shiftrightunsigned(k, max(0, shift))
    return d if bits is None else d.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def narrow(k: Column, width: int) -> Column:
    """The high `width` bits."""
    return F.shiftrightunsigned(k, 64 - width)


def add_wrapping(a: Column, b: Column) -> Column:
    """a + b modulo 2^64, by halves: no step overflows a long."""
    low = a.bitwiseAND(F.lit(_LOW)) + b.bitwiseAND(F.lit(_LOW))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def _decimal(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def affine_step(x: Column, a: int, c: int) -> Column:
    """a x + c modulo 2^64, by 32-bit halves of x in decimals: no product reaches 10^38."""
    low = x.bitwiseAND(F.lit(_LOW)).cast("decimal(38,0)")
    high = F.shiftrightunsigned(x, 32).cast("decimal(38,0)")
    upper = ((high * _decimal(a & _LOW)) % _decimal(1 << 32)) * _decimal(1 << 32)
    d = (low * _decimal(a) + upper + _decimal(c)) % modulus()
    return F.when(d >= _decimal(1 << 63), d - modulus()).otherwise(d).cast("long")


def multiply_wrapping(x: Column, m: int) -> Column:
    """x * m modulo 2^64 for a constant m."""
    return affine_step(x, m, 0)


def round_down(v: Column, base: int) -> Column:
    return v - F.pmod(v, F.lit(base))


def round_up(v: Column, base: int) -> Column:
    return round_down(v + F.lit(base - 1), base)


def highest_bit(v: Column) -> Column:
    """Index of the highest set bit; null for 0, where there is none."""
    return F.when(v != 0, F.length(F.bin(v)) - 1)


def block_of(pos: Column, width: int, block_bytes: int) -> Column:
    """The block that holds the word at this position."""
    return F.floor(pos * F.lit(width) / F.lit(block_bytes)).cast("long")


def compare_exchange(a: Column, b: Column) -> tuple[Column, Column]:
    """(smaller, larger) of two keys, unsigned."""
    return flip(F.least(flip(a), flip(b))), flip(F.greatest(flip(a), flip(b)))


def require_keys(df: DataFrame, *columns: str) -> DataFrame:
    """df, failing on a null in these columns when it runs."""
    return df.select(*(F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}")).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))
