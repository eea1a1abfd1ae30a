"""The 64-bit finalizer of murmur, in whole-stage codegen, and sketches by it.

Long arithmetic in ANSI mode raises an error where it would wrap, so products are taken from 32-bit halves times 16-bit
limbs, none of which overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the multipliers of the finalizer
C1, C2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
M32 = 0xFFFFFFFF


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(M32))


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def _joined(high: Column, low: Column) -> Column:
    return F.shiftleft(_low(high), 32).bitwiseOR(low)


def add64(x: Column, n: int) -> Column:
    """x + n modulo 2^64, n small and not negative."""
    low = _low(x) + n
    return _joined(_high(x) + F.shiftright(low, 32), _low(low))


def multiply64(x: Column, c: int) -> Column:
    """x * c modulo 2^64.  x should be a plain column, as it is named several times."""
    limb = [F.lit(c >> 16 * j & 0xFFFF).cast("long") for j in range(4)]
    low, high = _low(x), _high(x)
    p = [low * limb[j] for j in range(4)]
    q = [high * limb[j] for j in range(2)]
    last16 = lambda v: F.shiftleft(v.bitwiseAND(F.lit(0xFFFF)), 16)
    t = p[0] + last16(p[1])
    h = F.shiftright(t, 32) + F.shiftright(p[1], 16) + p[2] + last16(p[3]) + q[0] + last16(q[1])
    return _joined(h, _low(t))


def _xor33(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, 33))


def murmur64(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds a column for each name with the hash of its value.  Steps are projections of their own, so that none repeats the
    expressions of the one before."""
    names = list(values)
    df = df.withColumns({n: _xor33(v) for n, v in values.items()})
    for c in (C1, C2):
        df = df.withColumns({n: multiply64(F.col(n), c) for n in names})
        df = df.withColumns({n: _xor33(F.col(n)) for n in names})
    return df


def flip(x: Column) -> Column:
    """Longs whose signed order is the unsigned order of x; its own inverse."""
    return x.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def murmur32(x: Column) -> Column:
    """The 32-bit finalizer, of and as a long from 0 to 2^32 - 1.  Products are taken from 16-bit limbs."""

    def multiply(v: Column, c: int) -> Column:
        return _low(v * F.lit(c & 0xFFFF).cast("long") + F.shiftleft(_low(v * F.lit(c >> 16).cast("long")).bitwiseAND(F.lit(0xFFFF)), 16))

    v = _low(x)
    v = multiply(v.bitwiseXOR(F.shiftrightunsigned(v, 16)), 0x85EBCA6B)
    v = multiply(v.bitwiseXOR(F.shiftrightunsigned(v, 13)), 0xC2B2AE35)
    return v.bitwiseXOR(F.shiftrightunsigned(v, 16))


def shift_left(limbs: Column, n: int) -> Column:
    """An array of 32-bit limbs (longs, the highest first) shifted left by n bits; zeros come in from the right."""
    whole, part = divmod(n, 32)
    at = lambda i: F.coalesce(F.get(limbs, i), F.lit(0).cast("long"))
    moved = lambda _, i: _low(F.shiftleft(at(i + whole), part)).bitwiseOR(F.shiftrightunsigned(at(i + whole + 1), 32 - part) if part else F.lit(0).cast("long"))
    return F.transform(limbs, moved)
