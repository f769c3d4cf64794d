"""Unsigned 64-bit mixing with bigint columns, where ANSI arithmetic would raise on overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points kept one zoom below the base: the others are dropped. A fixed value of the tiling rules.
KEEP_PER_ZOOM = 0.4


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once; written out, repeated use would double the expression at every step."""
    return F.get(F.transform(F.array(value), use), 0)


def multiply64(x: Column, by: int) -> Column:
    """x * by modulo 2^64, from products of 16-bit limbs."""
    b = [by >> 16 * i & 0xFFFF for i in range(4)]

    def step(a: list[Column], k: int, carry: Column, done: Column) -> Column:
        if k == 4:
            return done
        total = carry
        for i in range(k + 1):
            total = total + a[i] * b[k - i]
        return _let(total, lambda t: step(a, k + 1, F.shiftrightunsigned(t, 16), done.bitwiseOR(F.shiftleft(t.bitwiseAND(0xFFFF), 16 * k))))

    zero = F.lit(0).cast("long")
    return step([F.shiftrightunsigned(x, 16 * i).bitwiseAND(0xFFFF) for i in range(4)], 0, zero, zero)


def fmix64(x: Column) -> Column:
    """The MurmurHash3 finalizer; the result's bits as a bigint."""
    fold = lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 33))
    once = lambda v: _let(multiply64(v, 0xFF51AFD7ED558CCD), lambda m: _let(fold(m), twice))
    twice = lambda v: _let(multiply64(v, 0xC4CEB9FE1A85EC53), fold)
    return _let(x.cast("long"), lambda v: _let(fold(v), once))


def unit_interval(bits: Column) -> Column:
    """Unsigned 64 bits over 2^64."""
    high, low = F.shiftrightunsigned(bits, 32).cast("double"), bits.bitwiseAND(0xFFFFFFFF).cast("double")
    return (high * 4294967296.0 + low) / 18446744073709551616.0


def retention_rate(z, base_zoom) -> Column:
    z = z if isinstance(z, Column) else F.lit(z)
    base = base_zoom if isinstance(base_zoom, Column) else F.lit(base_zoom)
    return F.when(z >= base, F.lit(1.0)).otherwise(F.pow(F.lit(KEEP_PER_ZOOM), (base - z).cast("double")))


def keep_point(feature_id: Column, z, base_zoom) -> Column:
    """Thinning: true if the point stays at zoom z. A point that stays at some zoom stays at all higher ones."""
    rate = retention_rate(z, base_zoom)
    return (rate >= 1.0) | (_let(fmix64(feature_id), unit_interval) < rate)
