"""Key expressions that several operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_PRIME = 2147483647


def hash_order(pid: Column, seed: int = 0) -> Column:
    """A reproducible pseudo-random BIGINT in [0, 2^31 - 1) of an id and a seed, the same in any engine with 64-bit integers."""
    first = F.pmod(F.pmod(pid.cast("long"), F.lit(_PRIME)) * F.lit(48271) + F.lit(seed % _PRIME), F.lit(_PRIME))
    return F.pmod(F.pmod(first * F.lit(69621) + F.lit(12345), F.lit(_PRIME)) * F.lit(16807), F.lit(_PRIME))


def order_of(pid: np.ndarray, seed: int = 0) -> np.ndarray:
    """hash_order() of ids in a task."""
    first = (pid.astype(np.int64) % _PRIME * 48271 + seed % _PRIME) % _PRIME
    return (first * 69621 + 12345) % _PRIME * 16807 % _PRIME


def hash_order_sql(pid: str, seed: int = 0) -> str:
    """The same as SQL text, for ids of 0 or more."""
    return f"(((((CAST({pid} AS BIGINT) % {_PRIME}) * 48271 + {seed % _PRIME}) % {_PRIME}) * 69621 + 12345) % {_PRIME} * 16807 % {_PRIME})"


def uniform(pid: Column, seed: int = 0) -> Column:
    """A reproducible number in [0, 1)."""
    return hash_order(pid, seed) / F.lit(float(_PRIME))


def half_even(value: Column, digits: int) -> Column:
    """value rounded to so many digits, halves to the even side."""
    return F.rint(value * F.lit(float(10**digits))) / F.lit(float(10**digits))


def half_even_sql(value: str, digits: int) -> str:
    return f"(round_even(({value}) * CAST({10**digits} AS DOUBLE), 0) / CAST({10**digits} AS DOUBLE))"


def floor_long(value: Column) -> Column:
    return F.floor(value).cast("long")


def voxel(size: float, *axes: str) -> list[Column]:
    """Voxel indices floor(p / size), named v and the axis."""
    return [floor_long(F.col(a) / F.lit(float(size))).alias(f"v{a}") for a in axes or ("x", "y", "z")]


def morton2d(x: Column, y: Column) -> Column:
    """Z-order code of two indices of at most 16 bits: the bits of x at even, those of y at odd places."""

    def spread(v: Column) -> Column:
        v = v.cast("long").bitwiseAND(F.lit(0xFFFF))
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def ravel(vx: Column, vy: Column, vz: Column, ny: Column, nz: Column) -> Column:
    """Row-major number of a voxel in a box of nx by ny by nz."""
    return (vx * ny + vy) * nz + vz


def fnv(vx: Column, vy: Column, vz: Column) -> Column:
    """FNV-1a of three indices with the 32-bit prime in 64-bit arithmetic that wraps around: in 32-bit halves, so nothing overflows."""
    prime, mask = 16777619, 0xFFFFFFFF
    low, high = F.lit(2166136261), F.lit(0).cast("long")
    for v in (vx, vy, vz):
        v = v.cast("long")
        low, high = low.bitwiseXOR(v.bitwiseAND(F.lit(mask))), high.bitwiseXOR(F.shiftrightunsigned(v, 32))
        product = low * prime
        low, high = product.bitwiseAND(F.lit(mask)), (high * prime + F.shiftrightunsigned(product, 32)).bitwiseAND(F.lit(mask))
    return F.shiftleft(high, 32).bitwiseOR(low)
