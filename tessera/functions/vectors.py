"""Column expressions for points and vectors in three dimensions.

A vector is a tuple of three columns. All expressions stay inside code
generation; none is a UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def scale(a: Vec, s) -> Vec:
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    """a at length 1; null for a vector of no length."""
    n = length(a)
    return tuple(F.try_divide(p, n) for p in a)


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def sphere_params(p: Vec) -> tuple[Column, Column]:
    """(u, v) in [0, 1] of a point of the unit sphere."""
    return (F.atan2(p[1], p[0]) + math.pi) / (2 * math.pi), 1 - F.acos(clamp(p[2], -1.0, 1.0)) / math.pi


def unwrapped(us: list[Column]) -> tuple[list[Column], Column]:
    """The u of an element's corners without the jump at the seam, and whether there was none."""
    wide = F.greatest(*us) - F.least(*us) > 0.5
    return [F.when(wide & (u > 0.5), u - 1).otherwise(u) for u in us], ~wide


def lon_lat(p: Vec) -> tuple[Column, Column]:
    return F.atan2(p[1], p[0]), F.asin(clamp(p[2], -1.0, 1.0))


def tangent(u: Vec, n: Vec) -> Vec:
    """The part of u orthogonal to the unit normal n."""
    return sub(u, scale(n, dot(u, n)))


def arc(a: Vec, b: Vec) -> Column:
    return F.atan2(length(cross(a, b)), dot(a, b))


def planar_area(a: Vec, b: Vec, c: Vec) -> Column:
    return 0.5 * length(cross(sub(b, a), sub(c, a)))


def spherical_area(a: Vec, b: Vec, c: Vec) -> Column:
    return 2 * F.atan2(F.abs(dot(a, cross(b, c))), 1 + dot(a, b) + dot(b, c) + dot(a, c))


def orient2d(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> Column:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def bisector(zi: Vec, zj: Vec, wi: Column, wj: Column) -> tuple[Vec, Column]:
    """Normal and offset of the weighted bisector; n . x + offset >= 0 on the side of i; null for points in one place."""
    d = length(sub(zj, zi))
    at = F.try_divide(d * d + wi - wj, 2 * d)
    n = unit(sub(zi, zj))
    return n, -dot(n, add(zi, scale(n, -at)))


def quality(a: Vec, b: Vec, c: Vec, area: Column, factor: float = 4 * math.sqrt(3)) -> Column:
    """factor * area over the sum of squared edge lengths; null where all corners are in one place."""
    e = [sub(b, a), sub(c, b), sub(a, c)]
    return F.try_divide(factor * area, dot(e[0], e[0]) + dot(e[1], e[1]) + dot(e[2], e[2]))


def spread_bits(c: Column) -> Column:
    """The low 21 bits of a column, each followed by two empty bits."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


#: Fixed value: the scale of a coordinate in a three-dimensional Morton key.
MORTON_SCALE = 2091752


def morton(p: Vec, low: Vec, high: Vec) -> Column:
    """Morton key of 21 bits an axis of a point in its bounding box."""
    bits = []
    for c, a, b in zip(p, low, high, strict=True):
        share = F.when(b > a, (c - a) / (b - a)).otherwise(0.0)
        bits.append(spread_bits(F.floor(clamp(share * MORTON_SCALE, 0.0, float(MORTON_SCALE))).cast("long")))
    return F.shiftleft(bits[0], 2).bitwiseOR(F.shiftleft(bits[1], 1)).bitwiseOR(bits[2])


#: Bits an axis of Morton keys of two and four dimensions; one less than would fill a long, so that keys are in order as signed numbers.
KEY_BITS = {2: 31, 4: 15}


def morton_of(at: list[Column], low: list[Column], high: list[Column]) -> Column:
    """Morton key of a point of two or four coordinates in its bounding box, the first coordinate's bits highest; an axis without width counts as 0."""
    bits = KEY_BITS[len(at)]
    key = F.lit(0).cast("long")
    for k, (c, a, b) in enumerate(zip(at, low, high, strict=True)):
        share = F.when(b > a, F.try_divide(c - a, b - a)).otherwise(0.0)
        cell = F.least(F.floor(clamp(share, 0.0, 1.0) * float(1 << bits)), F.lit((1 << bits) - 1)).cast("long")
        for bit in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1).cast("long")), len(at) * bit + len(at) - 1 - k))
    return key


def days_hours_minutes(seconds: Column) -> Column:
    """DDD:HH:MM."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%03d:%02d:%02d", F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60)
