"""Small dense matrices as tuples of columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Mat3 = tuple[Column, Column, Column, Column, Column, Column, Column, Column, Column]


def det3(m: Mat3) -> Column:
    a, b, c, d, e, f, g, h, i = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def inverse3(m: Mat3) -> Mat3:
    """By cofactors."""
    a, b, c, d, e, f, g, h, i = m
    r = 1 / det3(m)
    cof = (e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)
    return tuple(x * r for x in cof)


def eigen2(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Eigenvalues of [[a, b], [b, c]], the larger first."""
    middle, spread = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b)
    return middle + spread, middle - spread


def eigen3(m: list[list[Column]]) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric matrix of three rows, the largest first, by the angle of its characteristic cubic."""
    mean = trace(m) / 3
    off = m[0][1] * m[0][1] + m[0][2] * m[0][2] + m[1][2] * m[1][2]
    spread = F.sqrt((sum(((m[k][k] - mean) * (m[k][k] - mean) for k in range(3)), F.lit(0.0)) + 2 * off) / 6)
    b = [[m[i][j] - mean if i == j else m[i][j] for j in range(3)] for i in range(3)]
    turn = F.acos(F.greatest(F.least(determinant(b) / (2 * spread * spread * spread), F.lit(1.0)), F.lit(-1.0))) / 3
    high = F.when(spread > 0, mean + 2 * spread * F.cos(turn)).otherwise(mean)
    low = F.when(spread > 0, mean + 2 * spread * F.cos(turn + 2 * math.pi / 3)).otherwise(mean)
    return high, 3 * mean - high - low, low


def of_symmetric2(a: Column, b: Column, c: Column, f: Callable[[Column], Column]) -> tuple[Column, Column, Column]:
    """f of the symmetric matrix through its eigenvalues: exponential, logarithm, powers, roots."""
    high, low = eigen2(a, b, c)
    p, q = f(high), f(low)
    gap = high - low
    slope = F.when(gap > 1e-12 * F.abs(high), (p - q) / gap).otherwise(0.0)
    return p + slope * (a - high), slope * b, p + slope * (c - high)


def determinant(m: list[list[Column]]) -> Column:
    """Of a square matrix of columns, by cofactors of the first row; meant for up to four rows, as the terms grow factorially."""
    if len(m) == 1:
        return m[0][0]
    parts = [m[0][j] * determinant(minor(m, 0, j)) for j in range(len(m))]
    total = parts[0]
    for j, part in enumerate(parts[1:], 1):
        total = total - part if j % 2 else total + part
    return total


def minor(m: list[list[Column]], i: int, j: int) -> list[list[Column]]:
    return [row[:j] + row[j + 1 :] for k, row in enumerate(m) if k != i]


def inverse(m: list[list[Column]]) -> list[list[Column]]:
    """By cofactors; null for a singular matrix."""
    n, det = len(m), determinant(m)
    safe = F.when(det != 0, det)
    if n == 1:
        return [[1 / safe]]
    return [[(-1) ** (i + j) * determinant(minor(m, j, i)) / safe for j in range(n)] for i in range(n)]


def trace(m: list[list[Column]]) -> Column:
    return sum((m[k][k] for k in range(1, len(m))), m[0][0])
