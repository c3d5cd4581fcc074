"""Signs of orientation and of the side of a circle, decided exactly.

The determinant in doubles is right in sign where its size is above a bound of its rounding error. Only rows below the
bound go on to whole numbers: a double is a whole number times a power of two, so with one power for
all of a row's numbers the determinant is one of whole numbers: of 64 bits, all rows at once, where these hold it, else
one of Python's integers. Exact signs do not depend on the order in which the points are
given but for the sign of that order, so neighbouring decisions agree. A null or non-finite number gives null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = float(np.finfo(float).eps)


def _whole(numbers: list[float]) -> list[int]:
    """Whole numbers in the proportion of the doubles."""
    ratios = [x.as_integer_ratio() for x in numbers]
    most = max(d for _, d in ratios)
    return [n * (most // d) for n, d in ratios]


def _orientation(p):
    ax, ay, bx, by, cx, cy = p
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _circle(p):
    ax, ay, bx, by, cx, cy, dx, dy = p
    rows = [(x - dx, y - dy) for x, y in ((ax, ay), (bx, by), (cx, cy))]
    lifts = [x * x + y * y for x, y in rows]
    (px, py), (qx, qy), (rx, ry) = rows
    return lifts[0] * (qx * ry - qy * rx) - lifts[1] * (px * ry - py * rx) + lifts[2] * (px * qy - py * qx)


#: Whole numbers up to these have determinants that 64 bits hold.
SMALL = {_orientation: 2**29, _circle: 2**13}


def signs(p: np.ndarray, exact) -> np.ndarray:
    """The sign of an exact determinant of every column of finite doubles (numbers, rows)."""
    part, power = np.frexp(p)
    bits = np.abs(np.ldexp(part, 53)).astype(np.int64)
    # The place of the last bit that is set.
    last = power - 54 + np.frexp((bits & -bits).astype(float))[1]
    least = np.where(p != 0, last, np.iinfo(np.int32).max).min(axis=0)
    top = np.where(p != 0, power, np.iinfo(np.int32).min).max(axis=0)
    zero = (p == 0).all(axis=0)
    # Numbers below 2^(top - least) once scaled.
    few = zero | (top.astype(np.int64) - least <= int(np.log2(SMALL[exact])))
    out = np.zeros(p.shape[1], dtype=np.int32)
    out[few] = np.sign(exact(np.ldexp(p[:, few], np.where(zero, 0, -least)[few]).astype(np.int64)))
    for k in np.flatnonzero(~few):
        d = exact(_whole(p[:, k].tolist()))
        out[k] = (d > 0) - (d < 0)
    return out


def _decided(df: DataFrame, points: list[tuple[str, str]], rough, errors: float, exact, name: str) -> DataFrame:
    columns = list(chain(*points))
    marked = df.withColumn(name, F.lit(None).cast("int"))
    out, at = list(marked.columns), [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in at])
            fine = np.isfinite(p).all(axis=0)
            with np.errstate(all="ignore"):
                det, size = rough(p)
                # Products that may have overflowed, or fallen among the smallest doubles, are not sure.
                sure = (np.abs(det) > errors * EPS * size) & (size < 1e300) & (np.abs(det) > 1e-280)
            found = np.sign(np.where(sure, det, 0)).astype(np.int32)
            left = fine & ~sure
            found[left] = signs(p[:, left], exact)
            told = pa.array(found, mask=~fine)
            yield pa.RecordBatch.from_arrays([told if c == name else batch.column(k) for k, c in enumerate(out)], names=out)

    return marked.mapInArrow(run, marked.schema)


def _rough_orientation(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ax, ay, bx, by, cx, cy = p
    one, two = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    return one - two, np.abs(one) + np.abs(two)


def _rough_circle(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = [(p[k] - p[6], p[k + 1] - p[7]) for k in (0, 2, 4)]
    lift = [a * a + b * b for a, b in x]
    det, size = 0.0, 0.0
    for sign, up, (u, w) in zip((1, -1, 1), lift, ((x[1], x[2]), (x[0], x[2]), (x[0], x[1])), strict=True):
        det = det + sign * up * (u[0] * w[1] - u[1] * w[0])
        size = size + up * (np.abs(u[0] * w[1]) + np.abs(u[1] * w[0]))
    return det, size


def with_orientation(df: DataFrame, a: tuple[str, str], b: tuple[str, str], c: tuple[str, str], name: str = "turn") -> DataFrame:
    """df with 1 where three points of the plane turn left, -1 where they turn right, 0 where they lie on a line."""
    return _decided(df, [a, b, c], _rough_orientation, 8.0, _orientation, name)


def with_circle_side(df: DataFrame, a: tuple[str, str], b: tuple[str, str], c: tuple[str, str], d: tuple[str, str], name: str = "inside") -> DataFrame:
    """df with 1 where d is inside the circle through a, b, c, which turn left, -1 outside, 0 on it; the other way round where they turn right."""
    return _decided(df, [a, b, c, d], _rough_circle, 24.0, _circle, name)
