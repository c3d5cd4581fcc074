"""Ear clipping of simple polygons, convex or not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def ears(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Corner numbers of the triangles of a simple polygon (n, 2), counter-clockwise as the polygon is made to be."""
    n = len(points)
    x, y = points[:, 0], points[:, 1]
    order = list(range(n)) if (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() >= 0 else list(range(n - 1, -1, -1))
    out = []

    def turn(a: int, b: int, c: int) -> float:
        return (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])

    while len(order) > 3:
        best = None
        for k in range(len(order)):
            a, b, c = order[k - 1], order[k], order[(k + 1) % len(order)]
            up = turn(a, b, c)
            if up <= 0:
                continue
            rest = np.array([p for p in order if p not in (a, b, c)])
            px, py = x[rest], y[rest]
            inside = np.ones(len(rest), dtype=bool)
            for p, q in ((a, b), (b, c), (c, a)):
                inside &= (x[q] - x[p]) * (py - y[p]) - (y[q] - y[p]) * (px - x[p]) >= 0
            if not inside.any():
                best = k
                break
        # A polygon whose corners touch has no clean ear: the flattest corner goes.
        k = best if best is not None else min(range(len(order)), key=lambda k: abs(turn(order[k - 1], order[k], order[(k + 1) % len(order)])))
        out.append((order[k - 1], order[k], order[(k + 1) % len(order)]))
        del order[k]
    return [*out, tuple(order)]


def triangulated(polygons: DataFrame) -> DataFrame:
    """id, k, v0, v1, v2 (corner numbers) of polygons id, points (array of x, y), each of a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, points in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if points and len(points) >= 3:
                    found = ears(np.array([(p["x"], p["y"]) for p in points]))
                    rows += [(i, k, *t) for k, t in enumerate(found)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "k", "v0", "v1", "v2"])

    return polygons.select("id", "points").mapInArrow(run, "id long, k long, v0 long, v1 long, v2 long")
