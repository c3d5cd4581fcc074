"""Voronoi diagrams restricted to a surface of triangles.

Every point of a triangle has its nearest site within d + 2 r of the triangle's
middle, d being the distance from there to the nearest site and r the reach of
the corners. So a triangle meets only the sites within that distance; they come
from the bucket join, again with twice as many for triangles that are not
complete. The pieces of a triangle are then cut site by site, and a cell is the
sum of its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import trees
from tessera.operators.ordering import checkpointed
from tessera.operators.topology import corner_vectors, with_corners


def cut(polygon: np.ndarray, normal: np.ndarray, offset: float) -> np.ndarray:
    """The part of a convex polygon (n, 3) with normal . x >= offset."""
    side = polygon @ normal - offset
    if (side >= 0).all():
        return polygon
    out = []
    for k in range(len(polygon)):
        p, q, a, b = polygon[k - 1], polygon[k], side[k - 1], side[k]
        if (a >= 0) != (b >= 0):
            out.append(p + (q - p) * (a / (a - b)))
        if b >= 0:
            out.append(q)
    return np.array(out) if len(out) >= 3 else np.zeros((0, 3))


def pieces(triangle: np.ndarray, sites: np.ndarray) -> list[tuple[int, float, np.ndarray]]:
    """(number of the site, area, moment) of the parts of a triangle that are nearest to each site."""
    out = []
    for i, s in enumerate(sites):
        part = triangle
        order = np.argsort(((sites - s) ** 2).sum(axis=1))
        for j in order:
            if j != i:
                n = s - sites[j]
                part = cut(part, n, 0.5 * (s @ s - sites[j] @ sites[j]))
                if not len(part):
                    break
        if len(part):
            a, b, c = part[0], part[1:-1], part[2:]
            area = 0.5 * np.linalg.norm(np.cross(b - a, c - a), axis=1)
            out.append((i, float(area.sum()), (area[:, None] * (a + b + c) / 3).sum(axis=0)))
    return out


def diagram(triangles: DataFrame, vertices: DataFrame, sites: DataFrame, neighbours: int = 12) -> DataFrame:
    """triangle, site, area, mx, my, mz of every piece. sites: id, x, y, z, no two at one place."""
    a, b, c = corner_vectors()
    t = with_corners(triangles, vertices)
    m = v.scale(v.add(v.add(a, b), c), 1 / 3)
    t = t.select("id", *[k.alias(n) for k, n in zip(m, "xyz", strict=True)], *[f"{p}{k}" for p in "abc" for k in "xyz"])
    p = v.vec("x", "y", "z")
    t = checkpointed(t.withColumn("reach", F.greatest(*[v.length(v.sub(k, p)) for k in (a, b, c)])))
    total = sites.count()
    todo, parts, k = t, None, min(neighbours, total)
    index = trees.Index(sites, ("x", "y", "z"), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                corner = np.array([[r[f"{p}{k}"] for k in "xyz"] for p in "abc"])
                found = pieces(corner, np.array([(s["x"], s["y"], s["z"]) for s in r["near"]]))
                rows += [(r["id"], r["near"][i]["id"], area, *map(float, moment)) for i, area, moment in found]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 2 + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["triangle", "site", "area", "mx", "my", "mz"])

    while True:
        near = index.nearest(k, todo.select("id", "x", "y", "z"))
        named = near.join(sites.select(F.col("id").alias("neighbour"), "x", "y", "z"), "neighbour")
        lists = named.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d2", F.col("neighbour").alias("id"), "x", "y", "z"))).alias("near"))
        rows = checkpointed(todo.join(lists, "id"))
        limit = F.sqrt(F.get("near", F.lit(0))["d2"]) + 2 * F.col("reach")
        whole = (F.sqrt(F.element_at("near", -1)["d2"]) > limit) | F.lit(k >= total)
        # Sites beyond the limit own no part of the triangle.
        ready = rows.filter(whole).withColumn("limit", limit).withColumn("near", F.filter("near", lambda s: F.sqrt(s["d2"]) <= F.col("limit")))
        done = ready.mapInArrow(run, "triangle long, site long, area double, mx double, my double, mz double")
        parts = done if parts is None else parts.unionByName(done)
        todo = checkpointed(rows.filter(~whole).drop("near"))
        if todo.isEmpty():
            return parts
        k = min(2 * k, total)


def cells(parts: DataFrame) -> DataFrame:
    """site, area, mx, my, mz: the pieces of each site summed."""
    return parts.groupBy("site").agg(*[F.sum(c).alias(c) for c in ("area", "mx", "my", "mz")])
