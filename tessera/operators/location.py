"""Which triangle of a mesh of the sphere holds a point.

A hierarchical join: every triangle goes to the nested triangles (see trees) of one level,
that of its own size, which its bounding cap meets; there are few of them whatever its size. A point
has one path through the nested triangles, and looks at its prefixes of the levels
in use. So large and small triangles meet the same points by equal keys, and what meets
is tested by the signs of three determinants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators.ordering import checkpointed
from tessera.operators.trees import FACES, OCTAHEDRON, children, finite, triangle_paths

#: Levels of nested triangles at most.
DEPTH = 20
#: A point so near to an edge (a share of the triangle) counts as on it.
ON_EDGE = 1e-12

CORNERS = [f"{p}{k}" for p in "abc" for k in "xyz"]


def _caps(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and radius (a chord) of the caps that hold spherical triangles (n, 3, 3) of less than half the sphere."""
    middle = corners.sum(axis=1)
    size = np.linalg.norm(middle, axis=1, keepdims=True)
    middle = np.where(size > 1e-9, middle / np.maximum(size, 1e-300), corners[:, 0])
    reach = np.linalg.norm(corners - middle[:, None], axis=2).max(axis=1)
    return middle, np.where(size[:, 0] > 1e-9, reach, 2.0)


def cells_met(corners: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(row of a triangle, path) of the nested triangles that its cap meets, at the level of its size."""
    middle, reach = _caps(corners)
    level = np.clip(np.floor(np.log2(1.0 / np.maximum(2 * reach, 1e-9))), 0, DEPTH).astype(int)
    level = np.where(reach > 1.0, 0, level)  # beyond a quarter of the sphere a cap's chord bounds little
    owner = np.repeat(np.arange(len(corners)), 8)
    cells = np.tile(OCTAHEDRON[FACES], (len(corners), 1, 1))
    paths = np.tile(np.arange(8)[:, None], (len(corners), 1)).astype(np.uint8) + ord("0")
    rows, names = [], []
    for depth in range(DEPTH + 1):
        at, wide = _caps(cells)
        # Chords of arcs that add up are shorter than their sum.
        met = (np.linalg.norm(at - middle[owner], axis=1) <= wide * (1 + 1e-6) + reach[owner] + 1e-12) | (reach[owner] > 1.0)
        owner, cells, paths = owner[met], cells[met], paths[met]
        end = level[owner] == depth
        rows.append(owner[end])
        names += [p.tobytes().decode() for p in paths[end]]
        owner, cells, paths = owner[~end], cells[~end], paths[~end]
        if not len(owner):
            break
        owner = np.repeat(owner, 4)
        cells = children(cells).reshape(-1, 3, 3)
        paths = np.column_stack([np.repeat(paths, 4, axis=0), np.tile(np.arange(4, dtype=np.uint8) + ord("0"), len(owner) // 4)])
    return np.concatenate(rows), names


def dealt(triangles: DataFrame) -> DataFrame:
    """triangle, its corners, path: every triangle for each nested triangle that its cap meets."""
    schema = "triangle long, " + ", ".join(f"{c} double" for c in CORNERS) + ", path string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                xyz = np.column_stack([np.asarray(part.column(k + 1), dtype=float) for k in range(9)]).reshape(-1, 3, 3)
                xyz = xyz / np.maximum(np.linalg.norm(xyz, axis=2, keepdims=True), 1e-300)
                rows, paths = cells_met(xyz)
                kept = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(paths, pa.string())], names=["triangle", *CORNERS, "path"])

    return triangles.select(F.col("id").alias("triangle"), *[F.col(c).cast("double").alias(c) for c in CORNERS]).mapInArrow(run, schema)


def locate_on_sphere(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """id, triangle (the least id of those that hold the point; null outside), s, t (shares of its second and third corner).

    points: id, x, y, z; triangles: id, ax, ay, az, ... cz, corners on the sphere, of either turn. A point on an edge is in the
    triangles on both sides. A flat triangle (no volume with the centre) holds no point; a point at the centre, or with a
    null or non-finite coordinate, is nowhere. Shares are those of the determinants: of the plane through the corners, seen from the centre.
    """
    a, b, c = (v.vec(*[f"{p}{k}" for k in "xyz"]) for p in "abc")
    whole = finite(triangles, tuple(CORNERS)).filter(F.abs(v.dot(a, v.cross(b, c))) > 1e-300)
    mesh = checkpointed(dealt(whole))
    levels = sorted(r[0] for r in mesh.select(F.length("path")).distinct().collect())  # DEPTH + 1 at most
    at = finite(points.select("id", *[F.col(k).cast("double").alias(k) for k in "xyz"]), ("x", "y", "z")).filter("x <> 0 OR y <> 0 OR z <> 0")
    if not levels:
        return points.select("id", F.lit(None).cast("long").alias("triangle"), *[F.lit(None).cast("double").alias(k) for k in ("s", "t")])
    placed = triangle_paths(at, levels[-1] - 1)
    asked = placed.select("id", "x", "y", "z", F.explode(F.array(*[F.substring("path", 1, n) for n in levels])).alias("path"))
    p = v.vec("x", "y", "z")
    met = asked.join(mesh, "path").withColumn("volume", v.dot(a, v.cross(b, c)))
    shares = [v.dot(p, v.cross(q, r)) / F.col("volume") for q, r in ((b, c), (c, a), (a, b))]
    met = met.select("id", "triangle", *[w.alias(f"w{k}") for k, w in enumerate(shares)]).withColumn("w", F.col("w0") + F.col("w1") + F.col("w2"))
    held = met.filter(F.least("w0", "w1", "w2") >= -ON_EDGE * F.col("w")).filter("w > 0")
    first = held.groupBy("id").agg(F.min(F.struct("triangle", (F.col("w1") / F.col("w")).alias("s"), (F.col("w2") / F.col("w")).alias("t"))).alias("f"))
    return points.select("id").join(first, "id", "left").select("id", "f.triangle", "f.s", "f.t")


def walk(points: DataFrame, triangles: DataFrame, starts: DataFrame, most: int = 1000) -> DataFrame:
    """id, triangle, steps: where a walk from face to face ends, for points that each start (id, triangle) somewhere.

    triangles: id, v0, v1, v2 and corners as above, turning the same way, each edge in two of them at most. A step goes over the edge that the
    point lies farthest outside of; the walk ends in the triangle that holds the point, or with null where it would leave
    the mesh. All points step together, one join a step, and those that have arrived leave. Visibility walks end on
    Delaunay meshes; one that is not over after `most` steps gets null, too.
    """
    edge = lambda k: F.struct(F.col(f"v{k}").alias("p"), F.col(f"v{(k + 1) % 3}").alias("q"), F.lit(k).alias("k"))
    half = triangles.select("id", F.explode(F.array(*[edge(k) for k in range(3)])).alias("e")).select("id", "e.*")
    twin = half.select(F.col("id").alias("to"), F.col("p").alias("q"), F.col("q").alias("p"))
    over = half.join(twin, ["p", "q"], "left").groupBy("id").pivot("k", [0, 1, 2]).agg(F.min("to"))
    faces = checkpointed(triangles.select("id", *CORNERS).join(over, "id").withColumnRenamed("id", "triangle"))
    a, b, c = (v.vec(*[f"{p}{k}" for k in "xyz"]) for p in "abc")
    p = v.vec("x", "y", "z")
    turn = F.signum(v.dot(a, v.cross(b, c)))
    out = [turn * v.dot(p, v.cross(q, r)) for q, r in ((a, b), (b, c), (c, a))]
    state = finite(points.select("id", "x", "y", "z"), ("x", "y", "z")).join(starts.select("id", "triangle"), "id")
    done = None
    for step in range(most + 1):
        seen = state.join(faces, "triangle", "left").withColumn("low", F.least(*out))
        next_face = F.when(out[0] == F.col("low"), F.col("0")).when(out[1] == F.col("low"), F.col("1")).otherwise(F.col("2"))
        seen = checkpointed(seen.select("id", "x", "y", "z", "triangle", F.coalesce(F.col("low") >= -ON_EDGE, F.lit(False)).alias("in"), next_face.alias("next")))
        ended = seen.filter("in OR next IS NULL").select("id", F.when(F.col("in"), F.col("triangle")).alias("triangle"), F.lit(step).cast("long").alias("steps"))
        done = ended if done is None else done.unionByName(ended)
        state = seen.filter("NOT in AND next IS NOT NULL").select("id", "x", "y", "z", F.col("next").alias("triangle"))
        if state.isEmpty():
            break
    else:
        done = done.unionByName(state.select("id", F.lit(None).cast("long").alias("triangle"), F.lit(most).cast("long").alias("steps")))
    lost = points.select("id").join(done.select("id"), "id", "left_anti").select("id", F.lit(None).cast("long").alias("triangle"), F.lit(0).cast("long").alias("steps"))
    return done.unionByName(lost)
