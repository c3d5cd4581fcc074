"""Points drawn from surfaces and rasters, by hashes of ids instead of a random state."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import raster
from tessera.operators.topology import corner_vectors, with_corners
from tessera.sources.meshes import Mesh

#: Fixed value: the modulus of the hash, a prime.
PRIME = 2147483647


def uniform(id_: Column, salt: int) -> Column:
    """A number in [0, 1) that the id and the salt decide, the same on every run."""
    h = F.pmod(id_, F.lit(PRIME))
    for k in (48271 + salt, 69621):
        h = ((h * h) % PRIME * k + h * 16807 + salt + 1) % PRIME
    return h / float(PRIME)


def on_sphere(ids: DataFrame) -> DataFrame:
    """id, x, y, z: for each id a point of the unit sphere, evenly spread."""
    turn, z = uniform(F.col("id"), 3) * (2 * math.pi), 2 * uniform(F.col("id"), 4) - 1
    r = F.sqrt(1 - z * z)
    return ids.select("id", (r * F.cos(turn)).alias("x"), (r * F.sin(turn)).alias("y"), z.alias("z"))


def in_rectangle(ids: DataFrame, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """id, x, y, z (0): for each id a point of a rectangle, evenly spread."""
    side = lambda k: F.lit(low[k]) + uniform(F.col("id"), 5 + k) * (high[k] - low[k])
    return ids.select("id", side(0).alias("x"), side(1).alias("y"), F.lit(0.0).alias("z"))


def of_mesh(mesh: Mesh) -> DataFrame:
    """id, x, y, z: the mesh's vertices, such as those of a subdivided sphere or of a file."""
    return mesh.vertices.select("id", "x", "y", "z")


def on_surface(ids: DataFrame, triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, triangle, x, y, z: for each id a point of a triangle; all triangles (ids from 0) are equally likely, points in them evenly spread."""
    n = triangles.count()
    drawn = ids.select("id", F.floor(uniform(F.col("id"), 0) * n).alias("triangle"), F.sqrt(uniform(F.col("id"), 1)).alias("r"), uniform(F.col("id"), 2).alias("s"))
    t = with_corners(triangles, vertices).withColumnRenamed("id", "triangle")
    a, b, c = corner_vectors()
    r, s = F.col("r"), F.col("s")
    p = v.add(v.add(v.scale(a, 1 - r), v.scale(b, r * (1 - s))), v.scale(c, r * s))
    return drawn.join(t, "triangle").select("id", "triangle", *[x.alias(k) for x, k in zip(p, "xyz", strict=True)])


def where_raster(points: DataFrame, pixels: DataFrame, width: int, height: int, least: int) -> DataFrame:
    """The points of the unit sphere (id, x, y, z) where the raster's value is at least the limit."""
    u, w = v.sphere_params(v.vec("x", "y", "z"))
    seen = raster.lookup(points.select("id", u.alias("u"), w.alias("v")), pixels, width, height)
    return points.join(seen.filter(F.col("value") >= least).select("id"), "id", "left_semi")
