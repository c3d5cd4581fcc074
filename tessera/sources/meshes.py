"""Generated meshes: grids, subdivided polyhedra, the squircle.

Vertices are (id, x, y, z); triangles (id, v0, v1, v2), quads (id, v0 .. v3),
polygons (id, vertices). Ids follow from the generating formula.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as v


@dataclass
class Mesh:
    vertices: DataFrame
    triangles: DataFrame | None = None
    quads: DataFrame | None = None
    polygons: DataFrame | None = None
    lines: DataFrame | None = None


def grid(spark: SparkSession, nx: int, ny: int) -> Mesh:
    """(nx + 1)(ny + 1) vertices of the unit square, row by row, with quads, triangles (two a quad) and polygons."""
    k = F.col("id")
    i, j = k % (nx + 1), F.floor(k / (nx + 1))
    vertices = spark.range((nx + 1) * (ny + 1)).select("id", (i / F.lit(float(nx))).alias("x"), (j / F.lit(float(ny))).alias("y"), F.lit(0.0).alias("z"))
    first = F.floor(k / nx) * (nx + 1) + k % nx
    corners = [first, first + 1, first + nx + 2, first + nx + 1]
    quads = spark.range(nx * ny).select("id", *[c.cast("long").alias(f"v{n}") for n, c in enumerate(corners)])
    halves = F.array(F.struct(F.lit(0).alias("h"), F.col("v0").alias("a"), F.col("v1").alias("b"), F.col("v3").alias("c")), F.struct(F.lit(1).alias("h"), F.col("v1").alias("a"), F.col("v2").alias("b"), F.col("v3").alias("c")))
    triangles = quads.select("id", F.explode(halves).alias("t")).select(
        (F.col("id") * 2 + F.col("t.h")).alias("id"), F.col("t.a").alias("v0"), F.col("t.b").alias("v1"), F.col("t.c").alias("v2")
    )
    polygons = quads.select("id", F.array("v0", "v1", "v2", "v3").alias("vertices"))
    return Mesh(vertices, triangles, quads, polygons)


def _icosahedron() -> tuple[list[tuple], list[tuple]]:
    t = (1 + math.sqrt(5)) / 2
    points = [p for s in (1, -1) for r in (t, -t) for p in ((s, r, 0.0), (0.0, s, r), (r, 0.0, s))]
    near = [(a, b, c) for a in range(12) for b in range(a + 1, 12) for c in range(b + 1, 12) if all(abs(math.dist(points[p], points[q]) - 2) < 1e-9 for p, q in ((a, b), (b, c), (a, c)))]
    return points, near


def _octahedron() -> tuple[list[tuple], list[tuple]]:
    points = [tuple(float(s * (k == i)) for k in range(3)) for i in range(3) for s in (1, -1)]
    return points, [(a, b, c) for a in (0, 1) for b in (2, 3) for c in (4, 5)]


def subdivided_sphere(spark: SparkSession, level: int, kind: str = "icosahedron") -> Mesh:
    """A polyhedron whose triangles are split in four at their edges' middles, level times, on the unit sphere.

    A vertex is known by its coordinates rounded to 12 digits while splitting, so
    no lookup of edges is needed; ids are assigned once at the end by a hash-free
    order of the coordinates.
    """
    points, faces = _icosahedron() if kind == "icosahedron" else _octahedron()
    norm = math.sqrt(sum(c * c for c in points[0]))
    points = [tuple(c / norm for c in p) for p in points]

    def outward(f):
        a, b, c = (points[k] for k in f)
        n = ((b[1] - a[1]) * (c[2] - a[2]) - (b[2] - a[2]) * (c[1] - a[1]), (b[2] - a[2]) * (c[0] - a[0]) - (b[0] - a[0]) * (c[2] - a[2]), (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        return f if sum(p * q for p, q in zip(n, a)) > 0 else (f[0], f[2], f[1])

    corner = "struct<x:double,y:double,z:double>"
    tri = spark.createDataFrame([(k, *(points[c] for c in outward(f))) for k, f in enumerate(faces)], f"id long, a {corner}, b {corner}, c {corner}")

    def middle(p: str, q: str):
        s = v.unit(tuple(F.col(f"{p}.{k}") + F.col(f"{q}.{k}") for k in "xyz"))
        return F.struct(*[c.alias(k) for c, k in zip(s, "xyz", strict=True)])

    for _ in range(level):
        tri = tri.select("*", middle("a", "b").alias("ab"), middle("b", "c").alias("bc"), middle("c", "a").alias("ca"))
        parts = [("a", "ab", "ca"), ("ab", "b", "bc"), ("ca", "bc", "c"), ("ab", "bc", "ca")]
        tri = tri.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), *[F.col(p).alias(k) for p, k in zip(t, "abc", strict=True)]) for n, t in enumerate(parts)])).alias("t"))
        tri = tri.select((F.col("id") * 4 + F.col("t.n")).alias("id"), "t.a", "t.b", "t.c")
    near = lambda p: F.concat_ws(",", *[F.format_string("%.10f", F.col(f"{p}.{k}") + F.lit(0.0) * 0) for k in "xyz"])
    keyed = tri.select("id", *[F.regexp_replace(near(p), "-0\\.0000000000", "0.0000000000").alias(f"k{p}") for p in "abc"], "a", "b", "c")
    corners = keyed.select(F.explode(F.array(*[F.struct(F.col(f"k{p}").alias("key"), F.col(p).alias("p")) for p in "abc"])).alias("s"))
    vertices = corners.groupBy("s.key").agg(F.min("s.p").alias("p"))
    from tessera.operators.ordering import numbered

    numbers = numbered(vertices, ["key"], "n")
    out = keyed.select("id", "ka", "kb", "kc")
    for n, p in enumerate("abc"):
        out = out.join(numbers.select(F.col("key").alias(f"k{p}"), F.col("n").alias(f"v{n}")), f"k{p}")
    return Mesh(numbers.select(F.col("n").alias("id"), "p.x", "p.y", "p.z"), out.select("id", "v0", "v1", "v2"))


def squircle(spark: SparkSession, radius: float, nr: int, nt: int, half: bool = False) -> Mesh:
    """The square [-1, 1]^2 without a disc: nr rings of 4 nt sectors from the circle to the square's outline; half: what lies above y = 0.

    Lines are the boundary edges: group 1 on the right side, 3 on the left, 2 elsewhere.
    """
    n = 2 * nt if half else 4 * nt  # sectors
    w = n + 1 if half else n  # vertices a ring
    step = math.pi / (2 * nt)
    k = F.col("id")
    ring, sector = F.floor(k / w), k % w
    theta = sector * step
    reach = 1 / F.greatest(F.abs(F.cos(theta)), F.abs(F.sin(theta)))
    r = radius + (reach - radius) * ring / float(nr)
    vertices = spark.range((nr + 1) * w).select("id", (r * F.cos(theta)).alias("x"), (r * F.sin(theta)).alias("y"), F.lit(0.0).alias("z"))
    first = F.floor(k / n) * w + k % n
    after = F.floor(k / n) * w + (k % n + 1) % w
    quads = spark.range(nr * n).select("id", first.alias("v0"), (first + w).alias("v1"), (after + w).alias("v2"), after.alias("v3"))
    halves = F.array(F.struct(F.lit(0).alias("h"), F.col("v0").alias("a"), F.col("v1").alias("b"), F.col("v2").alias("c")), F.struct(F.lit(1).alias("h"), F.col("v0").alias("a"), F.col("v2").alias("b"), F.col("v3").alias("c")))
    triangles = quads.select("id", F.explode(halves).alias("t")).select((F.col("id") * 2 + F.col("t.h")).alias("id"), F.col("t.a").alias("v0"), F.col("t.b").alias("v1"), F.col("t.c").alias("v2"))
    lines = spark.range(n).select(k.alias("v0"), ((k + 1) % w).alias("v1"), F.lit(2).alias("group"))
    middle = (k + 0.5) * step
    side = F.when(F.cos(middle) > F.abs(F.sin(middle)), 1).when(-F.cos(middle) > F.abs(F.sin(middle)), 3).otherwise(2)
    lines = lines.unionByName(spark.range(n).select((k + nr * w).alias("v0"), ((k + 1) % w + nr * w).alias("v1"), side.alias("group")))
    if half:
        for s in (0, n):
            lines = lines.unionByName(spark.range(nr).select((k * w + s).alias("v0"), ((k + 1) * w + s).alias("v1"), F.lit(2).alias("group")))
    return Mesh(vertices, triangles, quads, None, lines)
