"""Linear finite elements and quadrature on triangles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import multilevel
from tessera.operators.ordering import checkpointed
from tessera.operators.topology import corner_vectors, with_corners

# Barycentric points and weights of quadrature rules by order.
RULES = {
    1: [(1 / 3, 1 / 3, 1.0)],
    2: [(1 / 6, 1 / 6, 1 / 3), (2 / 3, 1 / 6, 1 / 3), (1 / 6, 2 / 3, 1 / 3)],
    3: [(1 / 3, 1 / 3, -27 / 48), (0.2, 0.2, 25 / 48), (0.6, 0.2, 25 / 48), (0.2, 0.6, 25 / 48)],
}


def rule(order: int) -> list[tuple[float, float, float]]:
    """A rule that integrates polynomials of the order exactly: the table's, or a collapsed product of Gauss points."""
    if order in RULES:
        return RULES[order]
    x, w = np.polynomial.legendre.leggauss(max(1, order // 2 + 2))
    x, w = (x + 1) / 2, w / 2
    return [(float(s), float(t * (1 - s)), float(2 * a * b * (1 - s))) for s, a in zip(x, w, strict=True) for t, b in zip(x, w, strict=True)]


def stiffness(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """i, j, value: sums of area * grad phi_a . grad phi_b in the plane; a flat triangle adds nothing."""
    t = with_corners(triangles, vertices)
    corner = [(F.col(f"{p}x"), F.col(f"{p}y")) for p in "abc"]
    twice = v.orient2d(*corner)
    grads = [(corner[(k + 1) % 3][1] - corner[(k + 2) % 3][1], corner[(k + 2) % 3][0] - corner[(k + 1) % 3][0]) for k in range(3)]
    entries = F.array(
        *[F.struct(F.col(f"v{p}").alias("i"), F.col(f"v{q}").alias("j"), F.coalesce(F.try_divide(grads[p][0] * grads[q][0] + grads[p][1] * grads[q][1], 2 * F.abs(twice)), F.lit(0.0)).alias("value")) for p in range(3) for q in range(3)]
    )
    return t.select(F.explode(entries).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.value").alias("value"))


def with_dirichlet(matrix: DataFrame, fixed: DataFrame) -> DataFrame:
    """matrix with the rows of fixed vertices (id) replaced by the identity."""
    free = matrix.join(fixed.select(F.col("id").alias("i")), "i", "left_anti")
    return free.unionByName(fixed.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("value")))


def quadrature(triangles: DataFrame, vertices: DataFrame, f: Callable[[v.Vec], Column], order: int = 2, spherical: bool = False) -> DataFrame:
    """id, integral of f over each triangle."""
    a, b, c = corner_vectors()
    area = v.spherical_area(a, b, c) if spherical else v.planar_area(a, b, c)
    total = F.lit(0.0)
    for s, t, w in rule(order):
        p = v.add(v.add(v.scale(a, 1 - s - t), v.scale(b, s)), v.scale(c, t))
        total = total + w * f(v.unit(p) if spherical else p)
    return with_corners(triangles, vertices).select("id", (area * total).alias("integral"))


def sphere_quadrature(triangles: DataFrame, vertices: DataFrame, f: Callable[[v.Vec], Column], order: int = 4) -> DataFrame:
    """id, integral of f over each triangle of the unit sphere, each point weighed by how the map from the flat triangle stretches there.

    A triangle whose plane holds the sphere's middle has no area in this sense and gives 0.
    """
    a, b, c = corner_vectors()
    volume = F.abs(v.dot(a, v.cross(b, c)))
    total = F.lit(0.0)
    for s, t, w in rule(order):
        p = v.add(v.add(v.scale(a, 1 - s - t), v.scale(b, s)), v.scale(c, t))
        size = v.length(p)
        total = total + F.coalesce(w * f(v.unit(p)) * F.try_divide(volume, size * size * size), F.lit(0.0))
    return with_corners(triangles, vertices).select("id", (total / 2).alias("integral"))


def load(triangles: DataFrame, vertices: DataFrame, f: Callable[[v.Vec], Column], order: int = 1) -> DataFrame:
    """i, value: the integral of f times each corner's hat function, by the rule of the order."""
    a, b, c = corner_vectors()
    totals = [F.lit(0.0)] * 3
    for s, t, w in rule(order):
        at = f(v.add(v.add(v.scale(a, 1 - s - t), v.scale(b, s)), v.scale(c, t)))
        totals = [total + (w * hat) * at for total, hat in zip(totals, (1 - s - t, s, t), strict=True)]
    area = v.planar_area(a, b, c)
    dealt = F.array(*[F.struct(F.col(f"v{k}").alias("i"), (area * total).alias("value")) for k, total in enumerate(totals)])
    return with_corners(triangles, vertices).select(F.explode(dealt).alias("e")).groupBy("e.i").agg(F.sum("e.value").alias("value"))


def l2_error(triangles: DataFrame, vertices: DataFrame, values: DataFrame, exact: Callable[[v.Vec], Column]) -> DataFrame:
    """error: the L2 norm of the linear interpolant of values (i, value) minus exact, by the three-point rule."""
    t = with_corners(triangles, vertices)
    for k in range(3):
        t = t.join(values.select(F.col("i").alias(f"v{k}"), F.col("value").alias(f"u{k}")), f"v{k}")
    a, b, c = corner_vectors()
    total = F.lit(0.0)
    for s, r, w in rule(2):
        p = v.add(v.add(v.scale(a, 1 - s - r), v.scale(b, s)), v.scale(c, r))
        gap = F.col("u0") * (1 - s - r) + F.col("u1") * s + F.col("u2") * r - exact(p)
        total = total + w * gap * gap
    return t.agg(F.sqrt(F.sum(v.planar_area(a, b, c) * total)).alias("error"))


def places(vertices: DataFrame) -> DataFrame:
    """i, x, y, z: where the unknowns of the vertices lie."""
    return vertices.select(F.col("id").alias("i"), "x", "y", "z")


def poisson(triangles: DataFrame, vertices: DataFrame, f: Callable[[v.Vec], Column], fixed: DataFrame, tolerance: float = 1e-10, most: int = 100, order: int = 1) -> DataFrame:
    """i, value: the linear solution of -laplace u = f with given values (id, value) at the fixed vertices.

    Known values move to the right side, so that the system over the free vertices stays symmetric for conjugate gradients. Vertices
    of no triangle have no row, unless they are fixed.
    """
    k = checkpointed(stiffness(triangles, vertices))
    known = checkpointed(fixed.select(F.col("id").alias("i"), "value"))
    free = lambda df, c: df.join(known.select(F.col("i").alias(c)), c, "left_anti")
    moved = free(k, "i").join(known.select(F.col("i").alias("j"), F.col("value").alias("u")), "j").select("i", (-F.col("value") * F.col("u")).alias("value"))
    right = free(load(triangles, vertices, f, order), "i").select("i", "value").unionByName(moved).groupBy("i").agg(F.sum("value").alias("value"))
    inner = free(free(k, "i"), "j").select("i", "j", "value")
    found, _ = multilevel.solve(inner, right, tolerance, most, places=places(vertices))
    return found.unionByName(known.select("i", "value"))


def boundary_flux(vertices: DataFrame, lines: DataFrame, flux: Column) -> DataFrame:
    """i, value: the integral of a flux, constant along each line (v0, v1, group), times each end's hat function."""
    at = lambda c: vertices.select(F.col("id").alias(c), *[F.col(k).alias(f"{c}{k}") for k in "xyz"])
    both = lines.join(at("v0"), "v0").join(at("v1"), "v1")
    length = v.length(v.sub(*[tuple(F.col(f"{c}{k}") for k in "xyz") for c in ("v1", "v0")]))
    dealt = both.select(F.explode(F.array("v0", "v1")).alias("i"), (flux * length / 2).alias("value"))
    return dealt.groupBy("i").agg(F.sum("value").alias("value"))


def potential_flow(triangles: DataFrame, vertices: DataFrame, lines: DataFrame, speed: float = 1.0, tolerance: float = 1e-10, most: int = 100) -> tuple[DataFrame, int]:
    """(i, value), rounds: the potential of a flow that leaves at the speed through the lines (v0, v1, group) of group 1 and enters through those of 3.

    Nothing passes any other edge of the boundary. A potential is given up to a constant: its mean over the vertices is 0. If more
    enters than leaves, the difference is taken from all vertices alike. The domain hangs together; vertices of no triangle have no row.
    """
    k = checkpointed(stiffness(triangles, vertices))
    flux = F.when(F.col("group") == 1, speed).when(F.col("group") == 3, -speed).otherwise(0.0)
    right = boundary_flux(vertices, lines, flux).join(k.select("i").distinct(), "i", "left_semi")
    return multilevel.solve(k, right, tolerance, most, singular=True, places=places(vertices))


def triangle_gradients(triangles: DataFrame, vertices: DataFrame, values: DataFrame) -> DataFrame:
    """id, gx, gy: the gradient of the linear interpolant of values (i, value) in each triangle of the plane; null in a flat one."""
    t = with_corners(triangles, vertices)
    for k in range(3):
        t = t.join(values.select(F.col("i").alias(f"v{k}"), F.col("value").alias(f"u{k}")), f"v{k}")
    twice = v.orient2d(*[(F.col(f"{p}x"), F.col(f"{p}y")) for p in "abc"])
    gx = (F.col("u0") * (F.col("by") - F.col("cy")) + F.col("u1") * (F.col("cy") - F.col("ay")) + F.col("u2") * (F.col("ay") - F.col("by")))
    gy = (F.col("u0") * (F.col("cx") - F.col("bx")) + F.col("u1") * (F.col("ax") - F.col("cx")) + F.col("u2") * (F.col("bx") - F.col("ax")))
    return t.select("id", F.try_divide(gx, twice).alias("gx"), F.try_divide(gy, twice).alias("gy"))


def vertex_gradients(triangles: DataFrame, vertices: DataFrame, values: DataFrame) -> DataFrame:
    """id, gx, gy: the plain mean over the triangles around each vertex of their gradients, flat ones left out; null where all are flat."""
    each = triangle_gradients(triangles, vertices, values).join(triangles, "id")
    return each.select(F.explode(F.array("v0", "v1", "v2")).alias("id"), "gx", "gy").groupBy("id").agg(F.avg("gx").alias("gx"), F.avg("gy").alias("gy"))


def at_nodes(triangles: DataFrame, vertices: DataFrame, order: int, f: Callable[[v.Vec], Column]) -> DataFrame:
    """id, node, value: f at the evenly spaced reference nodes of each triangle, row by row from its first corner; order 0 has its middle."""
    a, b, c = corner_vectors()
    steps = [(1 / 3, 1 / 3)] if order == 0 else [(s / order, r / order) for r in range(order + 1) for s in range(order + 1 - r)]
    at = [v.add(v.add(v.scale(a, 1 - s - r), v.scale(b, s)), v.scale(c, r)) for s, r in steps]
    nodes = F.array(*[F.struct(F.lit(k).cast("long").alias("node"), f(p).alias("value")) for k, p in enumerate(at)])
    return with_corners(triangles, vertices).select("id", F.explode(nodes).alias("n")).select("id", "n.node", "n.value")
