"""Solutions over meshes: multilevel solves, Poisson problems, potential flows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import fem, multilevel, topology
from tessera.sources import meshes


def _path(spark, n):
    """A chain of n unknowns, 2 on the diagonal and -1 beside it."""
    i = F.col("i")
    rows = spark.range(n).select(F.col("id").alias("i")).select("i", F.explode(F.array(i - 1, i, i + 1)).alias("j"))
    return rows.filter(f"j >= 0 AND j < {n}").select("i", "j", F.when(i == F.col("j"), 2.0).otherwise(-1.0).alias("value"))


def test_gatherings_cover_all_nodes_around_roots_three_apart(spark):
    rng = np.random.default_rng(2)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 60, size=(90, 2)).tolist() if p[0] != p[1]}
    near = {k: {k} for k in range(62)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    rows = [(a, b, 1.0 + (a + b) % 5) for p in pairs for a, b in (p, p[::-1])]
    links = spark.createDataFrame(rows, "i long, j long, weight double")
    got = {r["i"]: r["root"] for r in multilevel.aggregates(spark.range(62).withColumnRenamed("id", "i"), links).collect()}
    roots = {i for i, r in got.items() if i == r}
    within = {k: set().union(*(near[m] for m in near[k])) for k in near}
    assert set(got) == set(range(62)) and set(got.values()) == roots and {60, 61} <= roots
    assert all(within[r] & roots == {r} for r in roots)
    assert all(got[i] in within[i] for i in got)
    assert all(got[i] == r for r in roots for i in near[r])


def test_solutions_of_all_kinds_of_systems(spark):
    n = 60
    a = _path(spark, n)
    m = 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    right = [(k, float(k % 7 - 3)) for k in range(n)] + [(100, 5.0)]
    b = spark.createDataFrame(right, "i long, value double")
    want = np.linalg.solve(m, [value for _, value in right[:n]])
    x, taken = multilevel.solve(a, b, 1e-11)
    got = {r["i"]: r["value"] for r in x.collect()}
    assert got.pop(100) == pytest.approx(5.0) and [got[k] for k in range(n)] == pytest.approx(want, abs=1e-7) and taken <= 3
    empty, taken = multilevel.solve(a.limit(0), b.limit(0))
    assert (empty.count(), taken) == (0, 0)
    # The same chain without held ends: constants are its null space.
    loose = a.withColumn("value", F.when((F.col("i") == F.col("j")) & F.col("i").isin(0, n - 1), 1.0).otherwise(F.col("value")))
    x, taken = multilevel.solve(loose, b.filter("i < 60"), 1e-8, dense=30, singular=True)
    got = np.array([r["value"] for r in x.orderBy("i").collect()])
    r = np.array([value for _, value in right[:n]])
    m[0, 0] = m[-1, -1] = 1
    assert taken <= 15 and abs(got.mean()) < 1e-8 and m @ got == pytest.approx(r - r.mean(), abs=1e-5)


def test_errors_fall_with_the_square_of_the_spacing(spark):
    exact = lambda p: F.sin(math.pi * p[0]) * F.sin(math.pi * p[1]) + p[0]
    errors, taken = [], []
    for n in (8, 16):
        m = meshes.grid(spark, n, n)
        edge = m.vertices.filter("x = 0 OR x = 1 OR y = 0 OR y = 1").select("id", exact(v.vec("x", "y", "z")).alias("value"))
        seen = multilevel.solve

        def told(*args, seen=seen, **names):
            out = seen(*args, **names)
            taken.append(out[1])
            return out

        multilevel.solve = told
        try:
            u = fem.poisson(m.triangles, m.vertices, lambda p: 2 * math.pi**2 * F.sin(math.pi * p[0]) * F.sin(math.pi * p[1]), edge, 1e-6, order=4)
        finally:
            multilevel.solve = seen
        errors.append(fem.l2_error(m.triangles, m.vertices, u, exact).first()[0])
    assert 1.9 < math.log2(errors[0] / errors[1]) < 2.1
    assert max(taken) <= 2  # 49 and 225 unknowns are one level each


def test_flow_around_a_cylinder(spark):
    radius, speed = 0.01, 2.0
    m = meshes.squircle(spark, radius, 14, 8, half=True)
    assert topology.boundary_edges(m.triangles).count() == m.lines.count()
    edge = m.lines.select(F.least("v0", "v1").alias("a"), F.greatest("v0", "v1").alias("b"))
    assert edge.join(topology.boundary_edges(m.triangles), ["a", "b"]).count() == m.lines.count()
    assert {r["group"]: r["n"] for r in m.lines.groupBy("group").agg(F.count("*").alias("n")).collect()} == {1: 4, 2: 60 - 8, 3: 4}
    u, taken = fem.potential_flow(m.triangles, m.vertices, m.lines, speed)
    at = m.vertices.withColumnRenamed("id", "i").join(u, "i").toPandas()
    r2 = at["x"] ** 2 + at["y"] ** 2
    exact = speed * at["x"] * (1 + radius**2 / r2)
    gap = at["value"] - exact
    assert len(at) == 15 * 17 and abs(at["value"].mean()) < 1e-9 and taken <= 3
    assert (gap - gap.mean()).abs().max() < 0.02
    far = fem.triangle_gradients(m.triangles, m.vertices, u).toPandas()
    assert far["gx"].median() == pytest.approx(speed, rel=0.02)


def test_what_enters_too_much_is_spread(spark):
    m = meshes.grid(spark, 4, 4)
    lines = spark.createDataFrame([(k * 5, k * 5 + 5, 3) for k in range(4)], "v0 long, v1 long, group int")
    u, _ = fem.potential_flow(m.triangles, m.vertices, lines)
    assert u.count() == 25 and abs(u.agg(F.avg("value")).first()[0]) < 1e-10
    lone = m.vertices.unionByName(spark.createDataFrame([(99, 5.0, 5.0, 0.0)], m.vertices.schema))
    assert fem.potential_flow(m.triangles, lone, lines)[0].count() == 25
    still, _ = fem.potential_flow(m.triangles, m.vertices, lines.limit(0))
    assert {r["value"] for r in still.collect()} == {0.0}


def test_pointwise_stretch_integrates_over_the_sphere(spark):
    corners = [(0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0), (3, -1.0, 0.0, 0.0)]
    vertices = spark.createDataFrame(corners, "id long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 1, 3)], "id long, v0 long, v1 long, v2 long")
    for f, want in ((lambda p: F.lit(1.0), math.pi / 2), (lambda p: p[2], math.pi / 4), (lambda p: p[0] * p[0], math.pi / 6)):
        got = {r["id"]: r["integral"] for r in fem.sphere_quadrature(faces, vertices, f, 12).collect()}
        assert got[0] == pytest.approx(want, rel=1e-4) and got[1] == 0
