import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import adaptation, calculus, fem, neighbours, ordering, polygons, restricted, sparse, topology, trees, voronoi
from tessera.sources import formats, meshes


def points(spark, n, dim=3, sphere=True, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, 3)) if sphere else np.random.default_rng(seed).random((n, 3))
    if sphere:
        x /= np.linalg.norm(x, axis=1)[:, None]
    else:
        x[:, 2] = 0
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, x double, y double, z double")


def test_nearest_is_exact(spark):
    x, df = points(spark, 200)
    got = {}
    for r in trees.nearest(df, df, 6, ("x", "y", "z")).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    for i in range(len(x)):
        want = np.argsort(((x - x[i]) ** 2).sum(axis=1), kind="stable")[:6].tolist()
        assert [got[i][k] for k in range(6)] == want


def test_nearest_sets_aside_what_has_no_place(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, None, 0.0), (4, float("nan"), 1.0), (5, float("inf"), 1.0)], "id long, x double, y double")
    got = trees.nearest(df, df, 2, ("x", "y")).collect()
    assert sorted((r["id"], r["rank"], r["neighbour"]) for r in got) == [(1, 0, 1), (1, 1, 2), (2, 0, 2), (2, 1, 1)]


def test_locate_against_brute_force(spark):
    r = np.random.default_rng(5)
    corners, p = r.random((60, 3, 2)), r.random((80, 2)) * 1.2
    t = spark.createDataFrame([(i, *map(float, c.ravel())) for i, c in enumerate(corners)], "id long, ax double, ay double, bx double, by double, cx double, cy double")
    q = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double")
    got = {x["id"]: x["triangle"] for x in neighbours.locate(q, t, 0.2).collect()}
    cross = lambda u, w: u[0] * w[1] - u[1] * w[0]
    for i, x in enumerate(p):
        sides = [[cross(c[(k + 1) % 3] - c[k], x - c[k]) for k in range(3)] for c in corners]
        inside = [k for k, s in enumerate(sides) if min(s) >= 0 or max(s) <= 0]
        assert got[i] == (inside[0] if inside else None)


@pytest.mark.parametrize("shuffled", [True, False])
def test_components_of_a_long_path(spark, shuffled):
    ids = np.arange(3000)
    if shuffled:
        np.random.default_rng(2).shuffle(ids)
    rows = [(int(a), int(b)) for a, b in zip(ids, ids[1:])] + [(5000, 5000), (5002, 5001), (None, 7)]
    got = {r["id"]: r["label"] for r in topology.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(3000), 0), 5000: 5000, 5001: 5001, 5002: 5001}
    assert topology.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_extraction_renumbers(spark):
    m = meshes.grid(spark, 3, 2)
    faces, vertices = topology.extracted(m.triangles, m.triangles.filter("id % 3 = 1"))
    was = {r["id"]: r["was"] for r in vertices.collect()}
    kept = [r for r in m.triangles.orderBy("id").collect() if r["id"] % 3 == 1]
    got = faces.orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(len(kept))) and sorted(was) == list(range(len(was)))
    assert [[was[r[c]] for c in ("v0", "v1", "v2")] for r in got] == [[r[c] for c in ("v0", "v1", "v2")] for r in kept]


def test_numbering_follows_the_order(spark):
    _, df = points(spark, 300)
    got = [r["n"] for r in ordering.numbered(df, ["x", "id"], "n").orderBy("x", "id").collect()]
    assert got == list(range(300))


def test_morton_corners(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 1.0, 1.0, 0.0)], "id long, x double, y double, z double")
    assert [r["id"] for r in ordering.z_order(df).orderBy("place").collect()] == [0, 2, 1, 3]


@pytest.mark.parametrize("n", [60])
def test_sphere_diagram_covers_the_sphere(spark, n):
    x, df = points(spark, n)
    cells = voronoi.diagram(df).cache()
    assert cells.agg(F.sum("volume")).first()[0] == pytest.approx(4 * math.pi, abs=1e-9)
    triples = voronoi.delaunay(cells).collect()
    assert len(triples) == 2 * n - 4
    for t in triples:  # no other site is nearer to the vertex than its three
        a, b, c = (x[t[k]] for k in "ijk")
        w = np.cross(b - a, c - a)
        w /= np.linalg.norm(w)
        side = (x - a) @ w
        assert side.max() < 1e-9 or side.min() > -1e-9
    assert voronoi.facets(cells).count() == 3 * n - 6


def test_heavy_sites_elsewhere_do_not_keep_a_cell_open(spark):
    grid = np.array([(0.1 * i, 0.1 * j, 0.0) for i in range(-4, 5) for j in range(-4, 5) if i or j])
    near = np.stack([grid[np.argsort((grid**2).sum(axis=1), kind="stable")]] * 2)
    weight = np.stack([np.zeros(len(grid)), np.full(len(grid), 0.5)])
    box = voronoi.Domain(sphere=False, low=(-9.0, -9.0), high=(9.0, 9.0))
    got = voronoi.clip(np.zeros((2, 3)), np.array([0.0, 0.5]), near, weight, np.ones(weight.shape, dtype=bool), box)
    assert got["done"].all()
    assert voronoi.measures(got["points"], got["count"], False)[0] == pytest.approx([0.01, 0.01])


def test_plane_diagram_and_exact_gradient(spark):
    _, df = points(spark, 40, sphere=False)
    domain = voronoi.Domain(sphere=False)
    cells = voronoi.diagram(df, domain).cache()
    assert cells.agg(F.sum("volume")).first()[0] == pytest.approx(1.0, abs=1e-12)
    facets = voronoi.facets(cells, domain)
    sites = cells.select("id", "x", "y", "z", "volume", (0.5 * F.col("x") + 1.25 * F.col("y")).alias("f"))
    edge = {r["bi"] for r in facets.filter("bj IS NULL").collect()}
    for r in calculus.gradient(facets, sites, "f").collect():
        if r["id"] not in edge:
            assert (r["gx"], r["gy"]) == pytest.approx((0.5, 1.25), abs=1e-9)


def test_subdivided_spheres(spark):
    m = meshes.subdivided_sphere(spark, 1, "octahedron")
    a, b, c = topology.corner_vectors()
    assert m.triangles.count() == 32 and m.vertices.count() == 18
    assert topology.with_corners(m.triangles, m.vertices).agg(F.sum(v.spherical_area(a, b, c))).first()[0] == pytest.approx(4 * math.pi, abs=1e-9)
    assert topology.boundary_edges(m.triangles).isEmpty()


def test_squircle_area(spark):
    m = meshes.squircle(spark, 0.1, 4, 20)
    a, b, c = topology.corner_vectors()
    area = topology.with_corners(m.triangles, m.vertices).agg(F.sum(v.planar_area(a, b, c))).first()[0]
    assert area == pytest.approx(4 - math.pi * 0.01, abs=1e-3)
    assert {r["group"]: r["n"] for r in m.lines.groupBy("group").agg(F.count("*").alias("n")).collect()}.keys() == {1, 2, 3}


def test_loops_and_components(spark):
    e = spark.createDataFrame([(1, 5), (5, 3), (3, 1), (2, 7), (7, 2)], "p long, q long")
    got = {(r["loop"], r["place"]): r["p"] for r in topology.loops(e).collect()}
    assert got == {(1, 0): 1, (1, 1): 5, (1, 2): 3, (2, 0): 2, (2, 1): 7}


def test_sparse_solve_and_product(spark):
    a = spark.createDataFrame([(0, 0, 4.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 3.0)], "i long, j long, value double")
    b = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, value double")
    x = dict(sparse.conjugate_gradient(a, b, 1e-12).collect())
    assert (x[0], x[1]) == pytest.approx((1 / 11, 7 / 11))
    c = {(r["i"], r["j"]): r["value"] for r in sparse.spmm(a, a).collect()}
    assert c == {(0, 0): 17.0, (0, 1): 7.0, (1, 0): 7.0, (1, 1): 10.0}


def test_obj_round_trip(spark, tmp_path):
    m = meshes.grid(spark, 3, 2)
    formats.write_obj(meshes.Mesh(m.vertices, m.triangles), str(tmp_path / "mesh"))
    back = formats.read_obj(spark, str(tmp_path / "mesh"))
    assert back.vertices.count() == 12 and back.triangles.count() == 12
    same = back.triangles.join(m.triangles, ["id", "v0", "v1", "v2"])
    assert same.count() == 12


def test_merging_chains(spark):
    df = spark.createDataFrame([(3, 0.0, 0.0, 0.0), (1, 0.009, 0.0, 0.0), (2, 0.018, 0.0, 0.0), (4, 0.5, 0.5, 0.5)], "id long, x double, y double, z double")
    assert dict(topology.merge_map(df, 0.01).collect()) == {1: 1, 2: 1, 3: 1, 4: 4}


def test_ears_cover_concave_polygons():
    p = np.array([(0, 0), (2, 0), (2, 2), (1, 0.5), (0, 2), (-1, 1), (0.2, 0.8)], dtype=float)
    area = lambda q: 0.5 * abs((q[:, 0] * np.roll(q[:, 1], -1) - np.roll(q[:, 0], -1) * q[:, 1]).sum())
    for q in (p, p[::-1]):
        found = polygons.ears(q)
        assert len(found) == 5 and sum(area(q[list(t)]) for t in found) == pytest.approx(area(q))


def test_flips_and_splits_keep_the_area(spark):
    m = meshes.grid(spark, 4, 4)
    inner = "CASE WHEN x > 0 AND x < 1 AND y > 0 AND y < 1 THEN {0} + (id * {1} % 7 - 3) * 0.03 ELSE {0} END AS {0}"
    points = m.vertices.selectExpr("id", inner.format("x", 3), inner.format("y", 5), "z").cache()
    a, b, c = topology.corner_vectors()
    area = lambda t, p: topology.with_corners(t, p).agg(F.sum(v.planar_area(a, b, c))).first()[0]
    worst = lambda t, p: topology.with_corners(t, p).agg(F.min(v.quality(a, b, c, v.planar_area(a, b, c)))).first()[0]
    flipped = adaptation.flip_round(m.triangles, points)
    assert flipped.count() == 32 and area(flipped, points) == pytest.approx(1)
    assert worst(flipped, points) >= worst(m.triangles, points) - 1e-12
    faces, more = adaptation.split_round(m.triangles, points, 0.3)
    assert area(faces, more) == pytest.approx(1) and faces.count() > 32
    assert faces.count() - 32 == 2 * (more.count() - 25)
    assert topology.boundary_edges(faces).count() == 16


def test_restricted_cells_cover_the_surface(spark):
    x, df = points(spark, 40)
    m = meshes.subdivided_sphere(spark, 1)
    found = restricted.diagram(m.triangles, m.vertices, df, 4).cache()
    a, b, c = topology.corner_vectors()
    area = {r["id"]: r["a"] for r in topology.with_corners(m.triangles, m.vertices).select("id", v.planar_area(a, b, c).alias("a")).collect()}
    got = {r["triangle"]: r["a"] for r in found.groupBy("triangle").agg(F.sum("area").alias("a")).collect()}
    assert got == pytest.approx(area)
    for r in found.filter("area > 1e-9").collect():  # a piece's middle is nearest to its site
        p = np.array([r["mx"], r["my"], r["mz"]]) / r["area"]
        assert np.argmin(((x - p) ** 2).sum(axis=1)) == r["site"]


@pytest.mark.parametrize("order", [1, 2, 3, 5, 8, 10])
def test_quadrature_is_exact(order):
    for i in range(order + 1):
        for j in range(order + 1 - i):
            want = 2 * math.factorial(i) * math.factorial(j) / math.factorial(i + j + 2)
            assert sum(w * s**i * t**j for s, t, w in fem.rule(order)) == pytest.approx(want)


def test_bicgstab(spark):
    a = spark.createDataFrame([(0, 0, 4.0), (0, 1, 1.0), (1, 0, 2.0), (1, 1, 3.0)], "i long, j long, value double")
    b = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, value double")
    x = dict(sparse.bicgstab(a, b, 1e-12).collect())
    assert (x[0], x[1]) == pytest.approx((0.1, 0.6))


def test_what_has_no_size_is_null_and_breaks_nothing(spark):
    zero = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 2.0, 2.0)], "id long, x double, y double, z double")
    x, y, z = v.unit(v.vec("x", "y", "z"))
    assert [tuple(r) for r in zero.select(x, y, z).collect()] == [(None, None, None), (1 / 3, 2 / 3, 2 / 3)]
    normal, offset = v.bisector(v.vec("x", "y", "z"), v.vec("x", "y", "z"), F.lit(1.0), F.lit(2.0))
    assert [tuple(r) for r in zero.select(*normal, offset).collect()] == [(None,) * 4] * 2
    flat = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 2.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0)], "id long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 1, 3)], "id long, v0 long, v1 long, v2 long")
    k = {(r["i"], r["j"]): r["value"] for r in fem.stiffness(faces, flat).collect()}
    assert k[(2, 2)] == 0.0 and k[(0, 0)] == 1.0
    values = flat.select(F.col("id").alias("i"), F.col("y").alias("value"))
    assert {r["id"]: (r["gx"], r["gy"]) for r in fem.triangle_gradients(faces, flat, values).collect()} == {0: (None, None), 1: (0.0, 1.0)}
    a, b, c = topology.corner_vectors()
    dots = spark.createDataFrame([(0, 0, 0, 0)], "id long, v0 long, v1 long, v2 long")
    assert topology.with_corners(dots, flat).select(v.quality(a, b, c, v.planar_area(a, b, c))).first()[0] is None
    sizes = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0), (2.0, 2.0), (1.0, 2.0)], "p double, q double")
    got = [r[0] for r in sizes.select(adaptation.size_between(F.col("p"), F.col("q"))).collect()]
    assert got[:3] == [0.0, 0.0, 2.0] and abs(got[3] - 1 / math.log(2)) < 1e-12
    at = spark.createDataFrame([(9, 0.2, 0.2), (8, 0.5, 0.0)], "id long, x double, y double")
    t = topology.with_corners(faces, flat)
    assert {r["id"]: r["triangle"] for r in neighbours.locate(at, t, 1.0).collect()} == {9: 1, 8: 1}


def test_open_chains_rings_and_pinches(spark):
    def chains(*edges):
        rows = topology.loops(spark.createDataFrame(list(edges), "p long, q long")).collect()
        return sorted((r["loop"], r["closed"], r["place"], r["p"], r["q"]) for r in rows)

    assert chains((1, 2), (2, 3)) == [(1, False, 0, 1, 2), (1, False, 1, 2, 3)]
    assert chains((5, 3), (3, 4), (4, 5)) == [(3, True, 0, 3, 4), (3, True, 1, 4, 5), (3, True, 2, 5, 3)]
    # A chain that runs into a ring: the ring goes on from the least of what comes in.
    lead = chains((9, 2), (1, 2), (2, 1))
    assert [c for c in lead if c[1]] == [(1, True, 0, 1, 2), (1, True, 1, 2, 1)] and (2, False, 0, 9, 2) in lead
    pinch = chains((1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3), (3, 1))
    assert len(pinch) == 6 and all(c[1] for c in pinch)
    long = [(k, k + 1) for k in range(500)]
    assert [c[2:] for c in chains(*reversed(long))] == [(k, k, k + 1) for k in range(500)]


def test_solvers_return_every_unknown(spark):
    def system(a, b):
        return spark.createDataFrame([(i, j, float(x)) for (i, j), x in a.items()], "i long, j long, value double"), spark.createDataFrame(list(b.items()), "i long, value double")

    a, b = system({(0, 1): 1, (1, 0): 1, (2, 2): 2}, {0: 3.0, 1: 4.0, 2: 6.0})  # no diagonal in two rows
    assert {r["i"]: round(r["value"], 6) for r in sparse.bicgstab(a, b).collect()} == {0: 4.0, 1: 3.0, 2: 3.0}
    assert sorted(r["i"] for r in sparse.conjugate_gradient(a, b).collect()) == [0, 1, 2]
    a, b = system({(0, 0): 2, (1, 1): 4, (0, 1): 1, (1, 0): 1}, {0: 2.0})  # a row of A that b lacks
    got = {r["i"]: r["value"] for r in sparse.conjugate_gradient(a, b).collect()}
    assert abs(got[0] - 8 / 7) < 1e-6 and abs(got[1] + 2 / 7) < 1e-6


def test_merging_many_copies(spark):
    rows = [(k, 0.5, 0.5) for k in range(3000)] + [(5000, 0.505, 0.5), (5001, 0.9, 0.9)]
    got = {r["id"]: r["to"] for r in topology.merge_map(spark.createDataFrame(rows, "id long, x double, y double"), 0.01, ("x", "y")).collect()}
    assert got == {k: 0 for k in range(3000)} | {5000: 0, 5001: 5001}
