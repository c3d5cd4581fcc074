import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import matrices
from tessera.functions import vectors as v
from tessera.operators import adaptation, fem, neighbours, topology, voronoi
from tessera.sources import formats, meshes, sampling


def sphere(spark, n, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, x double, y double, z double")


def test_diagram_as_a_mesh(spark):
    _, df = sphere(spark, 60)
    cells = voronoi.diagram(df).cache()
    vertices, polygons = voronoi.shared_mesh(cells)
    assert vertices.count() == 2 * 60 - 4 and polygons.count() == 60
    assert topology.boundary_edges(polygons).isEmpty()
    report = topology.manifold_report(polygons).first()
    assert report["edges"] == 3 * 60 - 6 and report["non_manifold"] == 0
    row = voronoi.statistics(cells).first()
    assert row["cells"] == 60 and row["incomplete"] == 0 and row["corners"] == 6 * 60 - 12 and row["area"] == pytest.approx(4 * math.pi)


@pytest.mark.parametrize("sites", ["tetrahedron", "octahedron"])
def test_large_cells_are_whole(spark, sites):
    m = meshes.subdivided_sphere(spark, 0, sites) if sites == "octahedron" else None
    k = 3**-0.5
    df = m.vertices if m else spark.createDataFrame([(0, k, k, k), (1, k, -k, -k), (2, -k, k, -k), (3, -k, -k, k)], "id long, x double, y double, z double")
    n = df.count()
    for r in voronoi.diagram(df).collect():
        assert r["volume"] == pytest.approx(4 * math.pi / n, abs=1e-9)


def test_sites_in_one_place_and_without_one(spark):
    x, df = sphere(spark, 40)
    nan, inf = float("nan"), float("inf")
    more = [(100, *map(float, x[3])), (101, *map(float, x[3])), (102, None, 0.0, 0.0), (103, nan, nan, nan), (104, inf, 0.0, 0.0)]
    cells = {r["id"]: r for r in voronoi.diagram(df.unionByName(spark.createDataFrame(more, df.schema))).collect()}
    assert len(cells) == 45 and sum(r["volume"] for r in cells.values()) == pytest.approx(4 * math.pi)
    assert all(cells[k]["volume"] == 0 and cells[k]["points"] == [] for k in range(100, 105)) and cells[3]["volume"] > 0
    heavy = df.withColumn("w", F.lit(0.0)).unionByName(spark.createDataFrame([(100, *map(float, x[3]), 0.001)], "id long, x double, y double, z double, w double"))
    got = {r["id"]: r["volume"] for r in voronoi.diagram(heavy).collect()}
    assert got[3] == 0 and got[100] > 0 and sum(got.values()) == pytest.approx(4 * math.pi)
    assert voronoi.diagram(df.limit(0)).count() == 0 and voronoi.diagram(df.filter("id = 1")).count() == 1


def test_corners_on_the_boundary_stay_apart(spark):
    r = np.random.default_rng(2).random((30, 2))
    df = spark.createDataFrame([(i, float(a), float(b), 0.0) for i, (a, b) in enumerate(r)], "id long, x double, y double, z double")
    cells = voronoi.diagram(df, voronoi.Domain(sphere=False)).cache()
    vertices, polygons = voronoi.shared_mesh(cells)
    inner = voronoi.delaunay(cells).count()
    assert vertices.filter("j IS NOT NULL").count() == inner
    assert polygons.select(F.sum(F.size("vertices"))).first()[0] == 3 * inner + vertices.filter("j IS NULL").count()


def test_averages_of_rounds(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 8.0)], "round int, area double")
    assert [r["mean_area"] for r in voronoi.averaged(df, ["area"]).orderBy("round").collect()] == [1.0, 2.0, 4.0]


def test_neighbours_over_a_path(spark):
    points = spark.createDataFrame([(i, float(i), 0.0) for i in range(6)], "id long, x double, y double")
    links = spark.createDataFrame([(i, i + 1) for i in range(5)], "a long, b long")
    got = neighbours.over_graph(points, links, 3, 2, ("x", "y")).filter("id IN (0, 3)").collect()
    assert sorted((r["id"], r["rank"], r["neighbour"]) for r in got) == [(0, 0, 1), (0, 1, 2), (3, 0, 2), (3, 1, 4), (3, 2, 1)]


def test_outlines_that_touch_in_a_vertex_stay_apart(spark):
    # Quads of a 3 x 3 grid: the middle one and its corner neighbours have label 1, which meet in vertices only.
    m = meshes.grid(spark, 3, 3)
    labels = m.quads.select("id", F.when(F.col("id").isin(0, 4, 8), 1).otherwise(2).cast("long").alias("label"))
    got = topology.outlines(m.quads, labels).filter("label = 1").collect()
    loops = {}
    for r in got:
        loops.setdefault(r["loop"], {})[r["place"]] = (r["p"], r["q"], r["r"])
    assert len(got) == 12 and sorted(len(x) for x in loops.values()) == [4, 4, 4]
    for x in loops.values():
        assert all(x[k][1] == x[(k + 1) % 4][0] and x[k][2] == x[(k + 1) % 4][1] for k in range(4))


def test_samples_spread_evenly(spark):
    u = spark.range(20000).select(*[sampling.uniform(F.col("id"), k).alias(f"u{k}") for k in range(3)]).toPandas()
    assert (u.min() >= 0).all() and (u.max() < 1).all()
    assert (abs(u.mean() - 0.5) < 0.02).all() and (abs(u.var() - 1 / 12) < 0.005).all()
    assert abs(np.corrcoef(u.T.to_numpy())[np.triu_indices(3, 1)]).max() < 0.03
    m = meshes.grid(spark, 2, 2)
    got = sampling.on_surface(spark.range(2000), m.triangles, m.vertices).toPandas()
    assert len(got) == 2000 and abs(got[["x", "y"]].mean() - 0.5).max() < 0.03 and (got["z"] == 0).all()
    assert got.groupby("triangle").size().between(190, 310).all()


def test_gradients_and_nodes_of_linear_functions(spark):
    m = meshes.grid(spark, 3, 2)
    u = m.vertices.select(F.col("id").alias("i"), (2 * F.col("x") - 3 * F.col("y")).alias("value"))
    for r in fem.vertex_gradients(m.triangles, m.vertices, u).collect():
        assert (r["gx"], r["gy"]) == pytest.approx((2, -3))
    for order, n in ((0, 1), (1, 3), (2, 6), (3, 10)):
        nodes = fem.at_nodes(m.triangles, m.vertices, order, lambda p: p[0] + p[1])
        assert nodes.count() == 12 * n
        assert nodes.groupBy("id").agg(F.avg("value").alias("m")).agg(F.avg("m")).first()[0] == pytest.approx(1)


def test_poisson_converges(spark):
    """Errors fall with the square of the spacing, and boundary values that are not zero are kept."""
    exact = lambda p: F.sin(math.pi * p[0]) * F.sin(math.pi * p[1]) + p[0]
    errors = []
    for n in (4, 8):
        m = meshes.grid(spark, n, n)
        edge = m.vertices.filter("x = 0 OR x = 1 OR y = 0 OR y = 1").select("id", exact(v.vec("x", "y", "z")).alias("value"))
        u = fem.poisson(m.triangles, m.vertices, lambda p: 2 * math.pi**2 * F.sin(math.pi * p[0]) * F.sin(math.pi * p[1]), edge).cache()
        assert u.count() == (n + 1) ** 2
        errors.append(fem.l2_error(m.triangles, m.vertices, u, exact).first()[0])
    assert 1.7 < math.log2(errors[0] / errors[1]) < 2.3


def test_dense_inverses(spark):
    a = np.random.default_rng(4).normal(size=(4, 4))
    df = spark.createDataFrame([tuple(map(float, a.ravel()))], ", ".join(f"c{k} double" for k in range(16)))
    for n in (1, 2, 3, 4):
        m = [[F.col(f"c{4 * i + j}") for j in range(n)] for i in range(n)]
        row = df.select(matrices.determinant(m), matrices.trace(m), *[x for r in matrices.inverse(m) for x in r]).first()
        assert row[0] == pytest.approx(np.linalg.det(a[:n, :n])) and row[1] == pytest.approx(np.trace(a[:n, :n]))
        assert np.array(row[2:]).reshape(n, n) == pytest.approx(np.linalg.inv(a[:n, :n]))
    assert spark.range(1).select(matrices.inverse([[F.lit(1.0), F.lit(2.0)], [F.lit(2.0), F.lit(4.0)]])[0][0]).first()[0] is None


def test_eigenvalues_of_three_rows(spark):
    r = np.random.default_rng(6)
    for a in (r.normal(size=(3, 3)), np.eye(3), np.diag([2.0, 2.0, -1.0]), np.zeros((3, 3))):
        a = a + a.T
        df = spark.createDataFrame([tuple(map(float, a.ravel()))], ", ".join(f"c{k} double" for k in range(9)))
        got = df.select(*matrices.eigen3([[F.col(f"c{3 * i + j}") for j in range(3)] for i in range(3)])).first()
        assert tuple(got) == pytest.approx(tuple(np.linalg.eigvalsh(a)[::-1]), abs=1e-7)


def test_adaptation_keeps_the_surface(spark):
    m = meshes.grid(spark, 6, 6)
    a, b, c = topology.corner_vectors()
    area = lambda t, p: topology.with_corners(t, p).agg(F.sum(v.planar_area(a, b, c))).first()[0]
    t, p = adaptation.collapse_round(m.triangles, m.vertices, 0.2)
    t, p = t.cache(), p.cache()
    gone = 49 - p.count()
    assert gone > 0 and t.count() == 72 - 2 * gone and area(t, p) == pytest.approx(1)
    assert topology.boundary_edges(t).count() == 24 and topology.manifold_report(t).first()["non_manifold"] == 0
    t, p = adaptation.adapted(m.triangles, m.vertices, lambda q: q.select("id", F.lit(0.3).alias("h")), 2)
    assert area(t, p) == pytest.approx(1) and t.count() < 72
    assert topology.manifold_report(t).first()["non_manifold"] == 0
    assert topology.with_corners(t, p).filter(v.orient2d(*[(F.col(f"{k}x"), F.col(f"{k}y")) for k in "abc"]) <= 0).isEmpty()


def test_mesh_text_round_trip(spark, tmp_path):
    m = meshes.grid(spark, 3, 2)
    path = str(tmp_path / "grid.MESH")
    formats.write_mesh(meshes.Mesh(m.vertices, m.triangles, m.quads), path)
    back = formats.read_any(spark, path)
    assert back.vertices.join(m.vertices, ["id", "x", "y", "z"]).count() == 12
    assert back.triangles.join(m.triangles, ["id", "v0", "v1", "v2"]).count() == 12
    assert back.quads.join(m.quads, ["id", "v0", "v1", "v2", "v3"]).count() == 6 and back.lines.isEmpty()
    with pytest.raises(ValueError):
        formats.read_any(spark, "a.stl")
    lines = formats.solution_lines(m.vertices, ["x", "y", "z"]).orderBy("section", "id").collect()
    assert lines[0]["line"].endswith("SolAtVertices\n12\n1 2") and len(lines) == 14 and lines[-1]["line"] == "End"


def test_snapshots_come_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "CHUNK", 7)
    df = spark.range(30).select((F.col("id") * 3 + 5).alias("id"), *[(F.col("id") + k).cast("double").alias(c) for k, c in enumerate("xyzhw")])
    formats.write_snapshot(df, str(tmp_path / "snap"))
    got = formats.read_snapshot(spark, str(tmp_path / "snap")).orderBy("id").collect()
    assert [(r["id"], r["x"], r["w"]) for r in got] == [(k, k, k + 4) for k in range(30)]
    formats.vtk_points(df, str(tmp_path / "vtk"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "vtk")).collect()]
    assert "POINTS 30 float" in text and len(text) == 35
    stats = spark.createDataFrame([(0, 1.5)], "round int, area double")
    formats.write_statistics(stats, str(tmp_path / "a"))
    formats.write_statistics(stats.withColumn("area", F.lit(2.5)), str(tmp_path / "b"))
    both = formats.compare_statistics(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert [(r["run"], r["area"]) for r in both.orderBy("run").collect()] == [(0, 1.5), (1, 2.5)]
