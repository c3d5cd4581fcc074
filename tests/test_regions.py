"""Coasts and merged regions."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import regions
from tessera.sources import meshes


def square(spark, n, label):
    """A grid of n x n and the labels of its quads' two triangles each, by label(column, row)."""
    m = meshes.grid(spark, n, n)
    groups = spark.createDataFrame([(2 * (j * n + i) + k, label(i, j)) for i in range(n) for j in range(n) for k in range(2)], "id long, group int")
    return m, groups


def merged(m, groups):
    used, rings = regions.merged(m.triangles, m.vertices, groups.select("id", F.col("group").alias("label")))
    at = {r["id"]: (r["x"], r["y"]) for r in used.collect()}
    return at, rings.collect()


def test_a_hole_belongs_to_the_region_around_it(spark):
    m, groups = square(spark, 5, lambda i, j: int(1 <= i <= 3 and 1 <= j <= 3) + int(i == j == 2))
    at, rings = merged(m, groups)
    assert sorted((r["label"], r["outer"], round(r["area"] * 25, 9)) for r in rings) == [(0, False, -9.0), (0, True, 25.0), (1, False, -1.0), (1, True, 9.0), (2, True, 1.0)]
    assert len({r["region"] for r in rings}) == 3
    for r in rings:
        p = np.array([at[k] for k in r["vertices"]])
        q = np.roll(p, -1, axis=0)
        assert abs((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2 - r["area"]) < 1e-12 and len(set(r["vertices"])) == len(r["vertices"])
    # Every vertex is on a ring but those inside the middle ring's quads; corners on the border have two neighbours and stay.
    assert len(at) == 36 and max(at) == 35 and (0.0, 0.0) in at.values()


def test_regions_that_touch_in_a_vertex_stay_apart(spark):
    m, groups = square(spark, 4, lambda i, j: int((i < 2) == (j < 2)))
    _, rings = merged(m, groups)
    assert Counter((r["label"], r["outer"], round(r["area"], 9)) for r in rings) == Counter({(0, True, 0.25): 2, (1, True, 0.25): 2})


def test_vertices_inside_a_region_are_dropped(spark):
    m, groups = square(spark, 4, lambda i, j: 7)
    at, rings = merged(m, groups)
    assert len(at) == 16 and [(r["outer"], len(r["vertices"]), round(r["area"], 9)) for r in rings] == [(True, 16, 1.0)]
    assert merged(m, groups.limit(0))[1] == []


def test_coast_of_an_island_with_a_pinch_and_of_a_shore(spark):
    # Two islands that touch in a vertex, and land along the left border.
    island = {(2, 1), (3, 2)}
    m, groups = square(spark, 5, lambda i, j: 1 if (i, j) in island or i == 0 else 2)
    cut = regions.coast(m.triangles, groups)
    lines = cut.lines.orderBy("group", "place").collect()
    assert sorted(Counter(r["group"] for r in lines).values()) == [4, 4, 5]  # the shore is an open chain
    for g, n in Counter(r["group"] for r in lines).items():
        chain = [(r["v0"], r["v1"]) for r in lines if r["group"] == g]
        assert all(a[1] == b[0] for a, b in zip(chain, chain[1:], strict=False)) and (n == 5) != (chain[0][0] == chain[-1][1])
    land = {r["id"] for r in groups.filter("group = 1").collect()}
    for (faces, vertices, own), n in ((cut.land, len(land)), (cut.water, 50 - len(land))):
        was = {r["id"]: r["was"] for r in vertices.collect()}
        assert sorted(was) == list(range(len(was))) and faces.count() == n
        assert sorted((was[r["v0"]], was[r["v1"]], r["group"]) for r in own.collect()) == sorted((r["v0"], r["v1"], r["group"]) for r in lines)
    # Land is on the left: its faces have the lines as half-edges of their own.
    was = {r["id"]: r["was"] for r in cut.land[1].collect()}
    half = {(was[r[f"v{k}"]], was[r[f"v{(k + 1) % 3}"]]) for r in cut.land[0].collect() for k in range(3)}
    assert {(r["v0"], r["v1"]) for r in lines} <= half
    none = regions.coast(m.triangles, groups.withColumn("group", F.lit(1)))
    assert none.lines.count() == 0 and none.water[0].count() == 0 and none.land[0].count() == 50
