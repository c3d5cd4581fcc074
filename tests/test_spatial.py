"""Spatial trees and location on the sphere against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import location, trees

RNG = np.random.default_rng(0)


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def frame(spark, p, axes):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, " + ", ".join(f"{c} double" for c in axes))


def brute(q, p, k):
    d = ((q[:, None] - p[None]) ** 2).sum(axis=2)
    order = np.lexsort((np.broadcast_to(np.arange(len(p)), d.shape), d), axis=1)[:, :k]
    return {(i, r): int(order[i, r]) for i in range(len(q)) for r in range(order.shape[1])}


CLUSTER = np.concatenate([0.3 + 1e-9 * RNG.random((900, 2)), RNG.random((99, 2)), [[1e12, -1e12]]])
COPIES = np.concatenate([np.full((300, 2), 0.5), RNG.random((60, 2))])
CASES = {"sphere": (unit(RNG.standard_normal((300, 3))), 8), "one spot and an outlier": (CLUSTER, 5), "copies": (COPIES, 4), "few": (RNG.random((3, 2)), 8), "line": (np.column_stack([np.arange(100.0), np.zeros(100)]), 3)}


@pytest.mark.parametrize(("case", "sphere"), [*[(c, False) for c in CASES], ("sphere", True)])
def test_nearest_agrees_with_brute_force(spark, case, sphere):
    p, k = CASES[case]
    axes = ("x", "y", "z")[: p.shape[1]]
    df = frame(spark, p, axes)
    assert {(r["id"], r["rank"]): r["neighbour"] for r in trees.nearest(df, df, k, axes, sphere).collect()} == brute(p, p, k)


def test_nearest_of_other_queries_and_of_some_of_the_points(spark):
    p, q = RNG.random((200, 2)), np.concatenate([RNG.random((40, 2)) * 3 - 1, [[0.5, 0.5]] * 3])
    points = frame(spark, p, "xy")
    index = trees.Index(points, ("x", "y"), 3)
    assert {(r["id"], r["rank"]): r["neighbour"] for r in index.nearest(3, frame(spark, q, "xy")).collect()} == brute(q, p, 3)
    some = index.nearest(3, points.filter("id < 20"), among=True).collect()
    assert {(r["id"], r["rank"]): r["neighbour"] for r in some} == brute(p[:20], p, 3)
    assert trees.nearest(points, points.limit(0), 3, ("x", "y")).count() == 0 and trees.nearest(points.limit(0), points, 3, ("x", "y")).count() == 0


def test_leaves_are_bounded_whatever_the_spread(spark):
    for p, passes in ((RNG.random((1500, 2)), 1), (CLUSTER, 5)):
        tree = trees.build(frame(spark, p, "xy"), ("x", "y"))
        sizes = [r["n"] for r in tree.leaves.collect()]
        assert sum(sizes) == len(p) and max(sizes) <= trees.LEAF and tree.passes <= passes
        assert max(r["count"] for r in tree.places.groupBy("leaf").count().collect()) <= trees.LEAF


def test_points_per_triangle_counts_all_leaves(spark):
    p = np.concatenate([unit(RNG.standard_normal((200, 3))), trees.OCTAHEDRON])
    got = {r["leaf"]: r["points"] for r in trees.points_per_triangle(frame(spark, p, "xyz"), 3).collect()}
    assert sorted(got) == list(range(512)) and sum(got.values()) == 206 and min(got.values()) == 0
    # Corners are in several triangles; the lowest has them.
    assert got[0] >= 1 and trees.descend(np.array([[1.0, 0, 0]]), 3).tolist() == [[0, 0, 0, 0]]
    assert [trees.sphere_level(n) for n in (0, 319, 320, 1279, 1280)] == [0, 0, 1, 1, 2]


def mesh(spark, corners, ids=None):
    rows = [(i, *(ids[i].tolist() if ids is not None else (0, 0, 0)), *map(float, c.ravel())) for i, c in enumerate(corners)]
    return spark.createDataFrame(rows, "id long, v0 long, v1 long, v2 long, " + ", ".join(f"{c} double" for c in location.CORNERS))


def holds(q, c):
    a, b, d = c[:, 0], c[:, 1], c[:, 2]
    with np.errstate(all="ignore"):
        w = np.stack([q @ np.cross(u, x).T / np.einsum("ij,ij->i", np.cross(a, b), d) for u, x in ((b, d), (d, a), (a, b))], 2)
        ok = (w.min(axis=2) >= -1e-12 * w.sum(axis=2)) & (w.sum(axis=2) > 0)
    return [int(r.argmax()) if r.any() else None for r in ok]


def test_location_among_large_small_and_flat_triangles(spark):
    q = unit(RNG.standard_normal((400, 3)))
    small = unit(q[:50, None] + 1e-5 * RNG.standard_normal((50, 3, 3)))
    flat = np.stack([np.stack([q[60], q[60], q[61]]), np.zeros((3, 3))])
    corners = np.concatenate([flat, small, trees.OCTAHEDRON[trees.FACES][:7]])  # an eighth of the sphere is in none
    points = frame(spark, np.concatenate([q, np.zeros((1, 3)), trees.OCTAHEDRON]), "xyz")
    got = {r["id"]: r for r in location.locate_on_sphere(points, mesh(spark, corners)).collect()}
    want = holds(np.concatenate([q, np.zeros((1, 3)), trees.OCTAHEDRON]), corners)
    assert [got[i]["triangle"] for i in range(407)] == want and None in want and any(w is not None and 2 <= w < 52 for w in want)
    at = [r for r in got.values() if r["triangle"] is not None]
    back = [(1 - r["s"] - r["t"]) * corners[r["triangle"], 0] + r["s"] * corners[r["triangle"], 1] + r["t"] * corners[r["triangle"], 2] for r in at]
    p = np.concatenate([q, np.zeros((1, 3)), trees.OCTAHEDRON])
    assert max(np.abs(unit(b) - p[r["id"]]).max() for b, r in zip(back, at, strict=True)) < 1e-9
    assert location.locate_on_sphere(points, mesh(spark, corners).limit(0)).filter("triangle IS NULL").count() == 407


def test_walks_end_where_location_says(spark):
    corners, ids = trees.OCTAHEDRON[trees.FACES], trees.FACES
    q = unit(RNG.standard_normal((60, 3)))
    points, faces = frame(spark, q, "xyz"), mesh(spark, corners, ids)
    got = {r["id"]: r["triangle"] for r in location.walk(points, faces, points.select("id", F.lit(6).cast("long").alias("triangle"))).collect()}
    assert [got[i] for i in range(60)] == holds(q, corners)
    # Without one face, walks that would have to cross it leave the mesh.
    lost = location.walk(points, faces.filter("id <> 0"), points.select("id", F.lit(6).cast("long").alias("triangle")))
    assert {r["triangle"] for r in lost.collect() if got[r["id"]] == 0} <= {None}
