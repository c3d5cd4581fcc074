"""Direct solves by nested dissection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import dissection, fem
from tessera.sources import meshes


def test_solutions_are_those_of_a_dense_solve(spark):
    rng = np.random.default_rng(4)
    n = 60
    pairs = {tuple(sorted((int(k), int(k + s)))) for k in range(n) for s in rng.integers(1, 5, 2) if k + s < n and (k, k + s) != (20, 21)}
    m = np.zeros((n, n))
    for p, q in pairs:
        m[p, q] = m[q, p] = -rng.random() - 0.1
    np.fill_diagonal(m, 0.5 - m.sum(axis=1))
    m[n - 1, :], m[:, n - 1] = 0, 0  # one hangs alone
    m[n - 1, n - 1] = 2
    b = rng.normal(size=n)
    names = rng.permutation(1000)[:n].tolist()
    a = spark.createDataFrame([(names[i], names[j], float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]], "i long, j long, value double")
    right = spark.createDataFrame([(names[i], float(b[i])) for i in range(n)], "i long, value double")
    spots = [(names[i], float(i // 3), float(i % 7), 0.0) for i in range(n - 5)]  # five without a place, many in one column
    places = spark.createDataFrame(spots, "i long, x double, y double, z double")
    want = dict(zip(names, np.linalg.solve(m, b), strict=True))
    for leaf in (100, 20, 2):
        rows = dissection.solve(a, right, places, leaf).collect()
        got = {r["i"]: r["value"] for r in rows}
        assert len(rows) == n and got == pytest.approx(want, abs=1e-9)


def test_boxes_hold_even_counts_whatever_the_spread(spark):
    rows = [(k, 1.0, 1e-9 * k, 0.0) for k in range(50)] + [(50 + k, float(k), 1e12, 0.0) for k in range(14)]
    places = spark.createDataFrame(rows, "i long, x double, y double, z double")
    counts = {r["code"]: r["count"] for r in dissection.boxes(places, 2, 64).groupBy("code").count().collect()}
    assert counts == {k: 4 for k in range(16)}


def test_a_mesh_takes_a_solve_or_two(spark):
    m = meshes.grid(spark, 28, 28)  # 841 unknowns: several boxes, and two levels of cycles before
    lines = spark.range(28).select((F.col("id") * 29).alias("v0"), (F.col("id") * 29 + 29).alias("v1"), F.lit(3).alias("group"))
    lines = lines.unionByName(lines.select((F.col("v0") + 28).alias("v0"), (F.col("v1") + 28).alias("v1"), F.lit(1).alias("group")))
    u, taken = fem.potential_flow(m.triangles, m.vertices, lines, 2.0)
    at = m.vertices.withColumnRenamed("id", "i").join(u, "i").toPandas()
    assert taken <= 2 and len(at) == 841
    assert (at["value"] - 2 * at["x"]).to_numpy() == pytest.approx(np.full(841, -1.0), abs=1e-9)
