"""Close points merged by cells."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import topology


def test_cells_merge_what_all_pairs_merge(spark, monkeypatch):
    rng = np.random.default_rng(7)
    t = 0.1
    crowd = rng.normal(0.5, 0.02, (150, 2)).tolist()
    gap = [[2 + rng.random() * 0.05, k * 0.09] for k in range(20)] + [[2.151 + rng.random() * 0.05, k * 0.09] for k in range(20)]
    spread = (rng.random((150, 2)) * 3).tolist()
    exact = [[-1.0, 0.0], [-1.1, 0.0], [-1.2, 0.0], [-1.3000001, 0.0], [-1.0, 0.0]]  # as far apart as the tolerance, or a little more
    rows = [(k, *map(float, p)) for k, p in enumerate(crowd + gap + spread + exact)] + [(9000, None, 1.0), (9001, 0.5, None)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    want = {tuple(r) for r in topology._merged_by_pairs(points, t, ("x", "y")).collect()}
    monkeypatch.setattr(topology, "_merged_by_pairs", None)
    got = topology.merge_map(points, t, ("x", "y")).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want and len({r["to"] for r in got}) > 10


def test_three_axes_and_far_points(spark):
    rng = np.random.default_rng(8)
    rows = [(k, *map(float, p)) for k, p in enumerate(rng.random((250, 3)) - 0.5)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    want = {tuple(r) for r in topology._merged_by_pairs(points, 0.12, ("x", "y", "z")).collect()}
    assert {tuple(r) for r in topology.merge_map(points, 0.12).collect()} == want
    odd = spark.createDataFrame([(1, float("nan"), 0.0, 0.0), (2, 1e6, 0.0, 0.0), (3, 1e6 + 0.01, 0.0, 0.0)], points.schema)
    assert {tuple(r) for r in topology.merge_map(odd, 0.1).collect()} == {(1, 1), (2, 2), (3, 2)}


def test_a_crowd_makes_no_pairs(spark):
    k = F.col("id")
    points = spark.range(60_000).select("id", (k % 250 / 1e5).alias("x"), (F.floor(k / 250) / 1e5).alias("y"))  # 1.8 billion close pairs
    got = topology.merge_map(points, 0.01, ("x", "y")).groupBy("to").count().collect()
    assert [tuple(r) for r in got] == [(0, 60_000)]
