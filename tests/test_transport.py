"""Power diagrams with strong weights, and transport that goes on until the volumes meet their targets."""

import math

import numpy as np
import pytest

from tessera.operators import fluids, voronoi
from tessera.plans import physics


def _sphere(n, seed):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    return p / np.linalg.norm(p, axis=1)[:, None]


def test_cells_of_strong_weights_cover_the_sphere():
    n = 200
    site, at = _sphere(n, 3), _sphere(100_000, 4)
    weight = np.random.default_rng(5).uniform(0, 0.02, n)
    gap = ((site[:, None] - site[None]) ** 2).sum(axis=2)
    np.fill_diagonal(gap, np.inf)
    order = np.argsort(gap, axis=1)[:, :-1]
    got = voronoi.clip(site, weight, site[order], weight[order], np.ones(order.shape, dtype=bool), voronoi.Domain(), bent=True)
    volume, _ = voronoi.measures(got["points"], got["count"], True)
    hit = np.bincount((2 - 2 * at @ site.T - weight).argmin(axis=1), minlength=n) / len(at) * 4 * math.pi
    assert volume.sum() == pytest.approx(4 * math.pi, rel=1e-3)
    assert abs(volume - hit).max() < 0.02


def test_volumes_meet_their_targets(spark):
    rows = [(k, *map(float, p)) for k, p in enumerate(_sphere(80, 6))]
    rows += [rows[7], (200, *rows[9][1:]), (201, None, 1.0, 0.0), (None, 0.6, 0.8, 0.0)]
    sites = spark.createDataFrame(rows, "id long, x double, y double, z double")
    share = lambda k: 1.0 + k % 3
    targets = spark.createDataFrame([(r[0], share(r[0] or 0)) for r in rows], "id long, target double")
    got = [(r["id"], r["volume"]) for r in fluids.transport(sites, targets).select("id", "volume").collect()]
    assert sorted(i for i, _ in got) == sorted(r[0] for r in rows if r[0] is not None)
    whole = sum(share(k) for k in range(80))
    for i, volume in got:
        assert volume == pytest.approx(4 * math.pi * share(i) / whole if i < 200 else 0.0, abs=1e-8)


def test_the_query_takes_the_operators_own_steps(spark, monkeypatch, tmp_path):
    taken = {}
    monkeypatch.setattr(physics.fluids, "transport", lambda s, t, **more: taken.update(more) or s.selectExpr("id", "0.0D AS volume"))
    rows = [(k, [float(c) for c in p] + [0.0] * 4) for k, p in enumerate(_sphere(5, 1))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert physics.transport_step(spark, str(tmp_path)).count() == 5 and not taken
