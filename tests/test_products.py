"""Products of sparse matrices by blocks."""

import numpy as np
import pytest

from tessera.operators import sparse


def _rows(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, value double")


@pytest.mark.parametrize("share", [10**9, 50])
def test_products_by_blocks_are_those_by_terms(spark, monkeypatch, share):
    monkeypatch.setattr(sparse, "SHARE", share)
    rng = np.random.default_rng(1)
    name = lambda: int(rng.integers(-30, 30)) * 100 + (0 if rng.random() < 0.8 else 2**60)
    a = {(name(), int(rng.integers(40))): float(rng.integers(-3, 4)) for _ in range(300)}
    b = {(int(rng.integers(40)), name()): float(rng.integers(-3, 4)) for _ in range(300)}
    one, two = ([(*k, value) for k, value in m.items()] for m in (a, b))
    one += [(None, 3, 2.0), (500, None, 1.0), (7, 5, None)]
    two += [(3, None, 4.0), (5, 0, None), (None, 1, 1.0)]
    want = {(r["i"], r["j"]): r["value"] for r in sparse.thin_spmm(_rows(spark, one), _rows(spark, two)).collect()}
    rows = sparse.spmm(_rows(spark, one), _rows(spark, two)).collect()
    assert len(rows) == len(want) and {(r["i"], r["j"]): r["value"] for r in rows} == want
    assert 0.0 in want.values() and None in want.values()


def test_lists_are_shuffled_and_not_their_terms(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: store.executorList(True).apply(0).totalShuffleWrite()
    a = _rows(spark, [(k, j, float(k + j)) for k in range(40) for j in range(500)])
    before = written()
    got = sparse.spmm(sparse.transpose(a), a)
    assert got.count() == 250_000 and got.filter("i = 3 AND j = 7").first()["value"] == sum((k + 3.0) * (k + 7) for k in range(40))
    assert written() - before < 4_000_000  # by terms: 10 million of them, each task's sums by entry
