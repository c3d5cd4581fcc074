"""Products whose rows meet columns of many blocks: right sums, and little is written."""

from pathlib import Path

import numpy as np
import pytest

from tessera.operators import sparse


@pytest.mark.parametrize("share", [10**9, 300])
def test_entries_spread_over_many_blocks_are_dealt_once(spark, monkeypatch, share):
    monkeypatch.setattr(sparse, "SHARE", share)
    rng = np.random.default_rng(2)
    k = np.repeat(np.arange(300), 25)
    j = rng.integers(0, 1 << 16, len(k))
    j[::2] = rng.integers(0, 1024, len(j[::2]))  # a block with half of the entries
    v = rng.integers(1, 9, len(k)).astype(float)
    a = spark.createDataFrame(list(zip(k.tolist(), j.tolist(), v.tolist(), strict=True)), "i long, j long, value double")
    want: dict = {}
    for n in range(300):
        on = slice(25 * n, 25 * n + 25)
        for p, x in zip(j[on].tolist(), v[on].tolist(), strict=True):
            for q, y in zip(j[on].tolist(), v[on].tolist(), strict=True):
                want[p, q] = want.get((p, q), 0.0) + x * y
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: store.executorList(True).apply(0).totalShuffleWrite()
    folder = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    kept = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = shuffled() + kept()
    rows = sparse.spmm(sparse.transpose(a), a).collect()
    written = shuffled() + kept() - before
    assert len(rows) == len(want) and {(r["i"], r["j"]): r["value"] for r in rows} == want
    if share > len(k):
        assert written < 64 * len(k)
