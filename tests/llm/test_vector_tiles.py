"""Near-duplicate vectors over several tiles: crowds, copies, single precision, and what is written."""

from pathlib import Path

import numpy as np

from tessera.llm import neardup_vectors


def _brute(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= neardup_vectors.COSINE
    label = np.arange(len(x))
    while True:
        low = np.array([label[n].min() for n in near])
        if (low == label).all():
            return near.sum(axis=1) - 1, label
        label = low


def test_links_of_many_tiles_and_little_is_written(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x[::3] = x[0] + 0.1 * rng.normal(size=(1000, 64)).astype(np.float32)  # a crowd of a third
    x[1:600:3] = x[1200:1799:3] + 0.1  # moved a little
    x[2:60:3] = x[2]
    for k in range(901, 1000, 3):  # a chain
        x[k] = x[k - 3] + 0.25 * rng.normal(size=64)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: store.executorList(True).apply(0).totalShuffleWrite()
    folder = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    kept = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = shuffled() + kept()
    made = neardup_vectors.near_duplicates(df)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in made.collect()}
    links, label = _brute(x)
    assert got == {i: (links[i], label[i]) for i in range(len(x))}
    assert links[0] > 900 and len(set(label)) < 2000
    assert shuffled() + kept() - before < 4 * x.nbytes + 1_000_000  # by copies in cells: 60 MB


def test_units_are_those_of_any_size():
    x = np.array([[3.0, 4.0], [3e200, 4e200], [3e-320, 4e-320], [0.0, 0.0], [np.inf, 1.0], [np.nan, 1.0], [-0.0, 2.0]])
    u, ok = neardup_vectors.units(x)
    assert ok.tolist() == [True, True, True, False, False, False, True]
    assert abs(u[:2] - [0.6, 0.8]).max() < 1e-15 and u[6].tobytes() == np.array([0.0, 1.0]).tobytes()
