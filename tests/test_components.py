"""Components of graphs whose links are gathered in tasks first."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graphs


@pytest.mark.parametrize("held", [500_000, 40])
def test_rounds_are_few_where_ids_follow_the_shape(spark, monkeypatch, held):
    monkeypatch.setattr(graphs, "HELD", held)
    taken = []

    class Counted(graphs.Rounds):
        def next(self, df):
            taken.append(1)
            return super().next(df)

    monkeypatch.setattr(graphs, "Rounds", Counted)
    rng = np.random.default_rng(3)
    rows = [(k, k + 1) for k in range(3000) if k % 1000] + [(9000, 9000), (None, 7), (-5, 9000)]
    order = rng.permutation(len(rows))
    edges = spark.createDataFrame([rows[k] for k in order], "a long, b long")
    got = {r["id"]: r["label"] for r in graphs.components(edges, gather=True).collect()}
    want = {k: (k - 1) // 1000 * 1000 + 1 for k in range(1, 3001)} | {9000: -5, -5: -5}
    assert got == want
    if held > 3000:
        assert len(taken) <= 6  # one task's links or four's; before, some twelve


def test_other_kinds_of_names_go_without(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y")], "a string, b string")
    assert {tuple(r) for r in graphs.components(edges, gather=True).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert graphs.components(spark.range(3).select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0), gather=True).count() == 0
