"""Results that don't depend on how rows are dealt to partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_model, minhash, quality, top_k
from tests_prose import prose  # noqa: I001


@pytest.fixture(scope="module")
def docs(spark):
    texts = [prose(40 + 7 * (k % 20), k % 60) for k in range(240)]  # every fourth is repeated
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def layouts(df):
    return df, df.repartition(1).orderBy(F.desc("doc_id")), df.repartition(7)


def test_language_model_scores(docs, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 300)
    first, *others = [sorted(map(tuple, language_model.score(d).collect())) for d in layouts(docs)]
    assert all(o == first for o in others)
    held = [r for r in first if r[1]]
    assert len(held) > 10 and sum(r[6] for r in held) > sum(r[5] for r in held)  # better than single words on what it hasn't seen


def test_training_sums_are_those_of_plain_loops():
    rng = np.random.default_rng(3)
    slots, hashes = rng.integers(0, 256, 400), rng.integers(0, 2**32, 400).astype(np.uint64)
    position = np.concatenate([np.arange(150), np.arange(250)])
    w = language_model.Weights(np.bincount(slots, minlength=256))
    w.tables = rng.normal(0, 0.3, w.tables.shape).astype(np.float32)
    text = (slots, hashes, position)
    halves = [(x[0][:150], x[1][:150], x[2][:150]) for x in [text]] + [(slots[150:], hashes[150:], position[150:])]
    counts, sums = language_model.counted(iter([text])), language_model.expected(w, iter([text]))
    assert (counts == sum(language_model.counted(iter([h])) for h in halves)).all() and (sums == sum(language_model.expected(w, iter([h])) for h in halves)).all()
    before, own = language_model.history(slots, hashes, position), slots // 16
    want = {}
    for level, column in ((0, own), (1, slots % 16)):
        rows = language_model.features(level, own, *before)
        for k in range(400):
            z = w.class_bias + sum(w.tables[0][r] for r in rows[:, k]) if level == 0 else w.slot_bias[own[k]] + sum(w.tables[1][r] for r in rows[:, k])
            p = np.exp(z - z.max())
            for r in rows[:, k]:
                n, e = want.setdefault((level, r), [np.zeros(16), np.zeros(16)])
                n[column[k]] += 1
                e += p / p.sum()
    for (level, r), (n, e) in want.items():
        assert (counts[level, r] == n).all() and np.abs(sums[level, r] / language_model.SHARE - e).max() < 0.1
    assert counts[0].sum() == counts[1].sum() == counts[2].sum() == 1600


def test_quality_scores(spark, docs):
    labels = spark.createDataFrame([(k, int(k % 20 > 6), int(k % 9 == 0)) for k in range(0, 240, 3)], "doc_id long, quality int, toxic int")
    first, *others = [{r["doc_id"]: r["score"] for r in quality.report(d, labels.repartition(3)).collect()} for d in layouts(docs)]
    assert all(max(abs(o[k] - first[k]) for k in first) < 1e-6 for o in others)


def test_near_duplicate_classes(docs):
    first, *others = [sorted(map(tuple, minhash.near_duplicates(d).select("doc_id", "class_id").collect())) for d in layouts(docs)]
    assert all(o == first for o in others) and len({c for _, c in first}) == 60


def test_top_k(spark):
    rows = [(k, [float(x) for x in np.random.default_rng(k % 40).normal(size=5)]) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    first, *others = [sorted(map(tuple, top_k.search(d, F.col("id") % 50 == 0).collect())) for d in (df, df.repartition(1), df.repartition(7))]
    assert all(o == first for o in others) and len(first) == 20
