"""Exact top-k search, whitening and fill-in-the-middle against brute force, with edge cases."""

import re
from hashlib import sha256

import numpy as np
import pytest

from tessera.llm import fill_middle, top_k, whitening

VECTORS = "vec_id long, embedding array<double>, label int"


def brute_top(rows, k, every):
    fit = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for a, (i, q) in enumerate(fit):
        if i is not None and i % every == 0:
            scores = [(-min(max(sum(x * y for x, y in zip(q, c, strict=True)), -(1 << 63)), (1 << 63) - 1), j is None, j or 0) for b, (j, c) in enumerate(fit) if a != b and len(c) == len(q)]
            out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def searched(spark, rows, k=5, every=3, parts=3):
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], VECTORS).repartition(parts)
    got = top_k.search(df, top_k.F.col("id") % every == 0, k=k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def test_top_k_with_ties_copies_nulls_and_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.standard_normal(4)]) for i in range(60)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(60, 90)]  # ties of a third of all rows
    rows += [(63, [0.5, 0.5, 0.5, 0.5])] * 2 + [(6, [0.5] * 4), (None, [0.5] * 4), (None, [9.0] * 4)]
    rows += [(93, None), (96, [1.0, None, 0.0, 0.0]), (99, [float("nan")] * 4), (102, [float("inf")] * 4)]
    rows += [(300, [1.0, 2.0]), (301, [3.0, -1.0]), (303, [1.0] * 7), (306, []), (309, [])]
    assert searched(spark, rows) == brute_top(rows, 5, 3)
    assert searched(spark, rows, k=40, parts=7) == brute_top(rows, 40, 3)


def test_top_k_in_several_blocks_and_in_wide_ranges(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", 16)
    monkeypatch.setattr(top_k, "TILE", 50)
    rng = np.random.default_rng(6)
    for size in (1.0, 3e4, 1e9, 1e25):  # single, double, Python's integers, beyond a long
        rows = [(i, [float(c) for c in rng.standard_normal(3) * size]) for i in range(50)] + [(60, [size] * 3), (61, [size] * 3)]
        assert searched(spark, rows, k=3, every=4) == brute_top(rows, 3, 4), size
    assert searched(spark, []) == [] and searched(spark, [(1, [1.0])]) == [] and searched(spark, [(3, [1.0])]) == []


def whitened(spark, rows, components=32, parts=3):
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], VECTORS).repartition(parts)
    return whitening.whiten(df, components=components).collect()


def test_whitening_agrees_with_a_dense_decomposition(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 12)) * 0.9 ** np.arange(12) @ np.linalg.qr(rng.standard_normal((12, 12)))[0] + 3
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    rows += [(7, x[0].tolist()), (None, x[1].tolist()), (500, None), (501, [None] * 12), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (504, [1.0]), (505, [1e300] * 12)]
    got = whitened(spark, rows, components=5)
    fit = [(i, v) for i, v in rows if v is not None and len(v) == 12 and all(c is not None and abs(c) < 1e12 for c in v)]
    whole = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in fit])
    n, sums = len(whole), whole.sum(axis=0)
    z = (n * whole - sums) / n
    values, turn = np.linalg.eigh(z.T @ z / n)
    values, turn = values[::-1][:5], turn[:, ::-1][:, :5]
    want = z @ turn / np.sqrt(values)
    assert len(got) == 5 * n and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-12
    explained = {r["component"]: r["explained"] for r in got}
    np.testing.assert_allclose([explained[c] for c in range(1, 6)], values / np.trace(z.T @ z / n), rtol=1e-12)
    deviation = dict(zip([i for i, _ in fit], ((n * whole - sums) ** 2).sum(axis=1).tolist(), strict=True))
    by_id = {}
    for r in got:
        assert r["deviation"] == deviation[r["vec_id"]] or r["vec_id"] == 7
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r["whitened"])
    sign = [np.sign(by_id[3][c + 1][0] / want[3, c]) for c in range(5)]
    for row, (i, _) in enumerate(fit):
        for c in range(5):
            assert min(abs(sign[c] * w - want[row, c]) for w in by_id[i][c + 1]) < 1e-10


def test_whitening_without_variance_and_without_rows(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, None)]) == []
    one = whitened(spark, [(1, [1.0, 2.0])])
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, 0.0), (2, 0, None, 0.0, 0.0)]
    line = whitened(spark, [(i, [float(i), 1.0, 2.0 * i]) for i in range(5)])
    assert sorted({(r["component"], r["whitened"] is None) for r in line}) == [(1, False), (2, True), (3, True)]
    far = whitened(spark, [(1, [1e12]), (2, [-1e12])])
    assert {r["deviation"] for r in far} == {None} and sorted(round(abs(r["whitened"]), 12) for r in far) == [1.0, 1.0]


class Counted:
    def __init__(self, m):
        self.m, self.products = m, 0

    def __matmul__(self, b):
        self.products += 1
        return self.m @ b


@pytest.mark.parametrize("kind", ["random", "falling", "equal", "low rank", "zero", "clusters"])
def test_jacobi_davidson_reaches_double_precision(kind):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 160))
    if kind == "falling":
        x *= 0.9 ** np.arange(160)
    if kind == "low rank":
        x = x[:, :5] @ rng.standard_normal((5, 160))
    m = {"equal": np.eye(160), "zero": np.zeros((160, 160))}.get(kind, x.T @ x / 1500)
    if kind == "clusters":
        turn = np.linalg.qr(rng.standard_normal((160, 160)))[0]
        m = (turn * np.repeat([9, 9 - 1e-9, 4, 1.0], 40)) @ turn.T
    a = Counted((m + m.T) / 2)
    values, vectors = whitening.jacobi_davidson(a, 160, 20)
    scale = max(values[0], 1e-300)
    assert abs(values - np.linalg.eigvalsh(m)[::-1][:20]).max() <= 1e-12 * scale
    assert np.linalg.norm(m @ vectors - vectors * values, axis=0).max() <= 1e-12 * scale
    assert abs(vectors.T @ vectors - np.eye(20)).max() < 1e-12 and a.products < 400


def brute_middle(i, t):
    t = t or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    digest = sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, t
    if h[3] % 100 < 20:
        return len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_middle_against_regular_expressions(spark):
    rng = np.random.default_rng(2)
    alphabet = list("abcXYZ  \n.<>PSM09é猫😀\u0000­") + ["word", "<P", "S>"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(400)]
    texts += [None, "", "a", "é", "<P>", "x<M>y", "猫" * 50_000 + " tail " * 20_000, "abc" * 100_000, "<", "<<", "P>", " <S"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here"), (3, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame([(i, t, "x", 1.5, "y") for i, t in rows], "doc_id long, text string, Output string, n double, _key string").repartition(5)
    done = fill_middle.restore(fill_middle.transform(docs))
    assert sorted(done.columns) == sorted(["doc_id", "text", "_key", "output", "n", "form", "prefix_chars", "middle_chars", "restored"])
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in done.collect()), key=str)
    assert got == sorted(((i, *brute_middle(i, t)) for i, t in rows), key=str)
    assert done.filter("restored IS DISTINCT FROM coalesce(text, '')").count() == 0
    assert {r["form"] for r in done.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    digests = fill_middle.report(docs)
    assert digests.filter("restored_sha256 = sha2('', 256)").count() == sum(not t for _, t in rows)
    assert fill_middle.report(docs.limit(0)).count() == 0
