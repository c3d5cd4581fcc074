"""Dense matrices against numpy, sums in any order, exact signs."""

import math
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import dense, predicates, sums

RNG = np.random.default_rng(4)


def column(spark, matrices):
    return spark.createDataFrame([(k, None if a is None else [None if x is None else float(x) for x in np.ravel(a)]) for k, a in enumerate(matrices)], "id long, m array<double>")


def definite(n, least=1e-3):
    q = np.linalg.qr(RNG.standard_normal((n, n)))[0]
    return (q * np.geomspace(least, 10, n)) @ q.T


def test_inverses_of_all_sizes(spark):
    near = np.eye(5) + 1e-9 * RNG.standard_normal((5, 5))
    near[4] = near[3] + 1e-10 * RNG.standard_normal(5)  # nearly singular
    pivots = np.array([[0.0, 2.0, 1.0], [1.0, 0.0, 0.0], [3.0, 0.0, 1.0]])
    cases = [*[RNG.standard_normal((n, n)) for n in (1, 2, 8, 8, 20)], near, pivots, np.ones((4, 4)), np.zeros((2, 2)), None, [1.0, 2.0, 3.0], [1.0, None, 0.0, 1.0], [math.inf, 0, 0, 1.0], []]
    got = {r["id"]: r for r in dense.with_inverse(column(spark, cases), "m").collect()}
    for k, a in enumerate(cases[:7]):
        assert abs(got[k]["det"] - np.linalg.det(a)) <= 1e-9 * max(1.0, abs(np.linalg.det(a)))
        back = np.reshape(got[k]["inverse"], np.shape(a))
        assert np.abs(np.asarray(a) @ back - np.eye(len(a))).max() < (1e-5 if k == 5 else 1e-10)
    assert [(got[k]["det"], got[k]["inverse"]) for k in (7, 8)] == [(0.0, None)] * 2
    assert all(got[k]["det"] is None and got[k]["inverse"] is None for k in (9, 10, 11, 12)) and got[13]["det"] == 1.0


def test_eigenvalues_and_functions(spark):
    same = np.full((6, 6), 0.3) + np.eye(6)  # five equal eigenvalues
    cases = [definite(8), definite(8, 1e-12), same, np.diag([3.0, -1.0, 2.0]), np.zeros((3, 3)), np.array([[4.0]])]
    got = {r["id"]: r for r in dense.with_eigen(column(spark, cases), "m").collect()}
    for k, a in enumerate(cases):
        e, v = np.array(got[k]["values"]), np.reshape(got[k]["vectors"], np.shape(a))
        assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * max(1, np.abs(e).max()) and np.abs(a @ v - v * e).max() < 1e-13 * max(1, np.abs(e).max()) and np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13
    df = column(spark, cases)
    for name, f, some in (("exp", np.exp, range(6)), ("log", np.log, (0, 1, 2, 5)), ("sqrt", np.sqrt, (0, 1, 2, 4, 5))):
        got = {r["id"]: r["y"] for r in dense.with_function(df, "m", "y", name).collect()}
        for k, a in enumerate(cases):
            if k in some:
                e, v = np.linalg.eigh(a)
                want = (v * f(np.maximum(e, 0) if name == "sqrt" else e)) @ v.T
                assert np.abs(np.reshape(got[k], np.shape(a)) - want).max() < (1e-3 if (k, name) == (1, "log") else 1e-9 * max(1, np.abs(want).max())), (name, k)
            else:
                assert got[k] is None
    cube = {r["id"]: r["y"] for r in dense.with_function(df, "m", "y", "power", 3.0).collect()}
    assert np.abs(np.reshape(cube[3], (3, 3)) - np.diag([27.0, -1.0, 8.0])).max() < 1e-12
    assert {r["id"]: r["y"] for r in dense.with_function(df, "m", "y", "power", -0.5).collect()}[3] is None


def test_log_euclidean_mean(spark):
    a, b = definite(3, 0.1), definite(3, 0.1)
    df = column(spark, [a, b, np.diag([1.0, -1.0, 1.0]), np.eye(3)]).withColumn("g", F.when(F.col("id") < 3, 1).otherwise(2))

    def log(m):
        e, v = np.linalg.eigh(m)
        return (v * np.log(e)) @ v.T

    e, v = np.linalg.eigh((log(a) + log(b)) / 2)
    got = {r["g"]: np.reshape(r["mean"], (3, 3)) for r in dense.log_mean(df, ["g"], "m").collect()}
    assert np.abs(got[1] - (v * np.exp(e)) @ v.T).max() < 1e-12 and np.abs(got[2] - np.eye(3)).max() < 1e-15


def test_sums_are_the_same_in_any_order(spark):
    x = np.concatenate([RNG.standard_normal(3000) * 10.0 ** RNG.integers(-8, 9, 3000), [1e16, 1.0, -1e16]])
    rows = [(k % 4 if k % 5 else None, float(v)) for k, v in enumerate(x)] + [(9, None), (10, math.inf), (10, 1.0), (11, math.inf), (11, -math.inf), (12, None), (12, 2.5), (13, 0.0), (14, 1e-310), (14, 1e-310)]
    df = spark.createDataFrame(rows, "g long, x double")
    told = [sorted(map(tuple, sums.exact_sums(d, ["g"], "x").collect()), key=str) for d in (df, df.repartition(1).orderBy("x"), df.repartition(9))]
    assert str(told[0]) == str(told[1]) == str(told[2])
    got = dict(told[0])
    for g in (None, 0, 1, 2, 3):
        assert got[g] == math.fsum(v for k, v in rows if k == g and v is not None)
    assert got[9] is None and got[10] == math.inf and math.isnan(got[11]) and got[12] == 2.5 and got[13] == 0.0
    areas = RNG.random(20_000)
    one = spark.createDataFrame([(float(a),) for a in areas], "x double")
    assert abs(sums.exact_sums(one, [], "x").first()[0] - math.fsum(areas)) < 1e-12 and sums.exact_sums(one.limit(0), [], "x").collect()[0][0] is None


def sign(x):
    return (x > 0) - (x < 0)


def test_orientation_is_exact_in_every_order(spark):
    rows, want = [], []
    for k in range(60):
        p = [(0.5 + i * math.ulp(0.5), 0.5 + j * math.ulp(0.5)) for i, j in RNG.integers(0, 40, (1, 2)).tolist()] + [(12.0, 12.0), (24.0, 24.0)]
        for q in permutations(p):
            (ax, ay), (bx, by), (cx, cy) = [tuple(map(Fraction, c)) for c in q]
            rows.append((len(rows), *[x for c in q for x in c]))
            want.append(sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)))
    rows += [(len(rows), 1e300, 1e-300, -1e300, 1e-300, 0.0, 1e-300), (len(rows) + 1, None, 0.0, 1.0, 0.0, 0.0, 1.0), (len(rows) + 2, math.nan, 0.0, 1.0, 0.0, 0.0, 1.0), (len(rows) + 3, 0.0, 0.0, 1e-200, 0.0, 0.0, 1e-200)]
    want += [0, None, None, 1]
    df = spark.createDataFrame(rows, "id long, ax double, ay double, bx double, by double, cx double, cy double")
    got = {r["id"]: r["turn"] for r in predicates.with_orientation(df, ("ax", "ay"), ("bx", "by"), ("cx", "cy")).collect()}
    assert [got[k] for k in range(len(rows))] == want and {-1, 0, 1} <= set(want)


def test_cocircular_points_are_told_exactly(spark):
    rows, want = [], []
    circle = [(3.0, 4.0), (4.0, 3.0), (-3.0, 4.0), (0.0, -5.0), (5.0, 0.0)]
    for k in range(200):
        p = [circle[i] for i in RNG.choice(5, 4, replace=False)]
        if k % 2:
            p[3] = (p[3][0] + int(RNG.integers(-2, 3)) * 2.0**-50, p[3][1])
        rows.append((k, *[x for c in p for x in c]))
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = [tuple(map(Fraction, c)) for c in p]
        m = [(x - dx, y - dy, (x - dx) ** 2 + (y - dy) ** 2) for x, y in ((ax, ay), (bx, by), (cx, cy))]
        det = sum(m[i][2] * (m[(i + 1) % 3][0] * m[(i + 2) % 3][1] - m[(i + 1) % 3][1] * m[(i + 2) % 3][0]) for i in range(3))
        want.append(sign(det))
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c}{k} double" for c in "abcd" for k in "xy"))
    got = {r["id"]: r["inside"] for r in predicates.with_circle_side(df, *[(f"{c}x", f"{c}y") for c in "abcd"]).collect()}
    assert [got[k] for k in range(200)] == want and {-1, 0, 1} <= set(want)


@pytest.mark.parametrize("n", [1, 7])
def test_factors_rebuild_the_matrix(n):
    a = RNG.standard_normal((5, n, n))
    lu, order, sign_ = dense.factored(a)
    low, up = np.tril(lu, -1) + np.eye(n), np.triu(lu)
    assert np.abs(low @ up - np.take_along_axis(a, order[:, :, None], axis=1)).max() < 1e-13 and np.abs(np.tril(lu, -1)).max(initial=0) <= 1
    b = RNG.standard_normal((5, n, 2))
    assert np.abs(a @ dense.solved(lu, order, b) - b).max() < 1e-10 and set(np.abs(sign_)) == {1.0}


def test_signs_of_whole_columns_are_those_of_whole_numbers():
    rng = np.random.default_rng(5)
    for exact, m in ((predicates._orientation, 6), (predicates._circle, 8)):
        sets = [rng.integers(0, 16, (m, 300)) / 1024, rng.normal(size=(m, 60)) * 10.0 ** rng.integers(-300, 300, (m, 60)), rng.integers(-(2**13), 2**13 + 1, (m, 300)).astype(float), np.full((m, 2), 5e-324)]
        for p in sets:
            want = [exact(predicates._whole(column.tolist())) for column in p.T]
            assert predicates.signs(p, exact).tolist() == [(d > 0) - (d < 0) for d in want]
