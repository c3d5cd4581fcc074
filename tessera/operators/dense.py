"""Dense matrices of any size in array columns: elimination with pivots, Jacobi rotations, functions of symmetric matrices.

A matrix is an array<double> of n * n numbers, row by row. All matrices of a batch that have one size are worked on
together: loops run over rows and columns, not over matrices.

Nulls and edges: a null array, one that isn't square, or one with a null or non-finite number gives null; the empty
matrix has determinant 1. A singular matrix (a pivot of 0) has determinant 0 and a null inverse. Functions take the lower
and upper half's mean; a logarithm, or a power that isn't a whole number above 0, of a matrix with an eigenvalue that isn't positive is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sweeps of Jacobi rotations at most; each is quadratic near the end.
SWEEPS = 30


def factored(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LU of matrices (m, n, n) in one array, the order of their rows (m, n), and the sign of that order; pivots are the largest of their column."""
    a = a.astype(float).copy()
    m, n, _ = a.shape
    each, order, sign = np.arange(m), np.tile(np.arange(n), (m, 1)), np.ones(m)
    for k in range(n):
        pivot = k + np.abs(a[:, k:, k]).argmax(axis=1)
        sign[pivot != k] *= -1
        for x in (a, order):
            held = x[each, pivot].copy()
            x[each, pivot] = x[:, k]
            x[:, k] = held
        top = a[:, k, k]
        a[:, k + 1 :, k] /= np.where(top == 0, 1.0, top)[:, None]
        a[:, k + 1 :, k + 1 :] -= a[:, k + 1 :, k, None] * a[:, k, None, k + 1 :]
    return a, order, sign


def solved(lu: np.ndarray, order: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x (m, n, k) of A x = b for factored matrices without a pivot of 0."""
    x = np.take_along_axis(b, order[:, :, None], axis=1).astype(float)
    n = lu.shape[1]
    for k in range(n):
        x[:, k + 1 :] -= lu[:, k + 1 :, k, None] * x[:, k, None]
    for k in range(n - 1, -1, -1):
        x[:, k] /= lu[:, k, k, None]
        x[:, :k] -= lu[:, :k, k, None] * x[:, k, None]
    return x


def rotated(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (m, n), falling, and eigenvectors (m, n, n), in columns, of symmetric matrices by cyclic Jacobi rotations."""
    a = (a + a.transpose(0, 2, 1)) / 2
    m, n, _ = a.shape
    v = np.tile(np.eye(n), (m, 1, 1))
    for _ in range(SWEEPS):
        off = np.abs(a - a * np.eye(n)).max(axis=(1, 2), initial=0.0)
        if (off <= 1e-300 + 1e-17 * np.abs(a).max(axis=(1, 2), initial=0.0)).all():
            break
        for p in range(n - 1):
            for q in range(p + 1, n):
                apq = a[:, p, q]
                turn = apq != 0
                with np.errstate(over="ignore"):  # a very small entry turns by nothing
                    tau = (a[:, q, q] - a[:, p, p]) / (2 * np.where(turn, apq, 1.0))
                    t = np.where(turn, np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau)), 0.0)
                c = 1 / np.sqrt(1 + t * t)
                s = t * c
                for x, axis in ((a, 1), (a, 2), (v, 2)):
                    xp, xq = (x[:, p].copy(), x[:, q].copy()) if axis == 1 else (x[:, :, p].copy(), x[:, :, q].copy())
                    one, two = c[:, None] * xp - s[:, None] * xq, s[:, None] * xp + c[:, None] * xq
                    if axis == 1:
                        x[:, p], x[:, q] = one, two
                    else:
                        x[:, :, p], x[:, :, q] = one, two
                a[:, p, q] = a[:, q, p] = 0.0
    values = np.diagonal(a, axis1=1, axis2=2)
    order = np.argsort(-values, axis=1, kind="stable")
    return np.take_along_axis(values, order, axis=1), np.take_along_axis(v, order[:, None, :], axis=2)


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrices) of each size in a batch; what isn't a finite square matrix is left out."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    for size in np.unique(sizes):
        n = round(max(size, 0) ** 0.5)
        if size >= 0 and n * n == size:
            rows = np.flatnonzero(sizes == size)
            flat = column.take(pa.array(rows)).flatten()
            a = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), n, n)
            fine = np.isfinite(a).all(axis=(1, 2))
            yield rows[fine], a[fine]


def _with(df: DataFrame, column: str, fields: dict[str, T.DataType], kernel: Callable[[np.ndarray], dict[str, list]]) -> DataFrame:
    """df with new columns, of which the kernel makes lists from matrices of one size."""
    kept = [c for c in df.columns if c not in fields]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, t) for c, t in fields.items()])
    arrow = {c: pa.float64() if isinstance(t, T.DoubleType) else pa.list_(pa.float64()) for c, t in fields.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [None] * batch.num_rows for c in fields}
            for rows, a in _by_size(batch.column(len(kept))):
                for c, values in kernel(a).items():
                    for r, x in zip(rows.tolist(), values, strict=True):
                        out[c][r] = x
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *[pa.array(out[c], arrow[c]) for c in fields]], names=[f.name for f in schema])

    return df.select(*kept, F.col(column).cast("array<double>").alias("_matrix_")).mapInArrow(run, schema)


def _flat(a: np.ndarray) -> list:
    return [x.ravel() for x in a]


NUMBER, NUMBERS = T.DoubleType(), T.ArrayType(T.DoubleType())


def with_inverse(df: DataFrame, column: str, det: str = "det", inverse: str = "inverse") -> DataFrame:
    """df with the determinant and the inverse of a column of matrices."""

    def kernel(a: np.ndarray) -> dict[str, list]:
        lu, order, sign = factored(a)
        pivots = np.diagonal(lu, axis1=1, axis2=2)
        regular = (pivots != 0).all(axis=1)
        safe = np.where(regular[:, None, None], lu, np.eye(a.shape[1]))
        back = solved(safe, order, np.tile(np.eye(a.shape[1]), (len(a), 1, 1)))
        back = [x if ok and np.isfinite(x).all() else None for x, ok in zip(_flat(back), regular.tolist(), strict=True)]
        return {det: (sign * pivots.prod(axis=1)).tolist(), inverse: back}

    return _with(df, column, {det: NUMBER, inverse: NUMBERS}, kernel)


def with_eigen(df: DataFrame, column: str, values: str = "values", vectors: str = "vectors") -> DataFrame:
    """df with the eigenvalues (falling) and eigenvectors (columns of a matrix) of a column of symmetric matrices."""

    def kernel(a: np.ndarray) -> dict[str, list]:
        e, v = rotated(a)
        return {values: list(e), vectors: _flat(v)}

    return _with(df, column, {values: NUMBERS, vectors: NUMBERS}, kernel)


def with_function(df: DataFrame, column: str, name: str, function: str, power: float = 0.5) -> DataFrame:
    """df with exp, log, sqrt or power of a column of symmetric matrices, through their eigenvalues."""
    positive = function in ("log", "sqrt") or (function == "power" and not (power > 0 and float(power).is_integer()))
    f = {"exp": np.exp, "log": np.log, "sqrt": np.sqrt, "power": lambda e: e**power}[function]

    def kernel(a: np.ndarray) -> dict[str, list]:
        e, v = rotated(a)
        least = 0.0 if function == "sqrt" else np.nextafter(0, 1)
        fine = (e >= least).all(axis=1) if positive else np.ones(len(e), dtype=bool)
        made = (v * f(np.where(fine[:, None], e, 1.0))[:, None, :]) @ v.transpose(0, 2, 1)
        return {name: [x if ok else None for x, ok in zip(_flat(made), fine.tolist(), strict=True)]}

    return _with(df, column, {name: NUMBERS}, kernel)


def log_mean(df: DataFrame, by: list[str], column: str, name: str = "mean") -> DataFrame:
    """by, mean: the log-Euclidean mean of definite matrices of one size a group; those that aren't definite don't count."""
    logs = with_function(df.select(*by, column), column, "_log_", "log").filter("_log_ IS NOT NULL")
    cells = logs.select(*by, F.posexplode("_log_").alias("at", "x")).groupBy(*by, "at").agg(F.avg("x").alias("x"))
    rows = cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("_sum_"))
    return with_function(rows, "_sum_", name, "exp").select(*by, name)
