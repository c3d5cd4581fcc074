"""Principal components of embeddings by a block Jacobi-Davidson method, and whitening.

The covariance is never formed. A product with a block of vectors is one Spark job:
each task centres its rows before it multiplies and sums Z^T (Z B) piece by piece,
with the rounding errors of the sums carried along; Spark adds the tasks' sums. The
driver holds the basis only, a few times as many vectors as are wanted.

A round: Rayleigh-Ritz in the basis; pairs whose residual is down at double precision
are locked (they stay in the basis and are projected out of what follows); for the
others the correction equation (I - QQ^T)(V - theta I)(I - QQ^T) t = -r, with Q all
wanted Ritz vectors, is solved roughly by MINRES, all columns side by side with one
distributed product a step; the corrections, made orthogonal, widen the basis, which
is cut back to the best Ritz vectors when it is full, with more room each time. It ends when all are locked and
a product of the vectors themselves confirms it.

Entries c become x = floor(64 * c) + 1000000 as long. Sums are exact (decimals over
the tasks' whole numbers), and a centred entry (n * x - S) / n is a whole number
divided once, so the large offset costs no digits.

Nulls and edges: vectors that are null or hold null or non-finite entries are dropped,
as are those with an entry of 2^50 or more and those of another length than most (of
equally frequent lengths the greater stays); repeated rows count each; a row without an
id stays, its id null; a component without variance (fewer vectors than components,
equal rows) can't be whitened: whitened is null there, explained is 0 and identity_error
leaves it out; a deviation beyond a long is null; no vectors, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import checkpointed, quoted

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Rows that a task centres and multiplies at once.
PIECE = 2048
#: A residual counts as double precision at so many units of rounding of the largest eigenvalue.
UNITS = 64
#: Inner steps at most, their relative tolerance, outer rounds at most, and the basis in multiples of the components wanted.
INNER, INNER_TOLERANCE, OUTER, BASIS = 8, 1e-3, 200, 4
EPS = float(np.finfo(np.float64).eps)


def fit_list(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x (array of long) of the vectors that take part."""
    rows = vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("v"))
    unfit = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 50) / SCALE)
    rows = rows.filter("v IS NOT NULL").filter(~F.exists("v", unfit))
    rows = rows.select("id", F.transform("v", lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))
    rows = checkpointed(rows)
    dims = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1)
    dim = (dims.first() or [0])[0]
    return rows.filter(F.size("x") == dim)


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    at = batch.column(batch.schema.get_field_index(column))
    return np.asarray(at.flatten()).reshape(batch.num_rows, -1)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the sum of each dimension, as Python's integers."""
    schema = "dim int, n long, s decimal(38,0)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch)
            high = x >> 25  # both halves are summed without overflow
            parts = [int(h) * (1 << 25) + int(r) for h, r in zip(high.sum(axis=0), (x - (high << 25)).sum(axis=0), strict=True)]
            n, sums = n + len(x), parts if sums is None else [a + b for a, b in zip(sums, parts, strict=True)]
        if n:
            import decimal

            with decimal.localcontext(decimal.Context(prec=38)):
                columns = [pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums)), pa.array(list(map(decimal.Decimal, sums)), pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "n", "s"])

    got = rows.select("x").mapInArrow(run, schema).groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("dim").collect()
    return (int(got[0]["n"]) if got else 0), [int(r["s"]) for r in got]


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in longs where they fit, else in Python's integers."""
    most = max(int(np.abs(x).max()), 1) * n
    if most + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def squares(d: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; None beyond a long."""
    if d.dtype == object or int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63:
        sums = [sum(int(c) * int(c) for c in r) for r in d]
        return [s if s < 1 << 63 else None for s in sums]
    return (d * d).sum(axis=1).tolist()


def centred(batches: Iterator[pa.RecordBatch], n: int, sums: list[int]) -> Iterator[np.ndarray]:
    """The centred rows in pieces, each entry a whole number divided once."""
    for batch in batches:
        for k in range(0, batch.num_rows, PIECE):
            yield (differences(matrix(batch.slice(k, PIECE)), n, sums) / n).astype(np.float64)


class Covariance:
    """The covariance of the rows as an operator; products are Spark jobs."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.n, self.sums = exact_sums(rows)
        self.dim, self.products = len(self.sums), 0

    def _summed(self, of, width: int) -> np.ndarray:
        """The sum over all rows of of(centred piece), an array of rows by width, by tasks and then by Spark."""
        schema = "row int, s array<double>"
        rows, n, totals = self.rows.select("x"), self.n, self.sums

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = lost = None
            for z in centred(batches, n, totals):
                y = of(z)
                if total is None:
                    total, lost = y, np.zeros_like(y)
                    continue
                s = total + y
                big = np.abs(total) >= np.abs(y)
                lost += np.where(big, (total - s) + y, (y - s) + total)
                total = s
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total + lost), pa.list_(pa.float64()))], names=["row", "s"])

        sums = [F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(width)]
        got = rows.mapInArrow(run, schema).groupBy("row").agg(*sums).orderBy("row").collect()
        return np.array([list(r)[1:] for r in got], dtype=np.float64)

    def __matmul__(self, b: np.ndarray) -> np.ndarray:
        self.products += 1
        return self._summed(lambda z: z.T @ (z @ b), b.shape[1]) / self.n

    def trace(self) -> float:
        return float(self._summed(lambda z: (z * z).sum(axis=1, keepdims=True).sum(axis=0, keepdims=True), 1)[0, 0] / self.n)

    def identity_error(self, turn: np.ndarray) -> float:
        """Largest absolute entry of the covariance of z @ turn minus the identity."""
        m = turn.shape[1]
        if not m:
            return 0.0

        def of(z: np.ndarray) -> np.ndarray:
            w = z @ turn
            return np.vstack([w.T @ w, w.sum(axis=0, keepdims=True)])

        got = self._summed(of, m) / self.n
        return float(np.abs(got[:m] - np.outer(got[m], got[m]) - np.eye(m)).max())


def minres(apply, b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Approximate solutions of the symmetric systems apply(columns, x) = b, column by column side by side.

    apply gets the numbers of the columns that are still worked on; a column leaves
    once its residual has fallen by tolerance.
    """
    x = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    on = np.flatnonzero(beta > 0)
    v, beta = b[:, on] / beta[on], beta[on]
    start, eta = beta.copy(), beta.copy()
    v_old, w, w_old = (np.zeros_like(v) for _ in range(3))
    c = c_old = np.ones(len(on))
    s = s_old = np.zeros(len(on))
    beta = np.zeros(len(on))
    for _ in range(steps):
        if not len(on):
            break
        p = apply(on, v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        # Two earlier rotations, then the one that removes beta_new.
        d, e, f = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        r = np.maximum(np.hypot(d, beta_new), 1e-300)
        c_old, s_old, c, s = c, s, d / r, beta_new / r
        w, w_old = (v - e * w - f * w_old) / r, w
        x[:, on] += c * eta * w
        eta = -s * eta
        go = (np.abs(eta) > tolerance * start) & (beta_new > 1e-14 * start)
        v_old, v = v, p / np.maximum(beta_new, 1e-300)
        v, v_old, w, w_old = (a[:, go] for a in (v, v_old, w, w_old))
        c, c_old, s, s_old, eta, start, beta, on = (a[go] for a in (c, c_old, s, s_old, eta, start, beta_new, on))
    return x


def orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what new adds to an orthonormal basis."""
    new = new / np.maximum(np.linalg.norm(new, axis=0), 1e-300)
    for _ in range(2):
        new = new - basis @ (basis.T @ new)
        u, size, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, size > 1e-10]
    return new


def jacobi_davidson(a, dim: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The wanted largest eigenvalues, falling, and unit eigenvectors of a symmetric operator (a @ block)."""
    wanted = min(wanted, dim)
    if not wanted:
        return np.zeros(0), np.zeros((dim, 0))
    start = np.random.default_rng(seed).standard_normal((dim, wanted))
    basis = orthonormal(start, np.zeros((dim, 0)))
    image, room = a @ basis, BASIS * wanted
    for _ in range(OUTER):
        h = basis.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        y, theta = y[:, ::-1], theta[::-1]
        vectors, images = basis @ y[:, :wanted], image @ y[:, :wanted]
        values = theta[:wanted]
        residual = images - vectors * values
        size = np.linalg.norm(residual, axis=0)
        floor = UNITS * EPS * max(abs(theta[0]), 1e-300)
        if (size <= floor).all():
            # The basis' images carry the roundings of many rounds; a product of the vectors themselves doesn't.
            fresh = a @ vectors
            values = (vectors * fresh).sum(axis=0)
            residual = fresh - vectors * values
            size = np.linalg.norm(residual, axis=0)
            if (size <= 2 * floor).all():
                order = np.argsort(-values, kind="stable")
                return np.maximum(values[order], 0.0), vectors[:, order]
            basis, image = vectors, fresh
            floor = 2 * floor
        if basis.shape[1] + wanted > room and basis.shape[1] < dim:
            keep, room = 2 * wanted, room + wanted  # eigenvalues hardly apart need more room, at worst the whole space
            basis, image = basis @ y[:, :keep], image @ y[:, :keep]
        active = np.flatnonzero(size > floor)
        project = lambda x: x - vectors @ (vectors.T @ x)  # noqa: B023, E731

        def correction(on: np.ndarray, x: np.ndarray) -> np.ndarray:
            x = project(x)
            return project(a @ x - x * values[active[on]])  # noqa: B023

        t = project(minres(correction, project(-residual[:, active]), INNER, INNER_TOLERANCE))
        new = orthonormal(np.hstack([t, residual[:, active]]) if len(active) == 1 else t, basis)
        if not new.shape[1]:
            new = orthonormal(np.random.default_rng(basis.shape[1]).standard_normal((dim, 1)), basis)
        if not new.shape[1]:  # the basis is the whole space: take its images anew
            basis = np.linalg.qr(basis)[0]
            image = a @ basis
            continue
        basis, image = np.hstack([basis, new]), np.hstack([image, a @ new])
    raise RuntimeError(f"eigenvectors did not converge in {OUTER} rounds")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error, a row for each vector and component."""
    kind = vectors.schema[id_col].dataType
    new = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL(new).fields])
    rows = fit_list(vectors, id_col, vector_col)
    cov = Covariance(rows)
    if not cov.n:
        return vectors.sparkSession.createDataFrame([], schema)
    values, turn = jacobi_davidson(cov, cov.dim, components)
    trace = cov.trace()
    has = values > cov.dim * UNITS * EPS * max(float(values[0]), 0.0)
    scaled = turn * np.where(has, 1 / np.sqrt(np.where(has, values, 1.0)), 0.0)
    error = cov.identity_error(scaled[:, has])
    explained = np.where(has, values / (trace or 1.0), 0.0)
    m, n, sums = len(values), cov.n, cov.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PIECE):
                part = batch.slice(k, PIECE)
                d, size = differences(matrix(part), n, sums), part.num_rows
                w = (d / n).astype(np.float64) @ scaled
                each = pa.array(np.repeat(np.arange(size), m))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("id")).take(each),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * m, n)),
                        pa.array(squares(d), pa.int64()).take(each),
                        pa.array(w.ravel(), mask=np.tile(~has, size)),
                        pa.array(np.tile(explained, size)),
                        pa.array(np.full(size * m, error)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
