"""Sparse matrices as (i, j, value) rows and vectors as (i, value) rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import checkpointed
from tessera.operators.stored import batches, stored


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    """i, value of A x."""
    return a.join(x.select(F.col("i").alias("j"), F.col("value").alias("_x")), "j").groupBy("i").agg(F.sum(F.col("value") * F.col("_x")).alias("value"))


def thin_spmm(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, value of A B where few terms make an entry: all terms are shuffled."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("value").alias("w"))
    return a.select("i", F.col("j").alias("k"), "value").join(right, "k").groupBy("i", F.col("c").alias("j")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


#: Rows and columns of a block of a product (a power of 2), the terms a task adds at once, and the entries of a block of rows or columns after which it is shared.
BITS, HELD, SHARE = 10, 2_000_000, 4_000_000
_SIDE = 1 << BITS


class _Run:
    """Entries (k, place in the block, value) of a block of rows or columns, or a share of one, in the order of k, and where each k's begin."""

    def __init__(self, block: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        k, name, self.value = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.block, self.place = block, name - block * _SIDE
        self.first = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        self.k, self.count = k[self.first], np.diff(np.append(self.first, len(k)))

    def __len__(self) -> int:
        return len(self.place)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Run]:
    """The runs of rows (block, share, k, name, value) in the order of the first three."""
    now, parts = None, []
    for batch in batches:
        block, share, *rest = (batch.column(c).to_numpy() for c in ("block", "share", "k", "name", "value"))
        ends = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (share[1:] != share[:-1])) + 1).tolist(), len(block)]
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            if low == high:
                continue
            if now != (key := (int(block[low]), int(share[low]))):
                if parts:
                    yield _Run(now[0], parts)
                now, parts = key, []
            parts.append(tuple(x[low:high] for x in rest))
    if parts:
        yield _Run(now[0], parts)


def _product(left: _Run, right: _Run) -> pa.RecordBatch | None:
    """i, j, value of the entries that two runs make."""
    if left.k[-1] < right.k[0] or right.k[-1] < left.k[0]:
        return None
    at = np.minimum(np.searchsorted(right.k, left.k), len(right.k) - 1)
    l = np.flatnonzero(right.k[at] == left.k)  # noqa: E741
    if not len(l):
        return None
    r = at[l]
    upto = np.cumsum(left.count[l] * right.count[r])
    few = upto[-1] * 8 < _SIDE * _SIDE
    made, total = 0, 0.0
    low = 0
    while low < len(l):
        high = max(low + 1, int(np.searchsorted(upto, HELD + (upto[low - 1] if low else 0), "right")))
        m = left.count[l[low:high]]
        entry = np.arange(m.sum()) + np.repeat(left.first[l[low:high]] - (np.cumsum(m) - m), m)
        n = np.repeat(right.count[r[low:high]], m)
        other = np.arange(n.sum()) + np.repeat(np.repeat(right.first[r[low:high]], m) - (np.cumsum(n) - n), n)
        cell = np.repeat(left.place[entry] * _SIDE, n) + right.place[other]
        term = np.repeat(left.value[entry], n) * right.value[other]
        if few:  # in one go
            found, back = np.unique(cell, return_inverse=True)
            value = np.bincount(back, term, len(found))
        else:
            made, total = made + np.bincount(cell, minlength=_SIDE * _SIDE), total + np.bincount(cell, term, _SIDE * _SIDE)
        low = high
    if not few:  # an entry whose terms cancel stays
        found = np.flatnonzero(made)
        value = total[found]
    return pa.RecordBatch.from_arrays([pa.array(left.block * _SIDE + found // _SIDE), pa.array(right.block * _SIDE + found % _SIDE), pa.array(value)], names=["i", "j", "value"])


def _by_blocks(df: DataFrame, k: str, name: str) -> tuple[DataFrame, bool]:
    """block, share, k, name, value, dealt by block and share and in the order of these and k; whether a block is shared."""
    rows = df.select(F.shiftright(F.col(name).cast("long"), BITS).alias("block"), F.col(k).cast("long").alias("k"), F.col(name).cast("long").alias("name"), F.col("value").cast("double").alias("value"))
    # A power of 2 shares, so that shares of rows and of columns hold each other's k or have none in common.
    large = rows.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > SHARE)
    large = checkpointed(large.select("block", F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / SHARE))).cast("int").alias("shares")))
    shared = not large.isEmpty()
    rows = rows.join(F.broadcast(large), "block", "left") if shared else rows.withColumn("shares", F.lit(1))
    rows = rows.withColumn("share", F.pmod(F.xxhash64("k"), F.coalesce("shares", F.lit(1))).cast("int"))
    return rows.select("block", "share", "k", "name", "value").repartition("block", "share").sortWithinPartitions("block", "share", "k"), shared


def spmm(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, value of A B, as doubles, for whole numbers i and j.

    Entries are dealt once: B's are stored by blocks of columns, and a task holds some blocks of A's rows and reads what is
    stored, so neither terms nor copies of entries are shuffled, whichever blocks meet. A block of more than SHARE entries is
    shared by their k, and the shares' sums are added. Terms of null names or values go the plain way.
    """
    odd = lambda df, c: df.filter(f"{c} IS NULL OR value IS NULL")
    left, parted = _by_blocks(a.filter("i IS NOT NULL AND j IS NOT NULL AND value IS NOT NULL"), "j", "i")
    right, split = _by_blocks(b.filter("i IS NOT NULL AND j IS NOT NULL AND value IS NOT NULL"), "i", "j")
    split |= parted
    _, files = stored(right)
    most = SHARE

    def met(held: list[_Run]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches(files, ["block", "share", "k", "name", "value"], size=1 << 16)):
            yield from (x for x in (_product(h, run) for h in held) if x)

    def added_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Run] = []
        for run in _runs(parts):
            if held and sum(map(len, held)) + len(run) > most:
                yield from met(held)
                held = []
            held.append(run)
        if held:
            yield from met(held)

    out = left.mapInArrow(added_up, "i long, j long, value double")
    rest = [thin_spmm(x, y) for x, y in ((odd(a, "i"), b), (a.filter("i IS NOT NULL AND value IS NOT NULL"), odd(b, "j")))]
    for r, x in zip(rest, (odd(a, "i"), odd(b, "j")), strict=True):
        if not x.isEmpty():
            out, split = out.unionByName(r.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("value").cast("double").alias("value"))), True
    return out.groupBy("i", "j").agg(F.sum("value").alias("value")) if split else out


def transpose(a: DataFrame, factor: float = 1.0) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("value") * factor).alias("value"))


def norms(a: DataFrame) -> DataFrame:
    """Frobenius norm and number of entries."""
    return a.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.count("*").alias("nnz"))


def jacobi(a: DataFrame, b: DataFrame, rounds: int) -> DataFrame:
    """x after so many Jacobi rounds from 0. A needs a full diagonal."""
    diagonal = a.filter("i = j").select("i", F.col("value").alias("d"))
    rest = checkpointed(a.filter("i <> j"))
    base = checkpointed(b.join(diagonal, "i").select("i", F.col("value").alias("b"), "d"))
    x = base.select("i", F.lit(0.0).alias("value"))
    for k in range(rounds):
        moved = spmv(rest, x).select("i", F.col("value").alias("s"))
        x = base.join(moved, "i", "left").select("i", ((F.col("b") - F.coalesce("s", F.lit(0.0))) / F.col("d")).alias("value"))
        if k % 5 == 4:
            x = checkpointed(x)
    return x


def _inner(x: DataFrame, p: str, q: str) -> float:
    return x.agg(F.sum(F.col(p) * F.col(q))).first()[0] or 0.0


def _unknowns(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, value (of b, else 0), d (the diagonal, else 1) of every row that A or b has."""
    diagonal = a.groupBy("i").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("value"))).alias("d"))
    both = b.select("i", "value").join(diagonal, "i", "full")
    return both.select("i", F.coalesce("value", F.lit(0.0)).alias("value"), F.when(F.coalesce("d", F.lit(0.0)) != 0, F.col("d")).otherwise(1.0).alias("d"))


def conjugate_gradient(a: DataFrame, b: DataFrame, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """i, value solving A x = b for a symmetric definite A, with the diagonal (1 where it has none) as preconditioner.

    One row per unknown of A or b holds all vectors, so a round is one product and two sums. A system that is not definite
    has a row for each unknown too, of the best that was reached before a direction without curvature.
    """
    a = checkpointed(a)
    state = checkpointed(_unknowns(a, b).select("i", F.lit(0.0).alias("x"), F.col("value").alias("r"), "d", (F.col("value") / F.col("d")).alias("p")))
    sums = lambda s: [x or 0.0 for x in s.agg(F.sum(F.col("r") * F.col("r")), F.sum(F.col("r") * F.col("r") / F.col("d"))).first()]
    size, rho = sums(state)
    goal = tolerance * size**0.5
    for _ in range(most):
        if size**0.5 <= goal or rho == 0:
            break
        product = spmv(a, state.select("i", F.col("p").alias("value"))).select("i", F.col("value").alias("q"))
        state = checkpointed(state.join(product, "i", "left").fillna(0.0, ["q"]))
        bend = _inner(state, "p", "q")
        if bend == 0:
            break
        alpha = rho / bend
        state = checkpointed(state.select("i", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "d", "p"))
        size, fresh = sums(state)
        state = state.withColumn("p", F.col("r") / F.col("d") + (fresh / rho) * F.col("p"))
        rho = fresh
    return state.select("i", F.col("x").alias("value"))


def bicgstab(a: DataFrame, b: DataFrame, tolerance: float = 1e-6, most: int = 50) -> DataFrame:
    """i, value solving A x = b for a general A, with the diagonal (1 where it has none) as preconditioner; a row for each unknown of A or b."""
    a = checkpointed(a)
    zero = F.lit(0.0)
    state = checkpointed(_unknowns(a, b).select("i", "d", zero.alias("x"), F.col("value").alias("r"), F.col("value").alias("q"), zero.alias("p"), zero.alias("v")))
    goal = tolerance * _inner(state, "r", "r") ** 0.5
    rho = alpha = omega = 1.0
    for _ in range(most):
        if _inner(state, "r", "r") ** 0.5 <= goal:
            break
        fresh = _inner(state, "q", "r")
        if fresh == 0 or omega == 0:
            break
        beta = fresh / rho * alpha / omega
        state = state.withColumn("p", F.col("r") + beta * (F.col("p") - omega * F.col("v"))).drop("v")
        v = spmv(a, state.select("i", (F.col("p") / F.col("d")).alias("value"))).select("i", F.col("value").alias("v"))
        state = checkpointed(state.join(v, "i", "left").fillna(0.0, ["v"]))
        along = _inner(state, "q", "v")
        if along == 0:
            break
        alpha = fresh / along
        state = state.withColumn("s", F.col("r") - alpha * F.col("v"))
        t = spmv(a, state.select("i", (F.col("s") / F.col("d")).alias("value"))).select("i", F.col("value").alias("t"))
        state = checkpointed(state.join(t, "i", "left").fillna(0.0, ["t"]))
        size = _inner(state, "t", "t")
        omega = _inner(state, "t", "s") / size if size else 0.0
        x = F.col("x") + (alpha * F.col("p") + omega * F.col("s")) / F.col("d")
        state = checkpointed(state.select("i", "d", x.alias("x"), (F.col("s") - omega * F.col("t")).alias("r"), "q", "p", "v"))
        rho = fresh
    return state.select("i", F.col("x").alias("value"))
