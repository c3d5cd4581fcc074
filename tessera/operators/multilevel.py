"""Conjugate gradients with an algebraic multilevel preconditioner by smoothed aggregation.

Levels are made from the matrix alone, by joins: unknowns gather around roots that are more than two strong links
apart, each gathering is one unknown of the next level, and the interpolation is smoothed once. The work of a
symmetric cycle (one damped step before and one after each correction) is then a sum over the levels, so that
applying it is one plan of products, and the rounds hardly grow with the number of unknowns. The coarsest level has
at most `dense` unknowns, whose pseudo-inverse is the only thing that passes through the driver; it leaves out the
null space of systems like pure flux problems. Where levels stop shrinking before that, the last one has damped steps only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import dissection
from tessera.operators.ordering import Rounds, checkpointed
from tessera.operators.sparse import spmv, thin_spmm, transpose

DENSE = 256
STRONG = 0.08


@dataclass
class Level:
    """smooth (i, j, value): what both damped steps do to a residual; prolong (i, j, value): to it from the next level, if any."""

    smooth: DataFrame
    prolong: DataFrame | None
    unknowns: int


def _diagonal(a: DataFrame, i: str, d: str) -> DataFrame:
    return a.filter("i = j").select(F.col("i").alias(i), F.col("value").alias(d))


def strong_links(a: DataFrame, least: float) -> DataFrame:
    """i, j, weight of entries off the diagonal of at least so large a share of the geometric mean of their diagonals."""
    off = a.filter("i <> j AND value <> 0").join(_diagonal(a, "i", "di"), "i").join(_diagonal(a, "j", "dj"), "j")
    return off.filter(F.col("value") * F.col("value") >= least * least * F.abs(F.col("di") * F.col("dj"))).select("i", "j", F.abs("value").alias("weight"))


def aggregates(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """i, root of all nodes (i): an independent set of roots at distances above two over links (i, j, weight, both ways).

    In a round every undecided node whose mark is the greatest within two links becomes a root, and those within two links
    of a root are out; marks are hashes, so rounds grow with the logarithm of the nodes. A node joins the root it is linked to,
    the others the gathering they are linked to most strongly. A node without links is its own root.
    """
    rounds = Rounds(nodes.sparkSession)
    state = rounds.next(nodes.select("i", F.lit(1).alias("state")))  # 2: root, 1: undecided, 0: out

    def greatest(marks: DataFrame) -> DataFrame:
        over = links.select("i", "j").join(marks.withColumnRenamed("i", "j"), "j").select("i", "mark")
        return marks.unionByName(over).groupBy("i").agg(F.max("mark").alias("mark"))

    while state.filter("state = 1").limit(1).count():
        marks = state.select("i", F.struct("state", F.xxhash64("i").alias("h"), F.col("i").alias("of")).alias("mark"))
        best = greatest(greatest(marks))
        fresh = F.when(F.col("state") != 1, F.col("state")).when(F.col("mark.of") == F.col("i"), 2).when(F.col("mark.state") == 2, 0).otherwise(1)
        state = rounds.next(state.join(best, "i").select("i", fresh.alias("state")))
    roots = state.filter("state = 2").select("i", F.col("i").alias("root"))

    def beside(known: DataFrame) -> DataFrame:
        rest = links.join(known.select("i"), "i", "left_anti")
        return rest.join(known.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.max(F.struct("weight", "root")).alias("m")).select("i", "m.root")

    first = checkpointed(roots.unionByName(beside(roots)))
    return checkpointed(first.unionByName(beside(first)))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("i", "j").agg(F.sum("value").alias("value")).filter("value <> 0")


def _less(p: DataFrame, ap: DataFrame, diagonal: DataFrame, omega: float) -> DataFrame:
    """P - omega D^-1 (A P)."""
    step = ap.join(diagonal, "i").select("i", "j", (-omega * F.col("value") / F.col("d")).alias("value"))
    return _summed(p.unionByName(step))


def _pseudo_inverse(a: DataFrame) -> DataFrame:
    """i, j, value of the pseudo-inverse of a symmetric matrix of few unknowns."""
    t = a.toArrow()
    i, j, value = (t[c].to_numpy() for c in ("i", "j", "value"))
    names, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    m = np.zeros((len(names), len(names)))
    np.add.at(m, (at[: len(i)], at[len(i) :]), value)
    e, q = np.linalg.eigh((m + m.T) / 2)
    kept = np.abs(e) > 1e-11 * np.abs(e).max(initial=0)
    inverse = (q[:, kept] / e[kept]) @ q[:, kept].T
    table = pa.table({"i": np.repeat(names, len(names)), "j": np.tile(names, len(names)), "value": inverse.ravel()})
    return checkpointed(a.sparkSession.createDataFrame(table))


def levels(a: DataFrame, dense: int = DENSE, strong: float = STRONG) -> list[Level]:
    """The levels of a symmetric (i, j, value) with a positive diagonal, definite or with constants as its null space."""
    out, a = [], checkpointed(_summed(a))
    size = a.filter("i = j").count()
    while size > dense:
        diagonal = checkpointed(_diagonal(a, "i", "d"))
        # Sums of a row's sizes over its diagonal bound the spectrum of D^-1 A.
        bound = a.groupBy("i").agg(F.sum(F.abs("value")).alias("s")).join(diagonal, "i").agg(F.max(F.col("s") / F.col("d"))).first()[0]
        omega = 4 / (3 * bound)
        both = a.join(diagonal, "i").join(diagonal.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
        step = F.when(F.col("i") == F.col("j"), 2 * omega / F.col("d")).otherwise(0.0) - omega * omega * F.col("value") / F.col("d") / F.col("dj")
        smooth = checkpointed(both.select("i", "j", step.alias("value")))
        links = checkpointed(strong_links(a, strong * 0.5 ** len(out)))
        group = aggregates(diagonal.select("i"), links)
        fewer = group.filter("i = root").count()
        if fewer > 0.9 * size:
            return [*out, Level(smooth, None, size)]
        flat = group.select("i", F.col("root").alias("j"), F.lit(1.0).alias("value"))
        p = checkpointed(_less(flat, thin_spmm(a, flat), diagonal, omega))
        ap = checkpointed(thin_spmm(a, p))
        out.append(Level(smooth, checkpointed(_less(p, ap, diagonal, omega)), size))
        a, size = checkpointed(_summed(thin_spmm(transpose(p), ap))), fewer
    return [*out, Level(_pseudo_inverse(a), None, size)]


def _product(a: DataFrame, x: DataFrame) -> DataFrame:
    """i, value: the terms of A x, not yet summed."""
    return a.join(x.select(F.col("i").alias("j"), F.col("value").alias("_x")), "j").select("i", (F.col("value") * F.col("_x")).alias("value"))


def cycle(of: list[Level], r: DataFrame) -> DataFrame:
    """i, value: the preconditioner applied to r (i, value), as one plan."""
    terms = _product(of[0].smooth, r)
    if of[0].prolong is not None:
        low = spmv(transpose(of[0].prolong), r)
        terms = terms.unionByName(_product(of[0].prolong, cycle(of[1:], low)))
    return terms.groupBy("i").agg(F.sum("value").alias("value"))


def _refined(a: DataFrame, r: DataFrame, places: DataFrame, tolerance: float, singular: bool) -> tuple[DataFrame, int, bool]:
    """(i, value), direct solves taken until the residual is below tolerance or no longer halves, and whether that is enough.

    singular: one unknown is held by what is added to its diagonal, which changes nothing where the right side sums to 0.
    """
    held = a
    if singular and (pin := a.filter("i = j").agg(F.min("i"), F.avg("value")).first())[0] is not None:
        held = a.unionByName(a.sparkSession.createDataFrame([tuple(pin)], "pin long, value double").select(F.col("pin").alias("i"), F.col("pin").alias("j"), "value"))
        held = checkpointed(_summed(held))
    norm = lambda df: (df.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0) ** 0.5
    first = before = norm(r)
    x, best, taken = r.withColumn("value", F.lit(0.0)), r, 0
    while before > tolerance * first:
        step = dissection.solve(held, best, places)
        x = checkpointed(x.unionByName(step).groupBy("i").agg(F.sum("value").alias("value")))
        left = r.unionByName(spmv(a, x).withColumn("value", -F.col("value")))
        left, taken = checkpointed(left.groupBy("i").agg(F.sum("value").alias("value"))), taken + 1
        size = norm(left)
        if not size < before / 2:
            break
        best, before = left, size
    return x, taken, before <= max(tolerance, 1e-8) * first


def solve(
    a: DataFrame, b: DataFrame, tolerance: float = 1e-10, most: int = 100, dense: int = DENSE, singular: bool = False, places: DataFrame | None = None
) -> tuple[DataFrame, int]:
    """(i, value) solving A x = b for a symmetric A, and the rounds taken until the residual is below tolerance times b.

    singular: constants are A's null space; the mean of b is taken off, and the solution's mean is 0. An unknown that only
    one of A and b has gets a row as well: without entries of A its value is b, without b its right side is 0.
    places (i, x, y, z): where the unknowns of a mesh lie. They are then solved for by nested dissection (dissection.py), each
    solve a round, and cycles are left to systems whose residual stays above 1e-8 of b.
    """
    a = checkpointed(_summed(a))
    start = b.groupBy("i").agg(F.sum("value").alias("value")).join(a.select("i").distinct().withColumn("known", F.lit(True)), "i", "full")
    start = start.select("i", F.coalesce("value", F.lit(0.0)).alias("r"), F.col("known").isNotNull().alias("known"))
    a = a.unionByName(start.filter("NOT known").select("i", F.col("i").alias("j"), F.lit(1.0).alias("value")))
    start = checkpointed(start)
    mean = (start.agg(F.avg("r")).first()[0] or 0.0) if singular else 0.0
    if places is not None:
        a = checkpointed(a)
        x, taken, done = _refined(a, start.select("i", (F.col("r") - mean).alias("value")), places, tolerance, singular)
        if done:
            off = (x.agg(F.avg("value")).first()[0] or 0.0) if singular else 0.0
            return x.select("i", (F.col("value") - off).alias("value")), taken
    of = levels(a.join(start.filter("known"), "i", "left_semi"), dense)
    rounds = Rounds(a.sparkSession)
    state = start.select("i", F.lit(0.0).alias("x"), (F.col("r") - mean).alias("r"), F.lit(0.0).alias("p"))

    def total(df: DataFrame, *what: Column) -> list[float]:
        return [t or 0.0 for t in df.agg(*[F.sum(w) for w in what]).first()]

    def preconditioned(state: DataFrame) -> DataFrame:
        z = cycle(of, state.select("i", F.col("r").alias("value"))).select("i", F.col("value").alias("z"))
        return rounds.next(state.join(z, "i", "left").withColumn("z", F.coalesce("z", "r")))

    state = preconditioned(state)
    size, rho = total(state, F.col("r") * F.col("r"), F.col("r") * F.col("z"))
    goal, beta, taken = tolerance * size**0.5, 0.0, 0
    while taken < most and size**0.5 > goal and rho > 0:
        ahead = state.select("i", "x", "r", (F.col("z") + beta * F.col("p")).alias("p"))
        q = spmv(a, ahead.select("i", F.col("p").alias("value"))).select("i", F.col("value").alias("q"))
        ahead = rounds.next(ahead.join(q, "i", "left").fillna(0.0, ["q"]))
        bend = total(ahead, F.col("p") * F.col("q"))[0]
        if bend <= 0:
            state = ahead
            break
        alpha = rho / bend
        state = preconditioned(ahead.select("i", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p"))
        size, fresh = total(state, F.col("r") * F.col("r"), F.col("r") * F.col("z"))
        beta, rho, taken = fresh / rho, fresh, taken + 1
    off = (state.agg(F.avg("x")).first()[0] or 0.0) if singular else 0.0
    return state.select("i", (F.col("x") - off).alias("value")), taken
