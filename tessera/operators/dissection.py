"""Direct solves of sparse symmetric systems over places by nested dissection.

The places are cut into boxes of even counts, four to a box of the level above. Where an entry joins two boxes, the
unknown of the greater one stands between them: it belongs to the lowest box that holds both. From the leaves up every
box is one row of a group: it adds up its entries and what its four parts leave, solves for its own unknowns and hands on
what they do to the rest. From the top down the solutions are put in again. So a solve is a job a level each way, whatever
the condition of the matrix. On meshes of surfaces a box has about as many unknowns as its outline is long: the largest
dense matrix has some multiple of the root of all unknowns on a side. Matrices that join everything with everything
are one dense box, for which this is not made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import checkpointed, numbered

LEAF = 400
_OWN = "level int, box long, gone array<long>, value array<double>, i array<long>, j array<long>, w array<double>"
_FRONT = "box long, up long, gone array<long>, rest array<long>, x binary, y array<double>, schur binary, right array<double>"
_FOUND = "box long, i array<long>, value array<double>"


def boxes(places: DataFrame, depth: int, total: int) -> DataFrame:
    """i, code of places (i, x, y, z; null ones are first): 2^depth strips along x, each cut to as many cells along y, all of even counts.

    Two bits of the code tell the quarter at each level, the highest first. Ties go by the other coordinates and the id.
    """
    w = 1 << depth
    if not depth:
        return places.select("i", F.lit(0).cast("long").alias("code"))
    strip = F.floor(F.col("n") * w / F.lit(total)).cast("long")
    first = numbered(places.select("i", "x", "y", "z"), ["x", "y", "z", "i"], "n").select("i", "x", "y", "z", F.least(strip, F.lit(w - 1)).alias("strip"))
    second = checkpointed(numbered(first, ["strip", "y", "x", "z", "i"], "n"))
    held = second.groupBy("strip").agg(F.min("n").alias("from"), F.count("*").alias("held"))  # 2^depth rows
    cell = F.floor((F.col("n") - F.col("from")) * w / F.col("held")).cast("long")
    bit = lambda c, k: F.shiftright(c, k).bitwiseAND(F.lit(1))
    code = F.lit(0).cast("long")
    for k in range(depth):
        code = code + F.shiftleft(bit(F.col("strip"), k), 2 * k + 1) + F.shiftleft(bit(F.col("cell"), k), 2 * k)
    return second.join(F.broadcast(held), "strip").select("i", "strip", cell.alias("cell")).select("i", code.alias("code"))


def _array(kind: str, x: list) -> pa.Array:
    return pa.array(x, pa.list_(pa.int64() if kind == "long" else pa.float64()))


def _eliminated(own: pa.Table, parts: pa.Table) -> tuple[np.ndarray, ...]:
    """Names of the box's own unknowns and of the rest, and the dense matrix and right side over both."""
    column = lambda c: np.concatenate([np.asarray(v.values) for v in own[c]]) if own.num_rows else np.empty(0, np.int64 if c in "gone i j" else float)
    gone, value, i, j, w = (column(c) for c in ("gone", "value", "i", "j", "w"))
    order = np.argsort(gone)
    gone, value = gone[order], value[order]
    left = [np.asarray(r.values) for r in parts["rest"]] if parts.num_rows else []
    names = np.unique(np.concatenate([i, j, *left]).astype(np.int64))
    rest = names[~np.isin(names, gone)]
    every = np.concatenate([gone, rest])
    sorted_at = np.argsort(every)
    at = lambda x: sorted_at[np.searchsorted(every, x, sorter=sorted_at)]
    a, b = np.zeros((len(every), len(every))), np.zeros(len(every))
    np.add.at(a, (at(i), at(j)), w)
    b[: len(gone)] = value
    for k, names in enumerate(left):
        here = at(names)
        a[np.ix_(here, here)] += np.frombuffer(parts["schur"][k].as_buffer()).reshape(len(names), len(names))
        b[here] += np.asarray(parts["right"][k].values)
    return gone, rest, a, b


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a, hermitian=True) @ b


def _front(own: pa.Table, parts: pa.Table) -> pa.Table:
    return _handed_on(own, parts, True)


def _leaf_front(own: pa.Table, parts: pa.Table) -> pa.Table:
    """Without what is kept for the way down: there it is done again, from the leaf's few entries."""
    return _handed_on(own, parts, False)


def _handed_on(own: pa.Table, parts: pa.Table, keep: bool) -> pa.Table:
    gone, rest, a, b = _eliminated(own, parts)
    n = len(gone)
    both = _solved(a[:n, :n], np.column_stack([a[:n, n:], b[:n]])) if n else np.empty((0, len(rest) + 1))
    x, y = both[:, :-1], both[:, -1]
    schur, right = a[n:, n:] - a[n:, :n] @ x, b[n:] - a[n:, :n] @ y
    box = (own if own.num_rows else parts)["box"][0].as_py()
    held = (gone, rest, x.tobytes(), y) if keep else ([], rest, b"", [])
    rows = [pa.array([box]), pa.array([box >> 2]), _array("long", [held[0]]), _array("long", [held[1]]), pa.array([held[2]], pa.binary())]
    rows += [_array("double", [held[3]]), pa.array([schur.tobytes()], pa.binary()), _array("double", [right])]
    return pa.Table.from_arrays(rows, names=["box", "up", "gone", "rest", "x", "y", "schur", "right"])


def _found(boxes: list[int], names: list[np.ndarray], values: list[np.ndarray]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(boxes, pa.int64()), _array("long", names), _array("double", values)], names=["box", "i", "value"])


def _lookup(above: pa.Table, rest: np.ndarray) -> np.ndarray:
    names, values = np.asarray(above["i"][0].values), np.asarray(above["value"][0].values)
    order = np.argsort(names)
    return values[order[np.searchsorted(names, rest, sorter=order)]]


def _downward(above: pa.Table, fronts: pa.Table) -> pa.Table:
    """The solution in the boxes below one, over their own unknowns and the rest."""
    out: tuple[list, list, list] = ([], [], [])
    for k in range(fronts.num_rows):
        gone, rest, y = (np.asarray(fronts[c][k].values) for c in ("gone", "rest", "y"))
        known = _lookup(above, rest) if len(rest) else np.empty(0)
        x = np.frombuffer(fronts["x"][k].as_buffer()).reshape(len(gone), len(rest))
        for into, what in zip(out, (fronts["box"][k].as_py(), np.concatenate([gone, rest]), np.concatenate([y - x @ known, known])), strict=True):
            into.append(what)
    return _found(*out)


def _leaves(above: pa.Table, own: pa.Table) -> pa.Table:
    """The same for leaves, by their entries."""
    out: tuple[list, list, list] = ([], [], [])
    for k in range(own.num_rows):
        one = own.slice(k, 1)
        gone, rest, a, b = _eliminated(one, one.slice(1))
        n = len(gone)
        known = _lookup(above, rest) if len(rest) else np.empty(0)
        for into, what in zip(out, (one["box"][0].as_py(), gone, _solved(a[:n, :n], b[:n] - a[:n, n:] @ known)), strict=True):
            into.append(what)
    return _found(*out)


def solve(a: DataFrame, b: DataFrame, places: DataFrame, leaf: int = LEAF) -> DataFrame:
    """i, value solving A x = b for a symmetric A (i, j, value; an entry once) without a null space; every unknown has a row in b.

    places (i, x, y, z): unknowns without one are dealt to boxes by their ids. Nothing passes through the driver.
    """
    total, depth = b.count(), 0
    while total > leaf << 2 * depth:
        depth += 1
    known = b.join(places.select("i", "x", "y", "z").dropDuplicates(["i"]), "i", "left")
    code = checkpointed(boxes(known, depth, total))
    ends = a.join(code, "i").join(code.select(F.col("i").alias("j"), F.col("code").alias("cj")), "j")
    # Boxes that two codes share: as many as pairs of bits agree from the top.
    apart = F.col("code").bitwiseXOR(F.col("cj"))
    shared = F.when(apart == 0, depth).otherwise(depth - F.ceil(F.length(F.bin(apart)) / 2)).cast("int")
    level = code.join(ends.filter("code > cj").groupBy("i").agg(F.min(shared).alias("level")), "i", "left")
    level = checkpointed(level.select("i", "code", F.coalesce("level", F.lit(depth)).alias("level")))
    box = lambda c, at: F.expr(f"shiftright({c}, 2 * ({depth} - {at}))")
    unknown = level.join(b, "i").select("level", box("code", "level").alias("box"), F.struct("i", "value").alias("u"))
    unknown = unknown.groupBy("level", "box").agg(F.collect_list("u").alias("u"))
    entry = a.join(level, "i").join(level.select(F.col("i").alias("j"), F.col("code").alias("cj"), F.col("level").alias("lj")), "j")
    first = F.when(F.col("level") >= F.col("lj"), F.struct(box("code", "level").alias("box"), "level")).otherwise(F.struct(box("cj", "lj").alias("box"), F.col("lj").alias("level")))
    entry = entry.select(first.alias("f"), F.struct("i", "j", "value").alias("e")).groupBy("f.level", "f.box").agg(F.collect_list("e").alias("e"))
    nothing = lambda c, t: F.coalesce(c, F.expr(f"CAST(array() AS {t})"))
    own = unknown.join(entry, ["level", "box"], "full").select(
        "level", "box", *[nothing(c, t).alias(n) for c, t, n in (("u.i", "array<long>", "gone"), ("u.value", "array<double>", "value"), ("e.i", "array<long>", "i"), ("e.j", "array<long>", "j"), ("e.value", "array<double>", "w"))]
    )
    own = checkpointed(own)
    spark = a.sparkSession
    at = lambda k: own.filter(F.col("level") == k).drop("level")
    none = spark.createDataFrame([], _FRONT)
    fronts: dict[int, DataFrame] = {}
    for k in range(depth, -1, -1):
        parts = fronts[k + 1].select(F.col("up").alias("box"), "rest", "schur", "right") if k < depth else none.select("box", "rest", "schur", "right")
        front = _front if k < depth or not depth else _leaf_front
        fronts[k] = checkpointed(at(k).groupBy("box").cogroup(parts.groupBy("box")).applyInArrow(front, _FRONT))
    top = fronts[0].select("box", F.col("gone").alias("i"), F.col("y").alias("value"))
    out, above = top, top
    for k in range(1, depth + 1):
        by = above.groupBy("box")
        if k < depth:
            above = checkpointed(by.cogroup(fronts[k].groupBy("up")).applyInArrow(_downward, _FOUND))
            own_part = above.join(fronts[k].select("box", F.size("gone").alias("n")), "box").select("box", F.expr("slice(i, 1, n)").alias("i"), F.expr("slice(value, 1, n)").alias("value"))
        else:
            own_part = by.cogroup(at(k).withColumn("up", F.shiftright("box", 2)).groupBy("up")).applyInArrow(_leaves, _FOUND)
        out = out.unionByName(own_part)
    return out.select(F.explode(F.arrays_zip("i", "value")).alias("s")).select("s.i", "s.value")
