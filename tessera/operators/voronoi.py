"""Voronoi and power diagrams on the unit sphere and on the square.

Neighbours come from a spatial tree: a leaf's sites meet those of all leaves around
it in one row, so that sites of a leaf share their neighbours. A cell is a cyclic list of
planes; the bisectors of the neighbours cut it, nearest first. All cells of some
leaves are cut together: the loop runs over neighbour ranks, not over
sites, on padded arrays. A cell is finished once no farther neighbour can reach
it (the security radius). The first round meets the leaves that hold a number of nearest
sites; a leaf with cells that are not finished then meets all leaves that can reach
these by their distance and greatest weight, or those of twice the distance while
a cell is still wide.

Sites: id, x, y, z (z = 0 on the square) and, for a power diagram, w.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import trees
from tessera.operators.ordering import checkpointed, numbered

#: Half-width, on the plane that touches the sphere at a site, of the square that its cell is cut from: all but half a sphere.
START = 1000.0
NEIGHBOURS = 24
#: Fixed value: slack of the security radius, as a share of its square.
SLACK = 1.0025
#: Leaves times the most neighbours of one that are cut together at most.
TOGETHER = 20_000


@dataclass
class Domain:
    """The unit sphere, or the rectangle [x0, x1] x [y0, y1] in the plane z = 0."""

    sphere: bool = True
    low: tuple[float, float] = (0.0, 0.0)
    high: tuple[float, float] = (1.0, 1.0)

    @property
    def area(self) -> float:
        return 4 * np.pi if self.sphere else (self.high[0] - self.low[0]) * (self.high[1] - self.low[1])


def _meet(p: np.ndarray, q: np.ndarray, site: np.ndarray, sphere: bool, bent: bool = False) -> np.ndarray:
    """Where two planes (n, 4) meet the domain, nearest to the site; bent: on the sphere where p's circle, followed with the cell to its left, leaves the side of q."""
    if not sphere:
        det = p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]
        det = np.where(np.abs(det) < 1e-300, 1e-300, det)
        return np.column_stack([(p[:, 1] * q[:, 3] - q[:, 1] * p[:, 3]) / det, (q[:, 0] * p[:, 3] - p[:, 0] * q[:, 3]) / det, np.zeros(len(p))])
    n, m, a, b = p[:, :3], q[:, :3], -p[:, 3:], -q[:, 3:]
    d = np.cross(n, m)
    d2 = np.maximum((d * d).sum(axis=1, keepdims=True), 1e-300)
    base = (a * np.cross(m, d) + b * np.cross(d, n)) / d2
    room = np.maximum(1 - (base * base).sum(axis=1, keepdims=True), 0.0)
    step = np.sqrt(room / d2) * d
    one, two = base + step, base - step
    nearer = ((one - site) ** 2).sum(axis=1) <= ((two - site) ** 2).sum(axis=1)
    return np.where((nearer | bent)[:, None], one, two)


def _vertices(planes: np.ndarray, count: np.ndarray, site: np.ndarray, sphere: bool, bent: bool = False) -> np.ndarray:
    """Vertex k of each cell: planes k and k + 1."""
    n, most = planes.shape[:2]
    k = np.arange(most)
    after = np.where(k + 1 < count[:, None], k + 1, 0)
    second = np.take_along_axis(planes, after[:, :, None], axis=1)
    at = _meet(planes.reshape(-1, 4), second.reshape(-1, 4), np.repeat(site, most, axis=0), sphere, bent)
    return at.reshape(n, most, 3)


def secure(reach: np.ndarray, more: np.ndarray) -> np.ndarray:
    """How far sites that cut a cell can be, with its farthest corner's squared distance and how much more they weigh than its site."""
    return np.sqrt(reach) + np.sqrt(np.maximum(reach + more, 0.0))


def clip(site: np.ndarray, weight: np.ndarray, near: np.ndarray, near_weight: np.ndarray, there: np.ndarray, domain: Domain, bent: bool = False) -> dict[str, np.ndarray]:
    """Cells of n sites (n, 3) cut by their neighbours (n, k, 3), nearest first; there: which exist.

    bent: for weights so strong that edges bend on the sphere and a site can lie outside its cell. Sites must be apart.

    Gives planes (n, m, 4), origin (n, m): the neighbour's rank or -1 for the
    start, count, vertices and done.
    """
    n = len(site)
    most = 8
    planes = np.zeros((n, most, 4))
    origin = np.full((n, most), -1)
    if domain.sphere:
        t = np.column_stack([-site[:, 1], site[:, 0], np.zeros(n)])
        size = np.linalg.norm(t, axis=1)
        t = np.where(size[:, None] > 1e-12, t / np.maximum(size, 1e-12)[:, None], [1.0, 0.0, 0.0])
        u = np.cross(t, site)
        for k, d in enumerate((u, t, -u, -t)):
            planes[:, k, :3] = (START * site - d) / np.hypot(START, 1)
    else:
        (x0, y0), (x1, y1) = domain.low, domain.high
        planes[:, 0] = (0, 1, 0, -y0)
        planes[:, 1] = (-1, 0, 0, x1)
        planes[:, 2] = (0, -1, 0, y1)
        planes[:, 3] = (1, 0, 0, -x0)
    count = np.full(n, 4)
    points = _vertices(planes, count, site, domain.sphere, bent)
    done = np.zeros(n, dtype=bool)
    # A site at distance d reaches a point at distance r only where d (d - 2 r) is at most its weight less the cell's.
    more = np.where(there, near_weight, -np.inf).max(axis=1, initial=-np.inf) - weight
    # A bent cut that no corner survives may keep some of a wide cell, so it waits for the others.
    waiting = np.zeros(there.shape, dtype=bool)
    for rank in [*range(near.shape[1]), *range(-near.shape[1], 0)]:
        late, rank = rank < 0, rank % near.shape[1]
        if late and not waiting[:, rank].any():
            continue
        zj = near[:, rank]
        d = np.linalg.norm(zj - site, axis=1)
        slots = np.arange(planes.shape[1]) < count[:, None]
        if late:
            live = np.flatnonzero(waiting[:, rank] & (count > 0))
        else:
            reach = np.where(slots, ((points - site[:, None]) ** 2).sum(axis=2), 0).max(axis=1)
            done |= there[:, rank] & (SLACK * secure(reach, more) ** 2 < d * d) | (count == 0)
            live = np.flatnonzero(~done & there[:, rank])
        if not len(live):
            continue
        normal = (site[live] - zj[live]) / d[live, None]
        at = (d[live] ** 2 + weight[live] - near_weight[live, rank]) / (2 * d[live])
        cut = np.column_stack([normal, -((site[live] - at[:, None] * normal) * normal).sum(axis=1)])
        side = (points[live] @ cut[:, :3, None])[:, :, 0] + cut[:, 3:] >= 0
        some = slots[live]
        hit = (~side & some).any(axis=1)
        if bent and domain.sphere and not late:
            gone = ~(side & some).any(axis=1)
            waiting[live[gone], rank] = True
            hit &= ~gone
        live, cut, side, some = live[hit], cut[hit], side[hit], some[hit]
        if not len(live):
            continue
        k = np.arange(planes.shape[1])
        before = np.where(k > 0, k - 1, count[live][:, None] - 1)
        prior = np.take_along_axis(side, before, axis=1)
        keep = some & (prior | side)
        turn = some & prior & ~side
        emit = np.stack([keep, turn], axis=2).reshape(len(live), -1)
        size = emit.sum(axis=1)
        width = max(int(size.max(initial=0)), 1)
        if width > planes.shape[1]:
            room = width - planes.shape[1] + 4
            planes = np.concatenate([planes, np.zeros((n, room, 4))], axis=1)
            origin = np.concatenate([origin, np.full((n, room), -1)], axis=1)
            points = np.concatenate([points, np.zeros((n, room, 3))], axis=1)
        old = np.stack([planes[live][:, : side.shape[1]], np.repeat(cut[:, None], side.shape[1], axis=1)], axis=2).reshape(len(live), -1, 4)
        old_origin = np.stack([origin[live][:, : side.shape[1]], np.full(side.shape, rank)], axis=2).reshape(len(live), -1)
        order = np.argsort(~emit, axis=1, kind="stable")[:, :width]
        fresh = np.zeros((len(live), planes.shape[1], 4))
        fresh[:, :width] = np.take_along_axis(old, order[:, :, None], axis=1)
        fresh_origin = np.full((len(live), planes.shape[1]), -1)
        fresh_origin[:, :width] = np.take_along_axis(old_origin, order, axis=1)
        size = np.where(size >= 3, size, 0)
        planes[live], origin[live], count[live] = fresh, fresh_origin, size
        points[live] = _vertices(fresh, np.maximum(size, 1), site[live], domain.sphere, bent)
    return {"planes": planes, "origin": origin, "count": count, "points": points, "done": done}


def measures(points: np.ndarray, count: np.ndarray, sphere: bool) -> tuple[np.ndarray, np.ndarray]:
    """Volume and moment of cells given by their padded vertices."""
    n, most = points.shape[:2]
    volume, moment = np.zeros(n), np.zeros((n, 3))
    a = points[:, 0]
    for k in range(1, most - 1):
        on = k + 1 < count
        b, c = points[:, k], points[:, k + 1]
        if sphere:
            up = (a * np.cross(b, c)).sum(axis=1)
            part = 2 * np.arctan2(np.abs(up), 1 + (a * b).sum(axis=1) + (b * c).sum(axis=1) + (a * c).sum(axis=1))
        else:
            part = 0.5 * np.linalg.norm(np.cross(b - a, c - a), axis=1)
            moment += np.where(on, part, 0)[:, None] * (a + b + c) / 3
        volume += np.where(on, part, 0)
    if sphere:
        for k in range(most):
            on = k < count
            p, q = points[:, k], points[np.arange(n), np.where(k + 1 < count, k + 1, 0)]
            normal = np.cross(p, q)
            size = np.linalg.norm(normal, axis=1)
            angle = 2 * np.arctan2(np.linalg.norm(p - q, axis=1), np.linalg.norm(p + q, axis=1))
            moment += np.where(on & (size > 1e-15), 0.5 * angle / np.maximum(size, 1e-300), 0)[:, None] * normal
    return volume, moment


_CELL = "id long, x double, y double, z double, w double, volume double, mx double, my double, mz double, done boolean, neighbours array<long>, points array<struct<x:double,y:double,z:double>>"
_CUT = f"{_CELL}, a string, reach double, upto double"


def diagram(sites: DataFrame, domain: Domain = Domain(), neighbours: int = NEIGHBOURS, bent: bool = False) -> DataFrame:
    """One row per site: volume, moment, done, and for each edge of the cell its neighbour (null: the domain's
    boundary) and its end point, in order.

    Of sites in one place the one of greatest weight, then of least id, has the cell. The others, and sites with a null
    or non-finite number, have empty cells of volume 0. On the sphere a cell is less than half of it, so sites
    that all lie in one half leave a part of the other half to no cell. bent: as in clip; ids are distinct then.
    """
    axes = ("x", "y", "z") if domain.sphere else ("x", "y")
    base = sites.select("id", "x", "y", (F.col("z") if "z" in sites.columns else F.lit(0.0)).alias("z"), (F.col("w") if "w" in sites.columns else F.lit(0.0)).alias("w"))
    every = checkpointed(base)
    finite = F.lit(True)
    for c in "xyzw":
        finite = finite & F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    held = every.filter(finite).groupBy(*axes).agg(F.max_by("id", F.struct("w", -F.col("id"))).alias("id")).select("id")
    base = checkpointed(every.join(held, "id", "left_semi"))
    empty = {"neighbours": "array<long>", "points": "array<struct<x:double,y:double,z:double>>"}
    parts = every.join(base.select("id"), "id", "left_anti").select(
        "id", "x", "y", "z", "w", *[F.lit(0.0).alias(c) for c in ("volume", "mx", "my", "mz")], F.lit(True).alias("done"), *[F.array().cast(t).alias(c) for c, t in empty.items()]
    )
    highest = base.agg(F.max("w")).first()[0]
    if highest is None:
        return parts
    tree = trees.build(base, axes, bounds=("w",))
    box = [f"{e}_{a}" for a in axes for e in ("lo", "hi")]
    leaves = tree.leaves.select(F.col("path").alias("a"), *[F.col(c).alias(f"a_{c}") for c in box])
    pairs = trees.leaf_pairs(tree, tree, neighbours + 1).select("a", "b", F.sqrt("reach").alias("upto"))
    asked = tree.held.select(F.col("leaf").alias("a"), F.transform("held", lambda s: s["id"]).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column("near")))
            start = 0
            while start < batch.num_rows:
                widest = np.maximum.accumulate(sizes[start:])
                upto = max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1), TOGETHER)))
                yield _cut(batch.slice(start, upto), highest, domain, bent)
                start += upto

    while True:
        around = pairs.join(tree.held.withColumnRenamed("leaf", "b"), "b").groupBy("a").agg(F.first("upto").alias("upto"), F.flatten(F.collect_list("held")).alias("near"))
        rows = asked.join(tree.held.select(F.col("leaf").alias("a"), "held"), "a").join(around, "a")
        cells = checkpointed(rows.select("a", "upto", "asked", "held", "near").mapInArrow(run, _CUT))
        parts = parts.unionByName(cells.filter("done").select(parts.columns))
        todo = cells.filter("NOT done").groupBy("a")
        todo = checkpointed(todo.agg(F.max("reach").alias("reach"), F.min("w").alias("least"), F.max("upto").alias("upto"), F.collect_list("id").alias("asked")))
        if todo.isEmpty():
            return parts
        # Twice as far while cells are wide, else as far as any site can be that cuts one.
        asked, r = todo.select("a", "asked"), F.col("reach")
        wide = leaves.join(todo.select("a", "reach", "least", F.when(r <= 2 * F.col("upto"), float("inf")).otherwise(2 * F.col("upto")).alias("upto")), "a")
        can = r + F.sqrt(F.greatest(r * r + F.col("hi_w") - F.col("least"), F.lit(0.0)))
        pairs = trees.leaves_met(wide, tree, (F.col("near") <= F.col("upto") * F.col("upto")) & (F.col("near") <= SLACK * can * can)).select("a", "b", "upto")


def _sites(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, id, place and weight of every site in lists of them."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    each = lists.flatten()
    number = lambda c: np.asarray(each.field(c), dtype=float)
    return np.repeat(np.arange(len(lists)), sizes), np.asarray(each.field("id")), np.column_stack([number(c) for c in "xyz"]), number("w")


def _cut(part: pa.RecordBatch, highest: float, domain: Domain, bent: bool = False) -> pa.RecordBatch:
    """Cells of the asked sites of leaves with their own sites (held) and those of the leaves around them (near)."""
    column = {name: part.column(k) for k, name in enumerate(part.schema.names)}
    leaf, own, site, weight = _sites(column["held"])
    at = np.isin(own, np.asarray(column["asked"].flatten()))
    leaf, own, site, weight = leaf[at], own[at], site[at], weight[at]
    n = len(own)
    row, ids, place, w = _sites(column["near"])
    first = np.searchsorted(row, np.arange(part.num_rows + 1))
    size = np.diff(first)[leaf]
    width = max(int(size.max(initial=0)), 1)
    slot = np.arange(width)
    there = slot < size[:, None]
    each = np.where(there, first[leaf][:, None] + slot, 0)
    there &= ids[each] != own[:, None]
    gap = np.where(there, sum((place[each, k] - site[:, None, k]) ** 2 for k in range(3)), np.inf)
    ranked = np.lexsort((ids[each], gap), axis=1)
    each, there = np.take_along_axis(each, ranked, axis=1), np.take_along_axis(there, ranked, axis=1)
    got = clip(site, weight, place[each], w[each], there, domain, bent)
    volume, moment = measures(got["points"], got["count"], domain.sphere)
    some = np.arange(got["origin"].shape[1]) < got["count"][:, None]
    reach = np.where(some, ((got["points"] - site[:, None]) ** 2).sum(axis=2), 0).max(axis=1)
    upto = np.asarray(column["upto"], dtype=float)[leaf]
    done = (SLACK * secure(reach, highest - weight) ** 2 <= upto * upto) | (got["count"] == 0)
    offsets = pa.array(np.concatenate([[0], np.cumsum(got["count"])]).astype(np.int32))
    origin, owner = got["origin"][some], np.nonzero(some)[0]
    names = pa.ListArray.from_arrays(offsets, pa.array(ids[each][owner, np.maximum(origin, 0)], mask=origin < 0))
    corner = got["points"][some]
    points = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(corner[:, k])) for k in range(3)], names=["x", "y", "z"]))
    numbers = [pa.array(np.ascontiguousarray(c)) for c in (*site.T, weight, volume, *moment.T)]
    arrays = [pa.array(own), *numbers, pa.array(done), names, points, column["a"].take(pa.array(leaf)), pa.array(np.sqrt(reach)), pa.array(upto)]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "x", "y", "z", "w", "volume", "mx", "my", "mz", "done", "neighbours", "points", "a", "reach", "upto"])


def edges(cells: DataFrame) -> DataFrame:
    """bi, bj, p, q of every edge of every cell (each inner facet twice)."""
    n = F.size("points")
    each = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.struct(F.get("neighbours", k).alias("bj"), F.get("points", (k + n - 1) % n).alias("p"), F.get("points", k).alias("q")),
    )
    return cells.filter(n >= 3).select(F.col("id").alias("bi"), F.explode(each).alias("e")).select("bi", "e.*")


def facets(cells: DataFrame, domain: Domain = Domain()) -> DataFrame:
    """bi, bj, length, mx, my, mz; inner facets once, with bi < bj, boundary facets with a null bj and length 0."""
    e = edges(cells).filter("bj IS NULL OR bi < bj")
    p, q = v.vec("p.x", "p.y", "p.z"), v.vec("q.x", "q.y", "q.z")
    middle = v.scale(v.add(p, q), 0.5)
    middle = v.unit(middle) if domain.sphere else middle
    size = v.arc(p, q) if domain.sphere else v.length(v.sub(p, q))
    return e.select("bi", "bj", F.when(F.col("bj").isNull(), 0.0).otherwise(size).alias("length"), *[c.alias(f"m{k}") for c, k in zip(middle, "xyz", strict=True)])


def delaunay(cells: DataFrame) -> DataFrame:
    """i < j < k of every vertex where three cells meet, once."""
    n = F.size("neighbours")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_sort(F.array("id", F.get("neighbours", k), F.get("neighbours", (k + 1) % n))))
    triples = cells.filter(n >= 3).select(F.explode(each).alias("t")).filter(~F.exists("t", lambda x: x.isNull())).distinct()
    return triples.select(F.get("t", F.lit(0)).alias("i"), F.get("t", F.lit(1)).alias("j"), F.get("t", F.lit(2)).alias("k"))


def centroids(cells: DataFrame, domain: Domain = Domain()) -> DataFrame:
    """id, x, y, z of the cells' centroids, on the sphere again; sites of empty cells stay."""
    c = tuple(F.col(f"m{k}") / F.col("volume") for k in "xyz")
    c = v.unit(c) if domain.sphere else c
    return cells.select("id", *[F.when(F.col("volume") > 0, p).otherwise(F.col(k)).alias(k) for p, k in zip(c, "xyz", strict=True)])


def lloyd(sites: DataFrame, rounds: int, domain: Domain = Domain()) -> DataFrame:
    """Sites after so many moves to their centroids."""
    for _ in range(rounds):
        sites = centroids(diagram(sites, domain), domain)
    return sites


def shared_mesh(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The diagram as a mesh whose cells share vertices: (id, i, j, k, x, y, z) and polygons (id, vertices).

    Corners where the same three cells meet are one vertex, placed as the cell of least id has it; its cells are
    i < j < k. Corners on the domain's boundary belong to one cell each and stay apart, with null j and k.
    Vertices are numbered from 0 in the order of i, j, k and, on the boundary, their place in the cell.
    """
    n = F.size("points")
    corner = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.struct(k.alias("at"), F.array_sort(F.array("id", F.get("neighbours", k), F.get("neighbours", (k + 1) % n))).alias("key"), F.get("points", k).alias("p")),
    )
    each = cells.filter(n >= 3).select("id", F.explode(corner).alias("c")).select("id", "c.at", "c.key", "c.p")
    edge = F.exists("key", lambda c: c.isNull())
    each = each.select(
        "id", "at", "p", F.when(edge, F.col("id")).otherwise(F.get("key", F.lit(0))).alias("i"),
        *[F.when(~edge, F.get("key", F.lit(m))).alias(c) for m, c in ((1, "j"), (2, "k"))], F.when(edge, F.col("at")).otherwise(-1).alias("own"),
    )
    each = checkpointed(each.select("id", "at", "p", "i", F.coalesce("j", F.lit(-1)).alias("j"), F.coalesce("k", F.lit(-1)).alias("k"), "own"))
    merged = each.groupBy("i", "j", "k", "own").agg(F.min_by("p", F.struct("id", "at")).alias("p"))
    merged = checkpointed(numbered(merged, ["i", "j", "k", "own"], "vertex"))
    placed = each.join(merged.drop("p"), ["i", "j", "k", "own"])
    polygons = placed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "vertex"))), lambda s: s["vertex"]).alias("vertices"))
    inner = lambda c: F.when(F.col("own") < 0, F.col(c)).alias(c)
    return merged.select(F.col("vertex").alias("id"), "i", inner("j"), inner("k"), "p.x", "p.y", "p.z"), polygons


def statistics(cells: DataFrame) -> DataFrame:
    """cells, incomplete (their neighbours ran out), corners, area and radius (the farthest corner from its site) of a diagram, in one row."""
    away = lambda p: F.sqrt(sum(((p[c] - F.col(c)) * (p[c] - F.col(c)) for c in "xyz"), F.lit(0.0)))
    return cells.agg(
        F.count("*").alias("cells"),
        F.count_if(~F.col("done")).alias("incomplete"),
        F.sum(F.size("points").cast("long")).alias("corners"),
        F.sum("volume").alias("area"),
        F.max(F.array_max(F.transform("points", away))).alias("radius"),
    )


def averaged(history: DataFrame, columns: list[str]) -> DataFrame:
    """history (round, columns; one row a round) with mean_<column>: the average of all rounds so far."""
    so_far = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return history.select("*", *[F.avg(c).over(so_far).alias(f"mean_{c}") for c in columns])
