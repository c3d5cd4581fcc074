"""Spatial trees whose leaves hold a bounded number of points, and exact nearest neighbours between leaves.

A tree is a table of nodes: path (a digit a level), n, and the tight box of the node's points. Points get a
path of many levels at once, one count by path and one over its prefixes tell every node, and the shortest
prefixes with at most LEAF points are the leaves. Where even the full path has more points, its box, drawn tight around
them, is cut anew, so that clusters of any scale come apart: evenly spread points take one pass, each
further one sees heavy nodes only. A path's digits are octants (quadrants) of the box, or the nested
triangles of a sphere.

Neighbours are found by pairs of leaves. A leaf of queries starts with the root and goes down some levels a
round; a node is left once its box is farther than the k-th neighbour can be, which the boxes and counts of the
other nodes bound. Then queries meet the points of the leaves that remain, in one join whose keys have at most LEAF
points. Points in one place are one row with the k least of their ids, queries in one place are asked once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import checkpointed

#: Points of a leaf at most.
LEAF = 32
#: Levels of one pass over the points, and levels that a round of the search goes down.
LEVELS, HOP = 10, 2

# Corners of the octahedron and its faces, north before south, anticlockwise from outside.
OCTAHEDRON = np.array([[1, 0, 0], [0, 1, 0], [-1, 0, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]], dtype=float)
FACES = np.array([[0, 1, 4], [1, 2, 4], [2, 3, 4], [3, 0, 4], [1, 0, 5], [2, 1, 5], [3, 2, 5], [0, 3, 5]])
#: Fixed value: a point this far outside an edge (a determinant, of faces; of smaller triangles in proportion to their area) still counts as in the triangle.
EDGE = -1e-8


@dataclass
class Tree:
    """nodes: path, leaf, n, lo_<axis>, hi_<axis>; held: leaf (a path) and held, the array of its places (the axes and what is kept)."""

    nodes: DataFrame
    held: DataFrame
    axes: tuple[str, ...]
    passes: int
    depth: int

    @property
    def leaves(self) -> DataFrame:
        return self.nodes.filter("leaf")

    @property
    def places(self) -> DataFrame:
        return self.held.select("leaf", F.explode("held").alias("p")).select("leaf", "p.*")


def finite(df: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    for a in axes:
        df = df.filter(F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(F.col(a)) < float("inf")))
    return df


def children(corners: np.ndarray) -> np.ndarray:
    """The four nested triangles (n, 4, 3, 3) of spherical triangles (n, 3, 3): at each corner, then the middle one."""
    a, b, c = corners[:, 0], corners[:, 1], corners[:, 2]
    mid = [(p + q) / np.linalg.norm(p + q, axis=1, keepdims=True) for p, q in ((a, b), (b, c), (c, a))]
    rows = ((a, mid[0], mid[2]), (mid[0], b, mid[1]), (mid[2], mid[1], c), tuple(mid))
    return np.stack([np.stack(r, axis=1) for r in rows], axis=1)


def inside(corners: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For triangles (..., 3, 3) and points (..., 3) the least of the three determinants that are positive inside."""
    a, b, c = corners[..., 0, :], corners[..., 1, :], corners[..., 2, :]
    dets = [(np.cross(u, w) * p).sum(axis=-1) for u, w in ((a, b), (b, c), (c, a))]
    return np.minimum(np.minimum(dets[0], dets[1]), dets[2])


def descend(p: np.ndarray, depth: int) -> np.ndarray:
    """Digits (n, 1 + depth) of the nested triangles that hold points of the sphere: the face, then a child a level; ties go to the lowest."""
    out = np.zeros((len(p), 1 + depth), dtype=np.uint8)
    options = np.broadcast_to(OCTAHEDRON[FACES][None], (len(p), 8, 3, 3))
    options = np.where((p[:, 2] < 0)[:, None, None, None], options[:, 4:], options[:, :4])
    for level in range(1 + depth):
        held = inside(options, p[:, None, :])
        fine = held >= EDGE / 4**level
        chosen = np.where(fine.any(axis=1), fine.argmax(axis=1), held.argmax(axis=1))
        out[:, level] = chosen + (4 * (p[:, 2] < 0) if level == 0 else 0)
        if level < depth:
            options = children(options[np.arange(len(p)), chosen])
    return out


def triangle_paths(points: DataFrame, depth: int, name: str = "path") -> DataFrame:
    """points (x, y, z) with the path of digits of the nested triangles that hold them."""
    schema = points.select("*", F.lit("").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xyz = np.column_stack([np.asarray(batch.column(batch.schema.get_field_index(c)), dtype=float) for c in "xyz"]) if batch.num_rows else np.zeros((0, 3))
            digits = descend(xyz, depth) + ord("0")
            paths = pa.array([r.tobytes().decode() for r in digits], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, paths], names=[f.name for f in schema])

    return points.mapInArrow(run, schema)


#: Steps that put the bits of a number under 2^10 one, two or three places apart.
SPREAD = {1: (), 2: ((8, 0xFF00FF), (4, 0xF0F0F0F), (2, 0x33333333), (1, 0x55555555)), 3: ((16, 0x30000FF), (8, 0x300F00F), (4, 0x30C30C3), (2, 0x9249249))}


def box_digits(axes: tuple[str, ...]) -> Column:
    """LEVELS digits of the cells of the row's box (lo_, hi_ of its node) that hold it, halved on all axes a level."""
    side, key = 1 << LEVELS, F.lit(0).cast("long")
    for k, a in enumerate(axes):
        lo, hi, c = F.col(f"lo_{a}"), F.col(f"hi_{a}"), F.col(a)
        # Halves first: the width of a box may be beyond a double.
        share = F.when(hi > lo, (c / 2 - lo / 2) / (hi / 2 - lo / 2)).otherwise(0.0)
        bits = F.least(F.floor(F.least(share, F.lit(1.0)) * side), F.lit(side - 1)).cast("long")
        for shift, mask in SPREAD[len(axes)]:
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask).cast("long"))
        key = key.bitwiseOR(F.shiftleft(bits, k))
    return F.lpad(F.conv(key.cast("string"), 10, 1 << len(axes)), LEVELS, "0")


def build(places: DataFrame, axes: tuple[str, ...], weight: str | None = None, leaf: int = LEAF, sphere: bool = False, bounds: tuple[str, ...] = ()) -> Tree:
    """A tree over different, finite places (the axes and what else is kept); weight: a column to sum in n in place of counting.

    sphere: the first levels are nested triangles (axes x, y, z). A leaf has at most `leaf` places. bounds: kept columns
    whose least and greatest values nodes tell as they do of the axes.
    """
    kept = list(places.columns)
    ranged = (*axes, *bounds)
    low, high = [f"lo_{a}" for a in ranged], [f"hi_{a}" for a in ranged]
    boxes = [*[F.min(a).alias(f"lo_{a}") for a in ranged], *[F.max(a).alias(f"hi_{a}") for a in ranged]]
    merged = [F.sum("places").alias("places"), F.sum("n").alias("n"), *[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high]]
    counted = [F.count("*").alias("places"), (F.sum(weight) if weight else F.count("*")).cast("long").alias("n"), *boxes]
    root = places.agg(*counted).first()
    most, passes = root["places"], 0
    top = [("", most <= leaf, root["n"], *[root[c] for c in low + high])] if most else []
    nodes = places.sparkSession.createDataFrame(top, "path string, leaf boolean, n long, " + ", ".join(f"{c} double" for c in low + high))
    settled = places.select(*kept, F.lit("").alias("leaf")) if most <= leaf else None
    rows = places.withColumn("path", F.lit("")).withColumns({c: F.lit(root[c]).cast("double") for c in low + high}).withColumn("places", F.lit(most))
    while most > leaf:
        passes += 1
        # As many levels as bring the mean of a surface's cells down to a quarter of a leaf.
        levels = F.least(F.greatest(F.ceil(F.log2(F.col("places") * 4.0 / leaf) / 2), F.lit(1)), F.lit(LEVELS)).cast("int")
        if sphere and passes == 1:
            full = triangle_paths(rows, LEVELS, "full").withColumn("full", F.substring("full", F.lit(1), levels))
        else:
            full = rows.withColumn("full", F.concat("path", F.substring(box_digits(axes), F.lit(1), levels)))
        full = full.select(*kept, "path", "full")
        full = checkpointed(full) if sphere or passes > 1 else full
        cells = checkpointed(full.groupBy("full", "path").agg(*counted))
        above = F.transform(F.sequence(F.length("path") + 1, F.length("full")), lambda k: F.substring("full", F.lit(1), k))
        of_cell = cells.select("full", F.explode(above).alias("node"), "places", "n", *low, *high)
        found = checkpointed(of_cell.groupBy("node").agg(*merged))
        light = found.filter(F.col("places") <= leaf).select("node")
        ends = of_cell.select("full", "node").join(light, "node").groupBy("full").agg(F.min_by("node", F.length("node")).alias("leaf"))
        is_leaf = found.join(ends.select(F.col("leaf").alias("node")).distinct(), "node", "left_semi").withColumn("leaf", F.lit(True))
        inner = found.filter(F.col("places") > leaf).withColumn("leaf", F.lit(False))
        nodes = nodes.unionByName(is_leaf.unionByName(inner).select(F.col("node").alias("path"), "leaf", "n", *low, *high))
        done = full.join(ends, "full").select(*kept, "leaf")
        settled = done if settled is None else settled.unionByName(done)
        heavy = cells.filter(F.col("places") > leaf).select("full", "places", *low, *high)
        rows = full.drop("path").join(heavy, "full").withColumnRenamed("full", "path")
        most = cells.agg(F.max("places")).first()[0]
    nodes = checkpointed(nodes)
    held = checkpointed(settled.groupBy("leaf").agg(F.collect_list(F.struct(*kept)).alias("held")))
    return Tree(nodes, held, axes, passes, nodes.agg(F.max(F.length("path"))).first()[0] or 0)


def _apart(axes: tuple[str, ...], far: bool) -> Column:
    """Squared distance of two boxes (a_lo_, a_hi_; lo_, hi_): the least, or of the corners farthest apart."""
    total = F.lit(0.0)
    for a in axes:
        one, two = F.col(f"a_lo_{a}") - F.col(f"hi_{a}"), F.col(f"lo_{a}") - F.col(f"a_hi_{a}")
        gap = F.greatest(F.abs(one), F.abs(two)) if far else F.greatest(one, two, F.lit(0.0))
        total = total + gap * gap
    return total


def leaf_pairs(asking: Tree, tree: Tree, k: int, only: DataFrame | None = None) -> DataFrame:
    """a, b, reach: for each leaf a of the asking tree (of those in only) the leaves b that may hold one of the k nearest
    points of a query in it, with b's box; reach bounds the squared distance of these points."""
    axes = tree.axes
    box = [f"{e}_{a}" for a in axes for e in ("lo", "hi")]
    parent = F.substring("path", F.lit(1), (F.floor((F.length("path") - 1) / HOP) * HOP).cast("int"))
    # Nodes at every HOP-th level and leaves, below the node at the last such level above them.
    below = tree.nodes.filter((F.col("path") != "") & (F.col("leaf") | (F.length("path") % HOP == 0))).select(parent.alias("up"), F.col("path").alias("b"), "leaf", "n", *box)
    pairs = asking.leaves.select(F.col("path").alias("a"), *[F.col(c).alias(f"a_{c}") for c in box])
    if only is not None:
        pairs = pairs.join(only, "a", "left_semi")
    root = tree.nodes.filter("path = ''").select(F.col("path").alias("b"), "leaf", "n", *box)
    pairs = pairs.withColumns({c: F.lit(value).cast(root.schema[c].dataType) for c, value in root.first().asDict().items()})
    pairs = pairs.withColumn("reach", F.lit(float("inf")))
    nearest_first = Window.partitionBy("a").orderBy("far", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ["a", *[f"a_{c}" for c in box]]
    for _ in range(-(-tree.depth // HOP)):
        opened = pairs.filter("NOT leaf").select(*own, F.col("b").alias("up"), "reach").join(below, "up").select(*own, "b", "leaf", "n", *box, "reach")
        every = pairs.filter("leaf").select(*own, "b", "leaf", "n", *box, "reach").unionByName(opened)
        every = every.withColumn("near", _apart(axes, far=False)).withColumn("far", _apart(axes, far=True)).filter("near <= reach")
        every = every.withColumn("upto", F.sum("n").over(nearest_first))
        bound = F.min(F.when(F.col("upto") >= k, F.col("far"))).over(Window.partitionBy("a"))
        every = every.withColumn("reach", F.least("reach", F.coalesce(bound, F.lit(float("inf"))) * (1 + 1e-12)))
        pairs = checkpointed(every.filter(F.col("near") <= F.col("reach")).drop("near", "far", "upto"))
    return pairs.select("a", "b", "reach", *box)


def leaves_met(asking: DataFrame, tree: Tree, met: Column) -> DataFrame:
    """asking (with a box a_lo_<axis>, a_hi_<axis>) with b, each leaf of the tree that is met.

    met is told of a node's near (squared distance of the boxes) and bounds, and holds of all nodes above one of which it holds.
    """
    own = asking.columns
    box = [c for c in tree.nodes.columns if c.startswith(("lo_", "hi_"))]
    parent = F.substring("path", F.lit(1), (F.floor((F.length("path") - 1) / HOP) * HOP).cast("int"))
    below = tree.nodes.filter((F.col("path") != "") & (F.col("leaf") | (F.length("path") % HOP == 0))).select(parent.alias("up"), F.col("path").alias("b"), "leaf", *box)
    root = tree.nodes.filter("path = ''").select(F.col("path").alias("b"), "leaf", *box)
    pairs = asking.withColumns({c: F.lit(value).cast(root.schema[c].dataType) for c, value in root.first().asDict().items()})
    for _ in range(-(-tree.depth // HOP)):
        opened = pairs.filter("NOT leaf").select(*own, F.col("b").alias("up")).join(below, "up").select(*own, "b", "leaf", *box)
        every = pairs.filter("leaf").select(*own, "b", "leaf", *box).unionByName(opened)
        pairs = checkpointed(every.withColumn("near", _apart(tree.axes, far=False)).filter(met).drop("near"))
    return pairs.select(*own, "b")


class Index:
    """Points in a tree, for searches of nearest neighbours.

    Points with a null or non-finite coordinate are left out. copies: how many ids of a place are kept, the greatest k
    that is asked for. sphere: the tree's first levels are nested triangles, for axes x, y, z.
    """

    def __init__(self, points: DataFrame, axes: tuple[str, ...], copies: int, sphere: bool = False, leaf: int = LEAF):
        self.axes, self.sphere, self.leaf, self.copies = axes, sphere, leaf, copies
        self.points = finite(points.select("id", *[(F.col(a).cast("double") + 0.0).alias(a) for a in axes]), axes)
        places = checkpointed(self.points.groupBy(*axes).agg(F.min("id").alias("least"), F.count("*").alias("rows")))
        told = places.agg(F.max("rows"), F.sum(F.least("rows", F.lit(copies)))).first()
        self.most, self.total = told[0] or 0, told[1] or 0
        if self.most > 1:
            first = Window.partitionBy(*axes).orderBy("id")
            shared = self.points.join(places.filter("rows > 1").select(*axes), list(axes), "left_semi")
            some = shared.withColumn("_r_", F.row_number().over(first)).filter(F.col("_r_") <= copies)
            lists = some.groupBy(*axes).agg(F.array_sort(F.collect_list("id")).alias("ids"))
            places = checkpointed(places.join(lists, list(axes), "left").select(*axes, F.coalesce("ids", F.array("least")).alias("ids")))
        else:
            places = places.select(*axes, F.array("least").alias("ids"))
        self.tree = build(places.withColumn("_n_", F.size("ids").cast("long")), axes, "_n_", leaf, sphere)

    def nearest(self, k: int, queries: DataFrame | None = None, among: bool = False) -> DataFrame:
        """id, rank (from 0), neighbour, d2: the k nearest points of every query, ties by id.

        Without queries the points ask; among: the queries are some of the points. Queries with a null or non-finite coordinate
        have no rows, and without points there are none.
        """
        axes, tree = self.axes, self.tree
        own = queries is None or among
        asking, d2 = tree, lambda p: sum(((F.col(a) - p[a]) * (F.col(a) - p[a]) for a in axes), F.lit(0.0))
        if queries is not None:
            queries = finite(queries.select("id", *[(F.col(a).cast("double") + 0.0).alias(a) for a in axes]), axes)
        if not self.total:
            return self.points.select("id", F.lit(0).alias("rank"), F.col("id").alias("neighbour"), F.lit(0.0).alias("d2")).limit(0)
        if not own:
            queries = checkpointed(queries)
            asking = build(queries.select(*axes).distinct(), axes, None, self.leaf, self.sphere)
        asked = asking.held.select(F.col("leaf").alias("a"), "held", F.explode("held").alias("p"))
        asked = asked.select("a", "held", *[F.col(f"p.{a}").alias(a) for a in axes], (F.col("p.ids") if own else F.array().cast("array<long>")).alias("ids"))
        reach = F.col("reach")
        if own:  # the k-th nearest place of the own leaf bounds what other leaves can hold
            kth = F.get(F.array_sort(F.transform("held", d2)), F.lit(k - 1))
            asked = asked.withColumn("most", F.coalesce(kth, F.lit(float("inf"))))
            reach = F.least("reach", F.col("most") * (1 + 1e-12))
        asked = asked.drop("held")
        if among:
            asked = asked.join(queries.select(*axes), list(axes), "left_semi")
        pairs = leaf_pairs(asking, tree, min(k, self.total), asked.select("a").distinct() if among else None)
        near = F.lit(0.0)
        for a in axes:
            gap = F.greatest(F.col(f"lo_{a}") - F.col(a), F.col(a) - F.col(f"hi_{a}"), F.lit(0.0))
            near = near + gap * gap
        met = asked.join(pairs, "a").filter(near <= reach).select("b", *axes, "ids").join(tree.held.withColumnRenamed("leaf", "b"), "b")
        each = F.transform("held", lambda p: F.struct(d2(p).alias("d2"), F.get(p["ids"], F.lit(0)).alias("neighbour")))
        if self.most > 1:
            each = F.flatten(F.transform("held", lambda p: F.transform(p["ids"], lambda i: F.struct(d2(p).alias("d2"), i.alias("neighbour")))))
        some = met.select(*axes, "ids", F.slice(F.array_sort(each), 1, k).alias("best")).groupBy(*axes)
        some = some.agg(F.first("ids").alias("ids"), F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        if queries is None and self.most <= self.copies:
            told = some.select(F.explode("ids").alias("id"), "best")
        else:
            told = (self.points if queries is None else queries).join(some.drop("ids"), list(axes))
        return told.select("id", F.posexplode("best").alias("rank", "b")).select("id", "rank", "b.neighbour", "b.d2")


def nearest(queries: DataFrame, points: DataFrame, k: int, axes: tuple[str, ...], sphere: bool = False) -> DataFrame:
    """id, rank (from 0), neighbour, d2: the k nearest points of every query, ties by id; see Index."""
    return Index(points, axes, k, sphere).nearest(k, None if queries is points else queries)


def sphere_level(n: int, least: int = 10) -> int:
    """Levels of nested triangles that leave a triangle at least so many of n points on the average."""
    level = 0
    while n >= least * 8 * 4 ** (level + 1):
        level += 1
    return level


def points_per_triangle(points: DataFrame, level: int) -> DataFrame:
    """leaf, points: how many points each nested triangle of a level holds, those without any too; numbered by face, then child by child."""
    digits = triangle_paths(finite(points.select("x", "y", "z"), ("x", "y", "z")), level)
    number = F.conv(F.substring("path", 1, 1), 10, 10).cast("long") * 4**level + F.coalesce(F.conv(F.substring("path", 2, level), 4, 10).cast("long"), F.lit(0))
    held = digits.select(number.alias("leaf")).groupBy("leaf").agg(F.count("*").alias("points"))
    every = points.sparkSession.range(8 * 4**level).withColumnRenamed("id", "leaf")
    return every.join(held, "leaf", "left").select("leaf", F.coalesce("points", F.lit(0)).alias("points"))
