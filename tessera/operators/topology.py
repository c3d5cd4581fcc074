"""Mesh topology as joins and aggregations: edges, twins, boundaries, components, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators.graphs import components
from tessera.operators.ordering import Rounds, checkpointed, numbered

_CORNERS = ("v0", "v1", "v2", "v3")


def corners(elements: DataFrame) -> list[str]:
    return [c for c in _CORNERS if c in elements.columns]


def directed_edges(elements: DataFrame) -> DataFrame:
    """face, k, p, q: the k-th edge of each face from p to q."""
    if "vertices" in elements.columns:
        n = F.size("vertices")
        ring = F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda k: F.struct(k.alias("k"), F.get("vertices", k).alias("p"), F.get("vertices", (k + 1) % n).alias("q")),
        )
    else:
        c = corners(elements)
        ring = F.array(*[F.struct(F.lit(k).alias("k"), F.col(p).alias("p"), F.col(q).alias("q")) for k, (p, q) in enumerate(zip(c, c[1:] + c[:1], strict=True))])
    return elements.select(F.col("id").alias("face"), F.explode(ring).alias("e")).select("face", "e.k", "e.p", "e.q")


def unique_edges(elements: DataFrame) -> DataFrame:
    """a < b of every edge, once."""
    return directed_edges(elements).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def boundary_edges(elements: DataFrame) -> DataFrame:
    """a < b of edges that an odd number of faces have."""
    edges = directed_edges(elements).groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.count("*").alias("n"))
    return edges.filter("n % 2 = 1").select("a", "b")


def half_edges(elements: DataFrame) -> DataFrame:
    """face, k, node, twin_face (null on the boundary), next_node of every half-edge."""
    e = directed_edges(elements)
    twins = e.select(F.col("q").alias("p"), F.col("p").alias("q"), F.col("face").alias("twin_face"))
    return e.join(twins, ["p", "q"], "left").select("face", "k", F.col("p").alias("node"), "twin_face", F.col("q").alias("next_node"))


def manifold_report(elements: DataFrame) -> DataFrame:
    """Counts over a mesh: faces, edges, boundary edges, edges of more than two faces, zero-length edges."""
    edges = directed_edges(elements).groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.count("*").alias("n"))
    return edges.agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("n") == 1).alias("boundary"),
        F.count_if(F.col("n") > 2).alias("non_manifold"),
        F.count_if(F.col("a") == F.col("b")).alias("zero_length"),
    )


def valence(elements: DataFrame) -> DataFrame:
    """vertex, valence: edges at each vertex."""
    e = unique_edges(elements)
    return e.select(F.explode(F.array("a", "b")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("valence"))


def one_ring(elements: DataFrame) -> DataFrame:
    """vertex, faces (sorted ids of the faces around it)."""
    return directed_edges(elements).groupBy(F.col("p").alias("vertex")).agg(F.sort_array(F.collect_set("face")).alias("faces"))


def face_components(elements: DataFrame) -> DataFrame:
    """id, label of faces joined over shared edges."""
    he = half_edges(elements)
    linked = he.select(F.col("face").alias("a"), F.coalesce("twin_face", "face").alias("b"))
    return components(linked)


def chained(edges: DataFrame, follows: DataFrame) -> DataFrame:
    """edges (e, p, q) with loop, place, closed: chains of edges e that `follows` (e, next) links, each edge after at most one other.

    A closed chain is cut before its edge from the least vertex, an open one starts where nothing leads; loop is the least
    vertex, place counts from the start. How far an edge is from the end of its chain is found by pointer
    doubling, so a chain of n edges takes about log n rounds.
    """
    follows = checkpointed(follows.select("e", "next"))
    label = components(follows.select(F.col("e").alias("a"), F.col("next").alias("b")), gather=True).select(F.col("id").alias("e"), "label")
    edges = checkpointed(edges.join(label, "e", "left").join(follows, "e", "left").withColumn("label", F.coalesce("label", "e")))
    told = edges.groupBy("label").agg(
        F.least(F.min("p"), F.min("q")).alias("loop"), F.count("*").alias("n"), (F.count("next") == F.count("*")).alias("closed"), F.min_by("e", F.struct("p", "e")).alias("start")
    )
    told = checkpointed(told)
    to = F.when(F.col("closed") & (F.col("next") == F.col("start")), F.lit(None).cast("long")).otherwise(F.col("next"))
    hop = checkpointed(edges.join(told, "label").select("e", to.alias("to")).withColumn("hops", F.col("to").isNotNull().cast("long")))
    while not hop.filter("to IS NOT NULL").isEmpty():
        far = hop.select(F.col("e").alias("to"), F.col("to").alias("beyond"), F.col("hops").alias("more"))
        hop = checkpointed(hop.join(far, "to", "left").select("e", F.col("beyond").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
    placed = edges.join(told, "label").join(hop.select("e", "hops"), "e")
    return placed.select("e", "p", "q", "loop", (F.col("n") - 1 - F.col("hops")).alias("place"), "closed")


def loops(edges: DataFrame) -> DataFrame:
    """p, q, loop, place, closed: directed edges chained to loops and open chains, numbered by their least vertex (see chained).

    Where several edges meet at a vertex (a pinch) the one from the least vertex goes on to the least vertex, the second to the second, and so
    on; what finds no partner starts or ends an open chain. Repeated edges are one.
    """
    e = checkpointed(numbered(edges.select("p", "q").distinct(), ["p", "q"], "e"))
    leaving = e.select(F.col("p").alias("v"), F.col("e").alias("next"), F.row_number().over(Window.partitionBy("p").orderBy("q")).alias("k"))
    coming = e.select(F.col("q").alias("v"), "e", F.row_number().over(Window.partitionBy("q").orderBy("p")).alias("k"))
    return chained(e, coming.join(leaving, ["v", "k"])).drop("e")


def close_pairs(points: DataFrame, tolerance: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """a < b of points within a distance, by a grid of cells as wide as it; only half of the neighbours are visited."""
    cell = [F.floor(F.col(c) / tolerance) for c in axes]
    home = points.select("id", *axes, *[c.alias(f"h{k}") for k, c in enumerate(cell)])
    shifts = F.array(*[F.struct(*[F.lit(d // 3**k % 3 - 1).alias(f"d{k}") for k in range(len(axes))]) for d in range(3 ** len(axes))])
    guests = home.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in axes], *[f"h{k}" for k in range(len(axes))], F.explode(shifts).alias("s"))
    guests = guests.select("b", *[f"b_{c}" for c in axes], *[(F.col(f"h{k}") + F.col(f"s.d{k}")).alias(f"h{k}") for k in range(len(axes))])
    d2 = sum(((F.col(c) - F.col(f"b_{c}")) * (F.col(c) - F.col(f"b_{c}")) for c in axes), F.lit(0.0))
    return home.join(guests, [f"h{k}" for k in range(len(axes))]).filter((F.col("id") < F.col("b")) & (d2 <= tolerance * tolerance)).select(F.col("id").alias("a"), "b")


def _merged_by_pairs(points: DataFrame, tolerance: float, axes: tuple[str, ...]) -> DataFrame:
    """merge_map by all pairs of close places."""
    place = points.groupBy(*axes).agg(F.min("id").alias("id"))
    same = points.join(place.withColumnRenamed("id", "least"), list(axes)).filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    joined = components(close_pairs(place, tolerance, axes).unionByName(same))
    return points.select("id").join(joined, "id", "left").select("id", F.coalesce("label", "id").alias("to"))


def cell_links(points: DataFrame, tolerance: float, axes: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(id, head) of points with the least point of their cell, and pairs (a, b) of the least points of cells that close points join.

    All points of a cell are close to each other. Two cells are joined if their outermost points are close; those that are not
    joined by a chain of such are compared point by point, as far as a point is close to the box of the other cell.
    """
    side = tolerance / len(axes) ** 0.5 * (1 - 1e-9)
    home = checkpointed(points.select("id", *axes, F.struct(*[F.floor(F.col(c) / side).alias(f"h{k}") for k, c in enumerate(axes)]).alias("at")))
    spot = F.struct("id", *axes)
    outer = F.array(*[f(spot, F.struct(c, "id")) for c in axes for f in (F.min_by, F.max_by)])
    box = F.struct(*[f(c).alias(f"{n}_{c}") for c in axes for n, f in (("min", F.min), ("max", F.max))])
    cells = checkpointed(home.groupBy("at").agg(F.min("id").alias("head"), F.count("*").alias("n"), F.array_distinct(outer).alias("outer"), box.alias("box")))
    added = lambda terms: sum(terms, F.lit(0.0))
    limit = tolerance * tolerance
    near = lambda p, q: added((p[c] - q[c]) * (p[c] - q[c]) for c in axes) <= limit

    def beside(low: list, high: list, box: str):
        """Whether what spans low to high is as near to a box as the tolerance."""
        gaps = [F.greatest(F.lit(0.0), F.col(f"{box}.min_{c}") - q, p - F.col(f"{box}.max_{c}")) for c, p, q in zip(axes, low, high, strict=True)]
        return added(g * g for g in gaps) <= limit

    reach = [[d // 5**k % 5 - 2 for k in range(len(axes))] for d in range(5 ** len(axes))]
    shifts = F.array(*[F.struct(*[F.lit(d).alias(f"d{k}") for k, d in enumerate(s)]) for s in reach if s > [0] * len(axes)])
    guest = cells.select(*[F.col(c).alias(f"b_{c}") for c in cells.columns], F.explode(shifts).alias("s"))
    guest = guest.withColumn("at", F.struct(*[(F.col(f"b_at.h{k}") + F.col(f"s.d{k}")).alias(f"h{k}") for k in range(len(axes))])).drop("s")
    pairs = cells.join(guest, "at").filter(beside([F.col(f"box.min_{c}") for c in axes], [F.col(f"box.max_{c}") for c in axes], "b_box"))
    sure = F.exists("outer", lambda p: F.exists("b_outer", lambda q: near(p, q)))
    pairs = checkpointed(pairs.select("head", "b_head", "at", "b_at", "box", "b_box", "n", "b_n", sure.alias("sure")))
    links = pairs.filter("sure").select(F.col("head").alias("a"), F.col("b_head").alias("b"))
    label = components(links.unionByName(cells.select(F.col("head").alias("a"), F.col("head").alias("b"))))
    label = checkpointed(label)
    open_ = pairs.filter("NOT sure AND n * b_n > 1")
    for c, n in (("head", "label"), ("b_head", "b_label")):
        open_ = open_.join(label.select(F.col("id").alias(c), F.col("label").alias(n)), c)
    open_ = checkpointed(open_.filter("label <> b_label").select("head", "b_head", "at", "b_at", "box", "b_box"))
    here = [F.col(c) for c in axes]
    one = open_.join(home, "at").filter(beside(here, here, "b_box")).select("head", "b_head", F.struct(*axes).alias("p"))
    two = open_.select("head", "b_head", F.col("b_at").alias("at"), "box").join(home, "at").filter(beside(here, here, "box")).select("head", "b_head", F.struct(*axes).alias("q"))
    met = one.join(two, ["head", "b_head"]).filter(near(F.col("p"), F.col("q"))).select(F.col("head").alias("a"), F.col("b_head").alias("b")).distinct()
    back = home.join(cells.select("at", "head"), "at").select("id", "head")
    return back, label.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(met)


def merge_map(points: DataFrame, tolerance: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """id, to: every point and the least point that a chain of close points reaches.

    Points meet by cells (cell_links), so that crowds of close points make no pairs. Where a coordinate is more than a million
    tolerances from 0, or not finite, cells can't be told from each other exactly, and all pairs of close places are made.
    """
    far = points.agg(F.max(F.greatest(*[F.when(F.isnan(c), F.lit(float("inf"))).otherwise(F.abs(c)) for c in axes]))).first()[0]
    if far is None or not tolerance > 0 or far > 1e6 * tolerance:
        return _merged_by_pairs(points, tolerance, axes)
    known = " AND ".join(f"{c} IS NOT NULL" for c in axes)
    back, links = cell_links(points.filter(known), tolerance, axes)
    label = components(links).withColumnRenamed("id", "head")
    return back.join(label, "head").select("id", F.col("label").alias("to")).unionByName(points.filter(f"NOT ({known})").select("id", F.col("id").alias("to")))


def remapped(elements: DataFrame, mapping: DataFrame) -> DataFrame:
    """elements with their vertex ids replaced by the mapping (id, to)."""
    if "vertices" in elements.columns:
        each = elements.select("id", F.posexplode("vertices").alias("k", "vertex"))
        to = each.join(mapping.select(F.col("id").alias("vertex"), "to"), "vertex")
        return to.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "to"))), lambda s: s["to"]).alias("vertices"))
    out = elements
    for c in corners(elements):
        out = out.join(mapping.select(F.col("id").alias(c), F.col("to").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    return out.select(*elements.columns)


def tagged_triangles(triangles: DataFrame, vertex_groups: DataFrame) -> DataFrame:
    """id, group: 2 if any corner's group is 2, else 1."""
    each = triangles.select("id", F.explode(F.array("v0", "v1", "v2")).alias("vertex"))
    return each.join(vertex_groups.select(F.col("id").alias("vertex"), "group"), "vertex").groupBy("id").agg(F.max("group").alias("group"))


def group_counts(groups: DataFrame) -> DataFrame:
    """group, faces, largest: the faces of each group (id, group), and whether its number is the highest."""
    top = groups.agg(F.max("group")).first()[0]
    return groups.groupBy("group").agg(F.count("*").alias("faces")).withColumn("largest", F.col("group") == F.lit(top))


def extracted(triangles: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept triangles (ids in `kept`) renumbered from 0 in their order over renumbered vertices, and the vertices' new and old ids (id, was)."""
    used = checkpointed(triangles.join(kept.select("id"), "id", "left_semi"))
    vertices = used.select(F.explode(F.array("v0", "v1", "v2")).alias("was")).distinct()
    vertices = checkpointed(numbered(vertices, ["was"], "to").select("was", "to"))
    faces = numbered(remapped(used, vertices.select(F.col("was").alias("id"), "to")), ["id"], "face")
    return faces.select(F.col("face").alias("id"), "v0", "v1", "v2"), vertices.select(F.col("to").alias("id"), "was")


def interface_edges(triangles: DataFrame, groups: DataFrame) -> DataFrame:
    """p, q of half-edges whose own face has a lower group than their twin's."""
    he = half_edges(triangles)
    own = groups.select(F.col("id").alias("face"), F.col("group").alias("left"))
    other = groups.select(F.col("id").alias("twin_face"), F.col("group").alias("right"))
    return he.join(own, "face").join(other, "twin_face").filter("left < right").select(F.col("node").alias("p"), F.col("next_node").alias("q"))


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The directed edges (p, q, ...) but for those of `gone` (p, q) and their twins."""
    both = gone.select("p", "q").unionByName(gone.select(F.col("p").alias("q"), F.col("q").alias("p")))
    return edges.join(both, ["p", "q"], "left_anti")


def with_corners(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """triangles with the coordinates of their corners, ax .. cz."""
    out = triangles
    for corner, prefix in zip(("v0", "v1", "v2"), "abc", strict=True):
        out = out.join(vertices.select(F.col("id").alias(corner), *[F.col(c).alias(f"{prefix}{c}") for c in "xyz"]), corner)
    return out


def corner_vectors() -> tuple[v.Vec, v.Vec, v.Vec]:
    return tuple(v.vec(*[f"{p}{c}" for c in "xyz"]) for p in "abc")


def fan(polygons: DataFrame) -> DataFrame:
    """polygon, k, v0, v1, v2: convex polygons cut into triangles from their first vertex."""
    n = F.size("vertices")
    parts = F.transform(F.sequence(F.lit(1), n - 2), lambda k: F.struct(k.alias("k"), F.get("vertices", F.lit(0)).alias("v0"), F.get("vertices", k).alias("v1"), F.get("vertices", k + 1).alias("v2")))
    return polygons.filter(n >= 3).select(F.col("id").alias("polygon"), F.explode(parts).alias("t")).select("polygon", "t.*")


def outlines(elements: DataFrame, labels: DataFrame) -> DataFrame:
    """label, p, q, r, loop, place: the outlines of faces merged by label (id, label), with the vertex r after q.

    An edge is on the outline if the face across has another label or there is none. What follows an edge is found
    by turning around its end through the faces of its label, by pointer doubling, so outlines that touch
    themselves in a vertex stay apart. A loop is named after its least edge, numbered by face and place.
    """
    e = directed_edges(elements)
    width = (e.agg(F.max("k")).first()[0] or 0) + 1
    e = checkpointed(e.join(labels.select(F.col("id").alias("face"), "label"), "face").select("face", "p", "q", "label", (F.col("face") * width + F.col("k")).alias("e")))
    after = e.select("face", F.col("p").alias("q"), F.col("e").alias("next"))
    across = e.select(F.col("p").alias("q"), F.col("q").alias("p"), "label", F.col("e").alias("twin"))
    e = e.join(after, ["face", "q"]).join(across, ["p", "q", "label"], "left").select("label", "p", "q", "e", "next", "twin")
    e = checkpointed(e)
    outer = e.filter("twin IS NULL")
    # Edges that leave a vertex of the outline, and where each leads: itself on the outline, else the next one around the vertex.
    leaving = e.join(outer.select("label", "p").distinct(), ["label", "p"], "left_semi")
    turn = leaving.join(e.select(F.col("e").alias("twin"), F.col("next").alias("around")), "twin", "left")
    rounds = Rounds(elements.sparkSession)
    turn = rounds.next(turn.select("e", F.coalesce("around", "e").alias("to"), F.col("twin").isNull().alias("there")))
    ends = outer.select(F.col("e").alias("to"))
    while not turn.filter("NOT there").isEmpty():
        further = turn.select(F.col("e").alias("to"), F.col("to").alias("far"), F.col("there").alias("arrived"))
        turn = rounds.next(turn.join(further, "to").select("e", F.col("far").alias("to"), "arrived").withColumnRenamed("arrived", "there"))
    turn = turn.join(ends, "to", "left_semi")
    chained = outer.join(turn.select(F.col("e").alias("next"), F.col("to").alias("then")), "next")
    chained = checkpointed(chained.join(outer.select(F.col("e").alias("then"), F.col("q").alias("r")), "then").select("label", "p", "q", "r", "e", "then"))
    loop = loops(chained.select(F.col("e").alias("p"), F.col("then").alias("q"))).select(F.col("p").alias("e"), "loop", "place")
    return chained.join(loop, "e").select("label", "p", "q", "r", "loop", "place")
