"""Regions of a mesh: coasts between two groups of faces, and groups merged to polygons with holes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graphs import components
from tessera.operators.ordering import checkpointed, numbered
from tessera.operators.topology import extracted, half_edges, outlines


def connected(triangles: DataFrame, labels: DataFrame) -> DataFrame:
    """id, region: the least face that a face is joined with over edges between faces of its label (id, label)."""
    he = half_edges(triangles).filter("twin_face IS NOT NULL")
    own = labels.select(F.col("id").alias("face"), F.col("label").alias("left"))
    other = labels.select(F.col("id").alias("twin_face"), F.col("label").alias("right"))
    same = he.join(own, "face").join(other, "twin_face").filter("left = right").select(F.col("face").alias("a"), F.col("twin_face").alias("b"))
    return components(same.unionByName(labels.select(F.col("id").alias("a"), F.col("id").alias("b"))), gather=True).select("id", F.col("label").alias("region"))


@dataclass
class Coast:
    """The two sides as meshes of their own: triangles (id, v0, v1, v2), vertices (id, was), lines (id, v0, v1, group);
    lines: the same over the whole mesh, with place; group counts loops from 1."""

    lines: DataFrame
    land: tuple[DataFrame, DataFrame, DataFrame]
    water: tuple[DataFrame, DataFrame, DataFrame]


def coast(triangles: DataFrame, groups: DataFrame, land: int = 1) -> Coast:
    """The mesh cut along the edges between faces of the group `land` (id, group) and all others.

    Lines run with land on their left. What follows a line is found by turning around its end through land, so where two
    parts of a coast touch in a vertex (a pinch) each goes on along its own land. Loops are numbered in the order of their least edges.
    Where the mesh ends, a loop runs along its border, but only edges with a face across are lines: the loop's
    lines then are open chains, in the order of place. Both sides keep the faces' order; every end of a line is a vertex of both.
    """
    label = checkpointed(groups.select("id", (F.col("group") == land).alias("label")))
    around = outlines(triangles, label).filter("label")
    number = numbered(around.select("loop").distinct(), ["loop"], "n").select("loop", (F.col("n") + 1).alias("group"))
    across = half_edges(triangles).filter("twin_face IS NOT NULL").select(F.col("node").alias("p"), F.col("next_node").alias("q"))
    lines = around.join(across, ["p", "q"], "left_semi").join(number, "loop")
    lines = checkpointed(numbered(lines, ["group", "place"], "id").select("id", F.col("p").alias("v0"), F.col("q").alias("v1"), "group", "place"))

    def side(of: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        faces, vertices = extracted(triangles, of)
        own = lines.select("id", "v0", "v1", "group")
        for c in ("v0", "v1"):
            own = own.join(vertices.select(F.col("was").alias(c), F.col("id").alias("to")), c).withColumn(c, F.col("to")).drop("to")
        return faces, vertices, own.select("id", "v0", "v1", "group")

    return Coast(lines, side(label.filter("label")), side(label.filter("NOT label")))


def merged(triangles: DataFrame, vertices: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, rings): faces of the plane merged by label (id, label), each part that hangs together over edges by itself.

    rings: region (the part's least face), label, ring (its least edge), outer, area (signed, holes below zero), vertices. A region has one
    outer ring, anticlockwise, and its holes run clockwise; where it touches itself in a vertex rings stay apart. Corners between
    two neighbours only are kept. vertices: id, was, x, y, z of those on a ring, renumbered in their order. Faces must be
    anticlockwise; a region of flat faces has a ring of area 0, which counts as outer.
    """
    region = checkpointed(connected(triangles, labels))
    edge = outlines(triangles, region.select("id", F.col("region").alias("label"))).select(F.col("label").alias("region"), "p", "q", "loop", "place")
    edge = checkpointed(edge)
    used = numbered(edge.select(F.col("p").alias("was")).distinct(), ["was"], "id").join(vertices.select(F.col("id").alias("was"), "x", "y", "z"), "was")
    used = checkpointed(used.select("id", "was", "x", "y", "z"))
    at = lambda c: used.select(F.col("was").alias(c), F.col("id").alias(f"{c}_id"), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    placed = edge.join(at("p"), "p").join(at("q"), "q")
    area = F.sum(F.col("px") * F.col("qy") - F.col("qx") * F.col("py")) / 2
    order = F.transform(F.array_sort(F.collect_list(F.struct("place", "p_id"))), lambda s: s["p_id"])
    rings = placed.groupBy("region", F.col("loop").alias("ring")).agg(area.alias("area"), order.alias("vertices"))
    told = rings.join(labels.select(F.col("id").alias("region"), "label"), "region")
    return used, told.select("region", "label", "ring", (F.col("area") >= 0).alias("outer"), "area", "vertices")
