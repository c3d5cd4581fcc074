"""Points in triangles of the plane, and neighbours over a graph; nearest neighbours in space are in trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import checkpointed


def locate(points: DataFrame, triangles: DataFrame, width: float) -> DataFrame:
    """id, triangle (the least id of those that hold the point; null outside), s, t (shares of its second and third corner).

    triangles: id, ax, ay, bx, by, cx, cy. Every triangle is dealt to the grid cells
    of a width that its box meets, a point to its own cell, so the join is an
    equi-join; the width should be about that of a triangle. A flat triangle holds no point.
    """
    cell = lambda c: F.floor(c / width)
    box = {a: [f(*[f"{p}{a}" for p in "abc"]) for f in (F.least, F.greatest)] for a in "xy"}
    dealt = triangles.select("*", F.explode(F.sequence(cell(box["x"][0]), cell(box["x"][1]))).alias("_i"), F.lit(0).alias("_j"))
    dealt = dealt.select(F.col("id").alias("triangle"), "ax", "ay", "bx", "by", "cx", "cy", "_i", F.explode(F.sequence(cell(box["y"][0]), cell(box["y"][1]))).alias("_j"))
    met = points.select("id", "x", "y", cell(F.col("x")).alias("_i"), cell(F.col("y")).alias("_j")).join(dealt, ["_i", "_j"])
    area = "((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))"
    met = met.withColumn("s", F.expr(f"try_divide((x - ax) * (cy - ay) - (y - ay) * (cx - ax), {area})")).withColumn("t", F.expr(f"try_divide((bx - ax) * (y - ay) - (by - ay) * (x - ax), {area})"))
    first = met.filter("s >= 0 AND t >= 0 AND s + t <= 1").groupBy("id").agg(F.min(F.struct("triangle", "s", "t")).alias("f"))
    return points.select("id").join(first, "id", "left").select("id", "f.triangle", "f.s", "f.t")


def over_graph(points: DataFrame, edges: DataFrame, k: int, levels: int, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """id, rank, neighbour, d2: the k nearest of the points that at most so many edges (a, b; each once) lead to.

    Ties go to the lower id; a point without edges has no row. The work grows with the points within reach,
    so the edges should come from a graph of bounded degree, like a diagram's.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    reached = both.select(F.col("a").alias("id"), F.col("b").alias("neighbour"))
    for _ in range(levels - 1):
        step = reached.join(both.select(F.col("a").alias("neighbour"), F.col("b").alias("to")), "neighbour").select("id", F.col("to").alias("neighbour"))
        reached = checkpointed(reached.unionByName(step).filter("id <> neighbour").distinct())
    at = points.select("id", *axes)
    far = at.select(F.col("id").alias("neighbour"), *[F.col(c).alias(f"n_{c}") for c in axes])
    d2 = sum(((F.col(c) - F.col(f"n_{c}")) * (F.col(c) - F.col(f"n_{c}")) for c in axes), F.lit(0.0))
    each = reached.join(at, "id").join(far, "neighbour").select("id", "neighbour", d2.alias("d2"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "neighbour")) - 1)
    return ranked.filter(F.col("rank") < k).select("id", "rank", "neighbour", "d2")
