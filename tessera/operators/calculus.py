"""Discrete operators on facets: one row per pair of cells, with length and midpoint.

facets: bi, bj (null on the domain's boundary), length, mx, my, mz. sites: id,
x, y, z, volume. Each operator gathers both sites of a facet by equi-joins,
explodes a facet into its two signed contributions and sums them by site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as v


def gathered(facets: DataFrame, sites: DataFrame, fields: list[str]) -> DataFrame:
    """Inner facets with positions, volumes and fields of both sites, as i_* and j_*."""
    names = ["x", "y", "z", "volume", *fields]
    out = facets.filter("bj IS NOT NULL")
    for s in "ij":
        out = out.join(sites.select(F.col("id").alias(f"b{s}"), *[F.col(c).alias(f"{s}_{c}") for c in names]), f"b{s}")
    return out


def _points() -> tuple[v.Vec, v.Vec, v.Vec, Column]:
    zi, zj = v.vec("i_x", "i_y", "i_z"), v.vec("j_x", "j_y", "j_z")
    return zi, zj, v.vec("mx", "my", "mz"), v.length(v.sub(zi, zj))


def _summed(pairs: DataFrame, to_i: list[Column], to_j: list[Column], names: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.col(s).alias("id"), *[c.alias(n) for c, n in zip(part, names, strict=True)]) for s, part in (("bi", to_i), ("bj", to_j))])
    return pairs.select(F.explode(rows).alias("r")).groupBy("r.id").agg(*[F.sum(f"r.{n}").alias(n) for n in names])


def gradient(facets: DataFrame, sites: DataFrame, field: str, formula: str = "springel") -> DataFrame:
    """id, gx, gy, gz."""
    pairs = gathered(facets, sites, [field])
    zi, zj, m, r = _points()
    fi, fj, length = F.col(f"i_{field}"), F.col(f"j_{field}"), F.col("length")
    if formula == "kincl":
        to_i = v.scale(v.sub(zi, m), length * (fi - fj) / (r * F.col("i_volume")))
        to_j = v.scale(v.sub(zj, m), length * (fj - fi) / (r * F.col("j_volume")))
    else:
        c = v.sub(m, v.scale(v.add(zi, zj), 0.5))
        to_i = v.scale(v.sub(v.scale(c, fj - fi), v.scale(v.sub(zi, zj), 0.5 * (fi + fj))), length / r / F.col("i_volume"))
        to_j = v.scale(v.sub(v.scale(c, fi - fj), v.scale(v.sub(zj, zi), 0.5 * (fi + fj))), length / r / F.col("j_volume"))
    return _summed(pairs, list(to_i), list(to_j), ["gx", "gy", "gz"])


def tangential(vectors: DataFrame, sites: DataFrame, names: tuple[str, str, str] = ("gx", "gy", "gz")) -> DataFrame:
    """id and the vectors' parts along the unit sphere at their sites."""
    at = sites.select("id", *[F.col(k).alias(f"_{k}") for k in "xyz"])
    along = v.tangent(v.vec(*names), v.vec("_x", "_y", "_z"))
    return vectors.join(at, "id").select("id", *[c.alias(n) for c, n in zip(along, names, strict=True)])


def divergence(facets: DataFrame, sites: DataFrame, velocity: tuple[str, str, str]) -> DataFrame:
    """id, div."""
    pairs = gathered(facets, sites, list(velocity))
    zi, zj, m, r = _points()
    du = v.sub(v.vec(*[f"i_{c}" for c in velocity]), v.vec(*[f"j_{c}" for c in velocity]))
    share = F.col("length") / r
    to_i = share * v.dot(v.sub(zi, m), du) / F.col("i_volume")
    to_j = -share * v.dot(v.sub(zj, m), du) / F.col("j_volume")
    return _summed(pairs, [to_i], [to_j], ["div"])


def curl(facets: DataFrame, sites: DataFrame, velocity: tuple[str, str, str]) -> DataFrame:
    """id, wx, wy, wz."""
    pairs = gathered(facets, sites, list(velocity))
    zi, zj, m, r = _points()
    du = v.sub(v.vec(*[f"j_{c}" for c in velocity]), v.vec(*[f"i_{c}" for c in velocity]))
    share = F.col("length") / r
    to_i = v.scale(v.cross(du, v.sub(zi, m)), share / F.col("i_volume"))
    to_j = v.scale(v.cross(du, v.sub(zj, m)), -share / F.col("j_volume"))
    return _summed(pairs, list(to_i), list(to_j), ["wx", "wy", "wz"])


def laplacian(facets: DataFrame, sites: DataFrame, field: str) -> DataFrame:
    """id, lap."""
    pairs = gathered(facets, sites, [field])
    _, _, _, r = _points()
    flow = F.col("length") * (F.col(f"i_{field}") - F.col(f"j_{field}")) / r
    return _summed(pairs, [-flow / F.col("i_volume")], [flow / F.col("j_volume")], ["lap"])


def viscosity(facets: DataFrame, sites: DataFrame, height: str, velocity: tuple[str, str, str], gravity: float) -> DataFrame:
    """id, fx, fy, fz of the artificial viscosity."""
    pairs = gathered(facets, sites, [height, *velocity])
    zi, zj, m, r = _points()
    du = v.sub(v.vec(*[f"i_{c}" for c in velocity]), v.vec(*[f"j_{c}" for c in velocity]))
    dz = v.sub(zi, zj)
    speed = F.sqrt(gravity * F.col(f"i_{height}")) + F.sqrt(gravity * F.col(f"j_{height}"))
    pi = -0.5 * speed * v.dot(du, dz) / F.sqrt(v.dot(dz, dz) + 1e-12)
    to_i = v.scale(v.sub(zi, m), -F.col("length") * pi / (r * F.col("i_volume")))
    to_j = v.scale(v.sub(zj, m), -F.col("length") * pi / (r * F.col("j_volume")))
    return _summed(pairs, list(to_i), list(to_j), ["fx", "fy", "fz"])


def max_displacement(facets: DataFrame, sites: DataFrame, weight: str | None = None) -> DataFrame:
    """id, reach: half the distance to the nearest bisector, each site measured from its own place."""
    pairs = gathered(facets, sites, [weight] if weight else [])
    _, _, _, r = _points()
    wi, wj = (F.col(f"{s}_{weight}") if weight else F.lit(0.0) for s in "ij")
    at_i = F.abs(r * r + wi - wj) / (2 * r)
    at_j = F.abs(r * r + wj - wi) / (2 * r)
    rows = F.array(F.struct(F.col("bi").alias("id"), (at_i / 2).alias("reach")), F.struct(F.col("bj").alias("id"), (at_j / 2).alias("reach")))
    return pairs.select(F.explode(rows).alias("r")).groupBy("r.id").agg(F.min("r.reach").alias("reach"))
