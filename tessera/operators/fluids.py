"""Particles: optimal transport, the spring-particle step, shallow water.

Particles are rows; a step is a chain of diagrams, facet sums and projections.
Globally coupled loops run on the driver over DataFrames and are cut by
checkpoints; the driver sees only scalars.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import calculus, multilevel, voronoi
from tessera.operators.ordering import checkpointed
from tessera.operators.sparse import bicgstab

# The Earth and the standard shallow-water cases.
RADIUS, GRAVITY, OMEGA = 6371220.0, 9.80616, 7.292e-5
DAY = 86400.0


def williamson(case: int) -> dict[str, Callable[[v.Vec], object]]:
    """height, terrain, velocity and coriolis as column builders of a point of the unit sphere."""
    u0 = 2 * math.pi * RADIUS / (12 * DAY)
    zero = lambda p: F.lit(0.0)
    coriolis = lambda p: 2 * OMEGA * p[2]
    around = lambda speed: lambda p: (-speed * p[1], speed * p[0], F.lit(0.0))
    if case == 1:
        centre, reach = (0.0, -1.0, 0.0), 1 / 3

        def bell(p: v.Vec) -> Column:
            r = F.acos(v.clamp(p[0] * centre[0] + p[1] * centre[1] + p[2] * centre[2], -1.0, 1.0))
            return F.when(r < reach, 500 * (1 + F.cos(math.pi * r / reach))).otherwise(0.0)

        return {"height": bell, "terrain": zero, "velocity": around(u0), "coriolis": coriolis}
    if case == 2:
        drop = (RADIUS * OMEGA * u0 + 0.5 * u0 * u0) / GRAVITY
        height = lambda p: 2.94e4 / GRAVITY - drop * p[0] * p[0]
        return {"height": height, "terrain": zero, "velocity": lambda p: (F.lit(0.0), u0 * p[2], -u0 * p[1]), "coriolis": lambda p: -2 * OMEGA * p[0]}
    if case == 5:
        drop = (RADIUS * OMEGA * 20 + 0.5 * 400) / GRAVITY

        def mountain(p: v.Vec) -> Column:
            lon, lat = v.lon_lat(p)
            reach = math.pi / 9
            d2 = (lon + math.pi / 2) * (lon + math.pi / 2) + (lat - math.pi / 6) * (lat - math.pi / 6)
            return 2000 * (1 - F.sqrt(F.least(F.lit(reach * reach), d2)) / reach)

        height = lambda p: 5960 - drop * p[2] * p[2] - mountain(p)
        return {"height": height, "terrain": mountain, "velocity": around(20.0), "coriolis": coriolis}
    raise ValueError(f"no case {case}")


def initial_state(sites: DataFrame, case: int) -> DataFrame:
    """id, x, y, z, h, hs, ux, uy, uz, fc on sites of the unit sphere."""
    of, p = williamson(case), v.vec("x", "y", "z")
    u = of["velocity"](p)
    return sites.select("id", "x", "y", "z", of["height"](p).alias("h"), of["terrain"](p).alias("hs"), *[c.alias(f"u{k}") for c, k in zip(u, "xyz", strict=True)], of["coriolis"](p).alias("fc"))


def totals(state: DataFrame) -> DataFrame:
    """mass, momentum, energy and area; state has volume, h, hs and ux, uy, uz."""
    u, h, vol = v.vec("ux", "uy", "uz"), F.col("h"), F.col("volume")
    speed2 = v.dot(u, u)
    return state.agg(
        F.sum(vol * h).alias("mass"),
        F.sum(vol * (F.sqrt(speed2) + F.sqrt(GRAVITY * h))).alias("momentum"),
        F.sum(0.5 * vol * (h * speed2 + GRAVITY * ((h + F.col("hs")) * (h + F.col("hs")) - F.col("hs") * F.col("hs")))).alias("energy"),
        F.sum(vol).alias("area"),
    )


def transport(sites: DataFrame, targets: DataFrame, domain: voronoi.Domain = voronoi.Domain(), tolerance: float = 1e-8, most: int = 20, solver_rounds: int = 100) -> DataFrame:
    """id, x, y, z, w, volume, mx, my, mz: weights by Newton's method so that the cells' volumes meet the targets (id, target).

    The Hessian is a sparse matrix from the facets, solved for by nested dissection of the sites' places; steps are halved
    until no cell is smaller than half the least of the first and the target volumes. Rows of one id are one site until the
    end. Sites without a place of their own have empty cells; the others' targets are scaled to the domain's area.
    """
    given = checkpointed(sites.select("id", "x", "y", "z").join(targets.select("id").distinct(), "id", "left_semi"))
    first = voronoi.diagram(given.dropDuplicates(["id"]).withColumn("w", F.lit(0.0)), domain)
    cells = checkpointed(first.filter("volume > 0"))
    wanted = cells.select("id").join(targets.dropDuplicates(["id"]), "id")
    whole = wanted.agg(F.sum("target")).first()[0]
    wanted = checkpointed(wanted.select("id", (F.col("target") * (domain.area / (whole or 1.0))).alias("target")))
    least = cells.join(wanted, "id").agg(F.least(F.min("volume"), F.min("target"))).first()[0]
    for _ in range(most if whole else 0):
        gap = checkpointed(cells.join(wanted, "id").select("id", "x", "y", "z", "w", (F.col("target") - F.col("volume")).alias("g")))
        worst = gap.agg(F.max(F.abs("g"))).first()[0]
        if worst < tolerance:
            break
        inner = voronoi.facets(cells, domain).filter("bj IS NOT NULL")
        ends = gap.select(F.col("id").alias("bi"), F.struct("x", "y", "z").alias("p")), gap.select(F.col("id").alias("bj"), F.struct("x", "y", "z").alias("q"))
        r = v.length(v.sub(v.vec("p.x", "p.y", "p.z"), v.vec("q.x", "q.y", "q.z")))
        half = inner.join(ends[0], "bi").join(ends[1], "bj").select("bi", "bj", (0.5 * F.col("length") / r).alias("c"))
        entry = lambda i, j, c: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), c.alias("value"))
        c = F.col("c")
        entries = F.array(entry("bi", "bj", -c), entry("bj", "bi", -c), entry("bi", "bi", c), entry("bj", "bj", c))
        # The negative Hessian is positive but for constants, which move no cell.
        matrix = half.select(F.explode(entries).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.value").alias("value"))
        places = gap.select(F.col("id").alias("i"), "x", "y", "z")
        step, _ = multilevel.solve(matrix, gap.select(F.col("id").alias("i"), F.col("g").alias("value")), 1e-6, solver_rounds, singular=True, places=places)
        step = checkpointed(step)
        share = 1.0
        while share > 1e-3:
            moved = gap.join(step.select(F.col("i").alias("id"), F.col("value").alias("dw")), "id", "left").select("id", "x", "y", "z", (F.col("w") + share * F.coalesce("dw", F.lit(0.0))).alias("w"))
            trial = checkpointed(voronoi.diagram(moved, domain, bent=True))
            found = trial.agg(F.min("volume")).first()
            if found[0] is not None and found[0] >= least / 2:
                break
            share /= 2
        cells = trial
    reached = ["id", "w", "volume", "mx", "my", "mz"]
    every = cells.select(reached).unionByName(first.join(cells.select("id"), "id", "left_anti").select(reached))
    return given.join(every, "id").select("id", "x", "y", "z", *reached[1:])


def spring_step(particles: DataFrame, dt: float, epsilon: float, force: Callable[[], v.Vec], domain: voronoi.Domain = voronoi.Domain()) -> DataFrame:
    """One step of spring particles (id, x, y, z, mass, ux, uy, uz), pulled to their cells' centroids."""
    cells = voronoi.diagram(particles.select("id", "x", "y", "z"), domain)
    middle = voronoi.centroids(cells, domain).select("id", *[F.col(k).alias(f"c{k}") for k in "xyz"])
    p, c, u = v.vec("x", "y", "z"), v.vec("cx", "cy", "cz"), v.vec("ux", "uy", "uz")
    total = v.add(force(), v.scale(v.sub(c, p), 1 / (epsilon * epsilon)))
    speed = v.add(u, v.scale(total, dt / F.col("mass")))
    place = v.add(c, v.scale(speed, dt))
    if domain.sphere:
        place = v.unit(place)
        speed = v.tangent(speed, place)
    out = particles.join(middle, "id").select("id", "mass", *[a.alias(k) for a, k in zip(place, "xyz", strict=True)], *[a.alias(f"u{k}") for a, k in zip(speed, "xyz", strict=True)])
    return checkpointed(out.select("id", "x", "y", "z", "mass", "ux", "uy", "uz"))


def explicit_height(state: DataFrame, facets: DataFrame, dt: float) -> DataFrame:
    """id, h after one explicit step of the height equation on the unit sphere scaled by the Earth's radius."""
    div = calculus.divergence(facets, state, ("ux", "uy", "uz"))
    return state.join(div, "id", "left").select("id", (F.col("h") * (1 - dt * F.coalesce("div", F.lit(0.0)) / RADIUS)).alias("h"))


def height_matrix(state: DataFrame, facets: DataFrame, dt: float) -> DataFrame:
    """i, j, value of the semi-implicit height equation: one on the diagonal plus a facet Laplacian scaled by height."""
    pairs = calculus.gathered(facets, state, ["h"])
    r = v.length(v.sub(v.vec("i_x", "i_y", "i_z"), v.vec("j_x", "j_y", "j_z")))
    c = GRAVITY * dt * dt * F.col("length") / (r * RADIUS * RADIUS)
    to_i, to_j = F.col("i_h") * c / F.col("i_volume"), F.col("i_h") * c / F.col("j_volume")
    entry = lambda i, j, c: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), c.alias("value"))
    entries = F.array(entry("bi", "bj", -to_i), entry("bj", "bi", -to_j), entry("bi", "bi", to_i), entry("bj", "bj", to_j))
    off = pairs.select(F.explode(entries).alias("e")).select("e.*")
    one = state.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("value"))
    return off.unionByName(one).groupBy("i", "j").agg(F.sum("value").alias("value"))


def semi_implicit_height(state: DataFrame, facets: DataFrame, dt: float) -> DataFrame:
    """id, h after a semi-implicit step: waves are solved for, so dt isn't bound by their speed."""
    turned = v.cross(v.vec("x", "y", "z"), v.vec("ux", "uy", "uz"))
    pushed = state.select("id", "x", "y", "z", "volume", *[(F.col(f"u{k}") - dt * F.col("fc") * c).alias(f"f{k}") for c, k in zip(turned, "xyz", strict=True)])
    div = calculus.divergence(facets, pushed, ("fx", "fy", "fz"))
    right = state.join(div, "id", "left").select(F.col("id").alias("i"), (F.col("h") * (1 - dt * F.coalesce("div", F.lit(0.0)) / RADIUS)).alias("value"))
    return bicgstab(height_matrix(state, facets, dt), right).select(F.col("i").alias("id"), F.col("value").alias("h"))


def shallow_water_step(state: DataFrame, dt: float, transported: bool = False) -> DataFrame:
    """One explicit step of shallow water: height, advection, mass-conserving height, velocity."""
    cells = voronoi.diagram(state.select("id", "x", "y", "z"))
    sized = checkpointed(state.join(cells.select("id", "volume"), "id").withColumn("total", F.col("h") + F.col("hs")))
    f = checkpointed(voronoi.facets(cells))
    height = explicit_height(sized, f, dt).withColumnRenamed("h", "h1")
    slope = calculus.gradient(f, sized, "total")
    drag = calculus.viscosity(f, sized, "h", ("ux", "uy", "uz"), GRAVITY)
    p, u, g, a = v.vec("x", "y", "z"), v.vec("ux", "uy", "uz"), v.vec("gx", "gy", "gz"), v.vec("fx", "fy", "fz")
    turn = v.cross(p, u)
    push = v.add(v.add(v.scale(g, GRAVITY / RADIUS), v.scale(turn, F.col("fc"))), v.add(v.scale(p, v.dot(u, u) / RADIUS), v.scale(a, -1 / RADIUS)))
    speed = v.sub(u, v.scale(push, dt))
    place = v.unit(v.add(p, v.scale(u, dt / RADIUS)))
    joined = sized.join(height, "id").join(slope, "id", "left").join(drag, "id", "left").fillna(0.0, ["gx", "gy", "gz", "fx", "fy", "fz"])
    moved = joined.select("id", *[c.alias(k) for c, k in zip(place, "xyz", strict=True)], "h1", "hs", *[c.alias(f"u{k}") for c, k in zip(speed, "xyz", strict=True)], "fc", (F.col("volume") * F.col("h")).alias("mass"), "volume")
    moved = checkpointed(moved)
    if transported:
        target = moved.select("id", (F.col("mass") / F.col("h1")).alias("target"))
        scale = 4 * math.pi / target.agg(F.sum("target")).first()[0]
        after = transport(moved.select("id", "x", "y", "z"), target.withColumn("target", F.col("target") * scale), most=3)
    else:
        after = voronoi.diagram(moved.select("id", "x", "y", "z"))
    out = moved.drop("volume").join(after.select("id", "volume"), "id").withColumn("h", F.col("mass") / F.col("volume"))
    flat = v.tangent(v.vec("ux", "uy", "uz"), v.vec("x", "y", "z"))
    return checkpointed(out.select("id", "x", "y", "z", "h", "hs", *[c.alias(f"u{k}") for c, k in zip(flat, "xyz", strict=True)], "fc"))
