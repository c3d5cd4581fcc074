"""Queries over sites, rasters and generated meshes."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import matrices
from tessera.functions import vectors as v
from tessera.operators import adaptation, fem, neighbours, ordering, polygons, raster, topology, trees
from tessera.sources import formats, meshes, sites

R = v.rounded


def _named(**columns) -> list:
    return [R(c).alias(n) for n, c in columns.items()]


def sphere_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, w = v.sphere_params(v.vec("x", "y", "z"))
    return sites.sphere_sites(spark, sf_dir).select("id", *_named(u=u, v=w))


def lon_lat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = v.lon_lat(v.vec("x", "y", "z"))
    return sites.sphere_sites(spark, sf_dir).select("id", *_named(lon=lon, lat=lat))


def tangent_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.tangent(v.vec("gx", "gy", "gz"), v.vec("x", "y", "z"))
    return sites.sphere_sites(spark, sf_dir).select("id", *_named(tx=t[0], ty=t[1], tz=t[2]))


def lift_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sites.sphere_sites(spark, sf_dir)
    high = s.agg(F.max("f")).first()[0]
    return s.select("id", *_named(w4=F.sqrt(F.greatest(F.lit(0.0), F.lit(high) - F.col("f")))))


def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = ordering.bounding_box(sites.sphere_sites(spark, sf_dir))
    return box.select(*[R(F.col(c)).alias(c) for c in box.columns])


def morton_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.z_order(sites.sphere_sites(spark, sf_dir)).select("id", "morton", "place")


def knn_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sites.square_sites(spark, sf_dir)
    return trees.nearest(s, s, 8, ("x", "y")).select("id", F.col("rank").cast("long").alias("rank"), "neighbour", R(F.col("d2"), 9).alias("d2"))


def knn_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sites.sphere_sites(spark, sf_dir)
    return trees.nearest(s, s, 8, ("x", "y", "z")).select("id", F.col("rank").cast("long").alias("rank"), "neighbour", R(F.col("d2"), 9).alias("d2"))


def nearest_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trees.nearest(sites.square_sites(spark, sf_dir), sites.suppliers(spark, sf_dir), 1, ("x", "y"))
    return found.select("id", "neighbour", R(F.col("d2"), 9).alias("d2"))


def relative_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative L2 distance of each customer's field to that of the nearest supplier."""
    a, b = sites.square_sites(spark, sf_dir), sites.suppliers(spark, sf_dir)
    found = trees.nearest(a, b, 1, ("x", "y")).select("id", "neighbour")
    both = found.join(a.select("id", "f"), "id").join(b.select(F.col("id").alias("neighbour"), F.col("f").alias("g")), "neighbour")
    return both.agg(R(F.sqrt(F.sum((F.col("f") - F.col("g")) ** 2) / F.sum(F.col("f") ** 2))).alias("error"))


def merge_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.merge_map(sites.square_sites(spark, sf_dir), 0.01, ("x", "y"))


def spring_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's value, taken as seconds, as days, hours and minutes."""
    e = sites.table(spark, sf_dir, "events")
    return e.select("event_id", v.days_hours_minutes(F.col("value") * 1000).alias("clock"))


def _grid(spark: SparkSession, sf_dir: str) -> meshes.Mesh:
    """A grid with about two triangles for every customer, whose balance moves the vertex of its number by up to half a cell."""
    customers = sites.table(spark, sf_dir, "customer")
    n = sites.side(customers)
    m = meshes.grid(spark, n, n)
    least = customers.agg(F.min("c_custkey")).first()[0] or 0
    moves = customers.select((F.col("c_custkey") - least).alias("id"), (F.col("c_acctbal") / 20000 / n).alias("move"))
    vertices = m.vertices.join(moves, "id", "left").withColumn("x", F.col("x") + F.coalesce("move", F.lit(0.0))).drop("move")
    return dataclasses.replace(m, vertices=vertices.select(*m.vertices.columns))


def grid_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _grid(spark, sf_dir)
    t = topology.with_corners(m.triangles, m.vertices)
    a, b, c = topology.corner_vectors()
    area = v.planar_area(a, b, c)
    return t.select("id", "v0", "v1", "v2", R(area, 9).alias("area"), R(v.quality(a, b, c, area)).alias("quality"))


def grid_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).quads


def polygon_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.fan(_grid(spark, sf_dir).polygons).withColumn("k", F.col("k").cast("long"))


def unique_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.unique_edges(_grid(spark, sf_dir).triangles)


def boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.boundary_edges(_grid(spark, sf_dir).triangles)


def half_edge_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.half_edges(_grid(spark, sf_dir).triangles).withColumn("k", F.col("k").cast("long"))


def vertex_valence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.valence(_grid(spark, sf_dir).triangles)


def manifold_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.manifold_report(_grid(spark, sf_dir).triangles)


def one_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.one_ring(_grid(spark, sf_dir).triangles).select("vertex", F.array_join("faces", ",").alias("faces"))


def obj_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.obj_lines(_grid(spark, sf_dir)).withColumn("kind", F.col("kind").cast("long"))


def site_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.site_text(sites.sphere_sites(spark, sf_dir))


def icosphere_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spherical areas of a subdivided icosahedron with at least as many triangles as there are embeddings."""
    n = sites.table(spark, sf_dir, "embeddings").count()
    level = max(0, math.ceil(math.log(max(n, 20) / 20, 4)))
    m = meshes.subdivided_sphere(spark, level)
    a, b, c = topology.corner_vectors()
    return topology.with_corners(m.triangles, m.vertices).select("id", R(v.spherical_area(a, b, c), 9).alias("area"))


def squircle_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of the triangles of a squircle with about four sectors for each root of the customers."""
    n = sites.side(sites.table(spark, sf_dir, "customer"))
    m = meshes.squircle(spark, 0.1, max(1, n // 8), max(1, n // 4))
    a, b, c = topology.corner_vectors()
    return topology.with_corners(m.triangles, m.vertices).select("id", R(v.planar_area(a, b, c), 9).alias("area"))


def _raster_at(spark: SparkSession, sf_dir: str, points: DataFrame) -> DataFrame:
    return raster.lookup(points, sites.raster(spark, sf_dir), sites.RASTER_WIDTH, sites.RASTER_HEIGHT)


def raster_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, w = v.sphere_params(v.vec("x", "y", "z"))
    s = sites.sphere_sites(spark, sf_dir).select("id", u.alias("u"), w.alias("v"))
    return _raster_at(spark, sf_dir, s).select("id", F.col("value").cast("long").alias("value"))


def raster_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raster.limited(raster.binary(sites.raster(spark, sf_dir), 100, 10, 255), 20, 200)
    return r.select(*[F.col(c).cast("long").alias(c) for c in ("px", "py", "value")])


def raster_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.periodic(sites.raster(spark, sf_dir)).select(*[F.col(c).cast("long").alias(c) for c in ("px", "py", "value")])


def raster_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raster.smoothed(sites.raster(spark, sf_dir), sites.RASTER_WIDTH, sites.RASTER_HEIGHT)
    return r.select(*[F.col(c).cast("long").alias(c) for c in ("px", "py", "value")])


def _groups(spark: SparkSession, sf_dir: str) -> tuple[meshes.Mesh, DataFrame]:
    m = _grid(spark, sf_dir)
    points = m.vertices.select("id", F.col("x").alias("u"), F.col("y").alias("v"))
    tagged = _raster_at(spark, sf_dir, points).select("id", F.when(F.col("value") <= 100, 1).otherwise(2).alias("group"))
    return m, topology.tagged_triangles(m.triangles, tagged)


def mask_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)[1].withColumn("group", F.col("group").cast("long"))


def interface_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, groups = _groups(spark, sf_dir)
    return topology.interface_edges(m.triangles, groups)


def land_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, group, faces: connected parts of the grid with one group."""
    m, groups = _groups(spark, sf_dir)
    he = topology.half_edges(m.triangles)
    own = groups.select(F.col("id").alias("face"), F.col("group").alias("left"))
    other = groups.select(F.col("id").alias("twin_face"), F.col("group").alias("right"))
    same = he.join(own, "face").join(other, "twin_face").filter("left = right").select(F.col("face").alias("a"), F.col("twin_face").alias("b"))
    alone = groups.select(F.col("id").alias("a"), F.col("id").alias("b"))
    label = topology.components(same.unionByName(alone))
    return label.join(groups, "id").groupBy("label", F.col("group").cast("long").alias("group")).agg(F.count("*").alias("faces"))


def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topology.group_counts(_groups(spark, sf_dir)[1])
    return found.withColumn("group", F.col("group").cast("long"))


def extracted_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, groups = _groups(spark, sf_dir)
    return topology.extracted(m.triangles, groups.filter("group = 2"))[0]


def located_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's triangle of every customer's site, and where in it the site lies."""
    m = _grid(spark, sf_dir)
    t = topology.with_corners(m.triangles, m.vertices)
    n = sites.side(sites.table(spark, sf_dir, "customer"))
    found = neighbours.locate(sites.square_sites(spark, sf_dir), t, 1.0 / n)
    return found.select("id", "triangle", *_named(s=F.col("s"), t=F.col("t")))


def points_per_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.points_per_leaf(sites.sphere_sites(spark, sf_dir), 3)


def boundary_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's outline, chained: loop, place, p, q."""
    he = topology.half_edges(_grid(spark, sf_dir).triangles).filter("twin_face IS NULL")
    return topology.loops(he.select(F.col("node").alias("p"), F.col("next_node").alias("q"))).select("loop", "place", "p", "q")


def stiffness_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _grid(spark, sf_dir)
    return fem.stiffness(m.triangles, m.vertices).select("i", "j", R(F.col("value")).alias("value"))


def _bump(p: v.Vec):
    return F.sin(math.pi * p[0]) * F.sin(math.pi * p[1])


def load_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _grid(spark, sf_dir)
    return fem.load(m.triangles, m.vertices, _bump).select("i", R(F.col("value"), 9).alias("value"))


def quadrature_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _grid(spark, sf_dir)
    return fem.quadrature(m.triangles, m.vertices, _bump, 3).agg(R(F.sum("integral"), 9).alias("integral"))


def fem_l2_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _grid(spark, sf_dir)
    u = m.vertices.select(F.col("id").alias("i"), _bump(v.vec("x", "y", "z")).alias("value"))
    return fem.l2_error(m.triangles, m.vertices, u, _bump).select(R(F.col("error"), 9).alias("error"))


def ear_clipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles and their area of star-shaped polygons, one for every 16 customer keys."""
    c = sites.square_sites(spark, sf_dir)
    group = F.floor(F.col("id") / 16).cast("long")
    turn = (F.col("id") % 16) * (math.pi / 8)
    reach = 1 + F.col("x")
    corners = F.sort_array(F.collect_list(F.struct("id", (reach * F.cos(turn)).alias("x"), (reach * F.sin(turn)).alias("y"))))
    p = c.groupBy(group.alias("id")).agg(corners.alias("points"))
    t = polygons.triangulated(p).join(p, "id")
    corner = [(F.get("points", F.col(k).cast("int"))["x"], F.get("points", F.col(k).cast("int"))["y"]) for k in ("v0", "v1", "v2")]
    return t.groupBy("id").agg(F.count("*").alias("triangles"), R(F.sum(v.orient2d(*corner) / 2), 6).alias("area"))


def tensor_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues, determinant and square root of the suppliers' covariances of quantity and price."""
    li = sites.table(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    cov = li.groupBy(F.col("l_suppkey").alias("id")).agg(F.var_pop(x).alias("a"), F.covar_pop(x, y).alias("b"), F.var_pop(y).alias("c"))
    a, b, c = F.col("a") + 1, F.col("b"), F.col("c") + 1
    high, low = matrices.eigen2(a, b, c)
    root = matrices.of_symmetric2(a, b, c, F.sqrt)
    return cov.select("id", *_named(high=high, low=low, det=a * c - b * b), *[R(k, 5).alias(n) for k, n in zip(root, ("r11", "r12", "r22"), strict=True)])


def edge_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of a jittered grid after a round of flips that raise quality."""
    m = _grid(spark, sf_dir)
    n = sites.side(sites.table(spark, sf_dir, "customer"))
    inner = (F.col("x") > 0) & (F.col("x") < 1) & (F.col("y") > 0) & (F.col("y") < 1)
    moved = lambda c, p: F.when(inner, F.col(c) + ((F.col("id") * p % 101) / 101.0 - 0.5) * (0.7 / n)).otherwise(F.col(c)).alias(c)
    return adaptation.flip_round(m.triangles, m.vertices.select("id", moved("x", 37), moved("y", 53), "z"))


QUERIES = {
    f.__name__: f
    for f in (
        sphere_params, lon_lat, tangent_project, lift_sites, bounding_box, morton_order, knn_square, knn_sphere, nearest_site, relative_error,
        merge_vertices, spring_time, grid_triangles, grid_quads, polygon_fan, unique_edges, boundary_edges, half_edge_twins, vertex_valence,
        manifold_check, one_ring, obj_text, site_text, icosphere_areas, squircle_areas, raster_lookup, raster_binary, raster_periodic, raster_smooth,
        ear_clipping, tensor_functions, edge_flips, mask_tags, interface_edges, land_water, group_counts, extracted_mesh, located_points, points_per_leaf, boundary_loop, stiffness_matrix, load_vector, quadrature_integral, fem_l2_error,
    )
}

# --- SQL ---------------------------------------------------------------

_SPHERE = """s AS (
  SELECT id, a / n AS x, b / n AS y, c / n AS z, f, gx, gy, gz FROM (
    SELECT vec_id AS id, a, b, c, sqrt(a * a + b * b + c * c) AS n, f, gx, gy, gz FROM (
      SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c,
        CAST(embedding[4] AS DOUBLE) AS f, CAST(embedding[5] AS DOUBLE) AS gx, CAST(embedding[6] AS DOUBLE) AS gy, CAST(embedding[7] AS DOUBLE) AS gz
      FROM embeddings)))"""
_SQUARE = """c AS (SELECT c_custkey AS id, (c_custkey * 7919 % 10007) / 10007.0::DOUBLE AS x, (c_custkey * 104729 % 10009) / 10009.0::DOUBLE AS y, c_acctbal AS f FROM customer),
p AS (SELECT s_suppkey AS id, (s_suppkey * 7919 % 10007) / 10007.0::DOUBLE AS x, (s_suppkey * 104729 % 10009) / 10009.0::DOUBLE AS y, s_acctbal AS f FROM supplier)"""
_GRID = """n AS (SELECT greatest(2, CAST(floor(sqrt(count(*))) AS BIGINT)) AS n FROM customer),
mv AS (SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS id, c_acctbal / 20000 / n AS mv FROM customer, n),
vx AS (SELECT g.id, (g.id % (n + 1)) / n::DOUBLE + coalesce(mv, 0) AS x, (g.id // (n + 1)) / n::DOUBLE AS y, 0.0::DOUBLE AS z FROM n, unnest(range((n + 1) * (n + 1))) AS g(id) LEFT JOIN mv ON mv.id = g.id),
qd AS (SELECT id, f AS v0, f + 1 AS v1, f + n + 2 AS v2, f + n + 1 AS v3 FROM (SELECT id, n, (id // n) * (n + 1) + id % n AS f FROM n, unnest(range(n * n)) AS r(id))),
tr AS (SELECT id * 2 AS id, v0, v1, v3 AS v2 FROM qd UNION ALL SELECT id * 2 + 1, v1, v2, v3 FROM qd)"""
_EDGES = """e AS (SELECT id AS face, 0 AS k, v0 AS p, v1 AS q FROM tr UNION ALL SELECT id, 1, v1, v2 FROM tr UNION ALL SELECT id, 2, v2, v0 FROM tr)"""
_RASTER = """ra AS (SELECT event_id % 64 AS px, (event_id // 64) % 32 AS py, CAST(sum(CAST(floor(value) AS BIGINT)) % 256 AS BIGINT) AS value FROM events GROUP BY 1, 2)"""
_UV = "(atan2(y, x) + pi()) / (2 * pi()) AS u, 1 - acos(greatest(least(z, 1), -1)) / pi() AS v"
_PIX = "greatest(least(CAST(floor(u * 64) AS BIGINT), 63), 0) AS px, greatest(least(CAST(floor(v * 32) AS BIGINT), 31), 0) AS py"
_MASK = f"""vg AS (SELECT i.id, CASE WHEN value <= 100 THEN 1 ELSE 2 END AS grp FROM (SELECT id, {_PIX} FROM (SELECT id, x AS u, y AS v FROM vx)) i LEFT JOIN ra USING (px, py)),
tg AS (SELECT t.id, max(grp) AS grp FROM (SELECT id, unnest([v0, v1, v2]) AS vtx FROM tr) t JOIN vg ON vg.id = t.vtx GROUP BY t.id)"""


def _r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE"


def _knn(cte: str, left: str, right: str, k: int, axes: str, rank: bool) -> str:
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in axes)
    return f"""WITH {cte}, r AS (SELECT a.id, b.id AS neighbour, {d2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {d2}, b.id) - 1 AS rank FROM {left} a, {right} b)
SELECT id, {"rank, " if rank else ""}neighbour, {_r("d2", 9)} AS d2 FROM r WHERE rank < {k}"""


def _bits(c: str) -> str:
    """The bits of a 21-bit number at every third place, as a sum."""
    return f"list_sum(list_transform(range(21), lambda bit: CAST((({c}) >> bit) & 1 AS BIGINT) << (3 * bit)))::BIGINT"


_CORNERS = "ct AS (SELECT tr.*, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, c.x AS cx, c.y AS cy FROM tr JOIN vx a ON a.id = v0 JOIN vx b ON b.id = v1 JOIN vx c ON c.id = v2)"
_AREA = "(0.5 * abs((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)))"


def _at(s: str, t: str) -> str:
    return f"sin(pi() * (ax * (1 - {s} - {t}) + bx * {s} + cx * {t})) * sin(pi() * (ay * (1 - {s} - {t}) + b_y * {s} + cy * {t}))"


SQL = {
    "sphere_params": f"WITH {_SPHERE} SELECT id, {_r('u')} AS u, {_r('v')} AS v FROM (SELECT id, {_UV} FROM s)",
    "lon_lat": f"WITH {_SPHERE} SELECT id, {_r('atan2(y, x)')} AS lon, {_r('asin(greatest(least(z, 1), -1))')} AS lat FROM s",
    "tangent_project": f"WITH {_SPHERE}, d AS (SELECT *, gx * x + gy * y + gz * z AS d FROM s) SELECT id, {_r('gx - x * d')} AS tx, {_r('gy - y * d')} AS ty, {_r('gz - z * d')} AS tz FROM d",
    "lift_sites": f"WITH {_SPHERE} SELECT id, {_r('sqrt(greatest(0, (SELECT max(f) FROM s) - f))')} AS w4 FROM s",
    "bounding_box": f"WITH {_SPHERE} SELECT " + ", ".join(f"{_r(f'{f}({a})')} AS {f}_{a}" for a in "xyz" for f in ("min", "max")) + " FROM s",
    "morton_order": f"""WITH {_SPHERE}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM s),
q AS (SELECT id, CAST(floor(greatest(least((x - x0) / (x1 - x0) * 2091752, 2091752), 0)) AS BIGINT) AS i, CAST(floor(greatest(least((y - y0) / (y1 - y0) * 2091752, 2091752), 0)) AS BIGINT) AS j,
  CAST(floor(greatest(least((z - z0) / (z1 - z0) * 2091752, 2091752), 0)) AS BIGINT) AS k FROM s, b),
m AS (SELECT id, 4 * {_bits("i")} + 2 * {_bits("j")} + {_bits("k")} AS morton FROM q)
SELECT id, morton, row_number() OVER (ORDER BY morton, id) - 1 AS place FROM m""",
    "points_per_leaf": f"""WITH {_SPHERE}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM s),
q AS (SELECT id, CAST(floor(greatest(least((x - x0) / (x1 - x0) * 2091752, 2091752), 0)) AS BIGINT) AS i, CAST(floor(greatest(least((y - y0) / (y1 - y0) * 2091752, 2091752), 0)) AS BIGINT) AS j,
  CAST(floor(greatest(least((z - z0) / (z1 - z0) * 2091752, 2091752), 0)) AS BIGINT) AS k FROM s, b),
m AS (SELECT id, 4 * {_bits("i")} + 2 * {_bits("j")} + {_bits("k")} AS morton FROM q)
SELECT morton >> 54 AS leaf, count(*) AS points FROM m GROUP BY 1""",
    "knn_square": _knn(_SQUARE, "c", "c", 8, "xy", True),
    "knn_sphere": _knn(_SPHERE, "s", "s", 8, "xyz", True),
    "nearest_site": _knn(_SQUARE, "c", "p", 1, "xy", False),
    "relative_error": f"""WITH {_SQUARE}, r AS (SELECT a.f, b.f AS g, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS k FROM c a, p b)
SELECT {_r("sqrt(sum((f - g) * (f - g)) / sum(f * f))")} AS error FROM r WHERE k = 1""",
    "merge_vertices": f"""WITH RECURSIVE {_SQUARE}, l AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.01 * 0.01),
reach(id, seen) AS (SELECT id, id FROM c UNION SELECT l.b, r.seen FROM reach r JOIN l ON l.a = r.id)
SELECT id, min(seen) AS "to" FROM reach GROUP BY id""",
    "spring_time": """WITH t AS (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS s FROM events)
SELECT event_id, printf('%03d:%02d:%02d', s // 86400, (s // 3600) % 24, (s // 60) % 60) AS clock FROM t""",
    "grid_triangles": f"""WITH {_GRID}, {_CORNERS} SELECT id, v0, v1, v2, {_r(_AREA, 9)} AS area,
  {_r(f"4 * sqrt(3) * {_AREA} / ((bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay)+(cx-bx)*(cx-bx)+(cy-b_y)*(cy-b_y)+(ax-cx)*(ax-cx)+(ay-cy)*(ay-cy))")} AS quality FROM ct""",
    "grid_quads": f"WITH {_GRID} SELECT * FROM qd",
    "polygon_fan": f"WITH {_GRID} SELECT id AS polygon, 1::BIGINT AS k, v0, v1, v2 FROM qd UNION ALL SELECT id, 2, v0, v2, v3 FROM qd",
    "unique_edges": f"WITH {_GRID}, {_EDGES} SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM e",
    "boundary_edges": f"WITH {_GRID}, {_EDGES} SELECT least(p, q) AS a, greatest(p, q) AS b FROM e GROUP BY 1, 2 HAVING count(*) % 2 = 1",
    "half_edge_twins": f"WITH {_GRID}, {_EDGES} SELECT e.face, CAST(e.k AS BIGINT) AS k, e.p AS node, t.face AS twin_face, e.q AS next_node FROM e LEFT JOIN e t ON t.p = e.q AND t.q = e.p",
    "vertex_valence": f"WITH {_GRID}, {_EDGES}, u AS (SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM e) SELECT vertex, count(*) AS valence FROM (SELECT unnest([a, b]) AS vertex FROM u) GROUP BY vertex",
    "manifold_check": f"""WITH {_GRID}, {_EDGES}, u AS (SELECT least(p, q) AS a, greatest(p, q) AS b, count(*) AS n FROM e GROUP BY 1, 2)
SELECT count(*) AS edges, count(*) FILTER (n = 1) AS boundary, count(*) FILTER (n > 2) AS non_manifold, count(*) FILTER (a = b) AS zero_length FROM u""",
    "one_ring": f"WITH {_GRID}, {_EDGES} SELECT p AS vertex, array_to_string(list_sort(list(DISTINCT face)), ',') AS faces FROM e GROUP BY p",
    "obj_text": f"""WITH {_GRID} SELECT 0::BIGINT AS kind, id, printf('v %.10f %.10f %.10f', x, y, z) AS line FROM vx
UNION ALL SELECT 1, id, printf('f %d %d %d', v0 + 1, v1 + 1, v2 + 1) FROM tr""",
    "ear_clipping": f"""WITH {_SQUARE}, q AS (SELECT id // 16 AS g, id, (1 + x) * cos((id % 16) * (pi() / 8)) AS px, (1 + x) * sin((id % 16) * (pi() / 8)) AS py FROM c),
o AS (SELECT *, coalesce(lead(px) OVER w, first_value(px) OVER w) AS nx, coalesce(lead(py) OVER w, first_value(py) OVER w) AS ny, count(*) OVER (PARTITION BY g) AS n FROM q WINDOW w AS (PARTITION BY g ORDER BY id))
SELECT g AS id, max(n) - 2 AS triangles, {_r("sum(px * ny - nx * py) / 2")} AS area FROM o GROUP BY g HAVING max(n) >= 3""",
    "tensor_functions": f"""WITH t AS (SELECT l_suppkey AS id, var_pop(l_quantity) + 1 AS a, covar_pop(l_quantity, l_extendedprice / 1000) AS b, var_pop(l_extendedprice / 1000) + 1 AS c FROM lineitem GROUP BY 1),
e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS high, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS low FROM t),
s AS (SELECT *, sqrt(a * c - b * b) AS root FROM e)
SELECT id, {_r("high")} AS high, {_r("low")} AS low, {_r("a * c - b * b")} AS det,
  {_r("(a + root) / sqrt(a + c + 2 * root)", 5)} AS r11, {_r("b / sqrt(a + c + 2 * root)", 5)} AS r12, {_r("(c + root) / sqrt(a + c + 2 * root)", 5)} AS r22 FROM s""",
    "raster_lookup": f"WITH {_SPHERE}, {_RASTER} SELECT i.id, ra.value FROM (SELECT id, {_PIX} FROM (SELECT id, {_UV} FROM s)) i LEFT JOIN ra USING (px, py)",
    "raster_binary": f"WITH {_RASTER} SELECT px, py, CAST(greatest(least(CASE WHEN value <= 100 THEN 10 ELSE 255 END, 200), 20) AS BIGINT) AS value FROM ra",
    "raster_periodic": f"WITH {_RASTER} SELECT px, py, CASE WHEN px = 0 THEN arg_max(value, px) OVER (PARTITION BY py) ELSE value END AS value FROM ra",
    "raster_smooth": f"""WITH {_RASTER}, m AS (SELECT a.px, a.py, CAST(floor(avg(b.value)) AS BIGINT) AS mean FROM ra a JOIN ra b ON abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1 AND (a.px <> b.px OR a.py <> b.py) GROUP BY 1, 2)
SELECT px, py, CASE WHEN px BETWEEN 1 AND 62 AND py BETWEEN 1 AND 30 THEN mean ELSE value END AS value FROM ra LEFT JOIN m USING (px, py)""",
    "mask_tags": f'WITH {_GRID}, {_RASTER}, {_MASK} SELECT id, CAST(grp AS BIGINT) AS "group" FROM tg',
    "group_counts": f'WITH {_GRID}, {_RASTER}, {_MASK} SELECT CAST(grp AS BIGINT) AS "group", count(*) AS faces, grp = (SELECT max(grp) FROM tg) AS largest FROM tg GROUP BY grp',
    "extracted_mesh": f"""WITH {_GRID}, {_RASTER}, {_MASK}, k AS (SELECT tr.* FROM tr JOIN tg USING (id) WHERE grp = 2),
u AS (SELECT was, row_number() OVER (ORDER BY was) - 1 AS id FROM (SELECT DISTINCT unnest([v0, v1, v2]) AS was FROM k))
SELECT row_number() OVER (ORDER BY k.id) - 1 AS id, a.id AS v0, b.id AS v1, c.id AS v2 FROM k JOIN u a ON a.was = v0 JOIN u b ON b.was = v1 JOIN u c ON c.was = v2""",
    "located_points": f"""WITH {_GRID}, {_CORNERS}, {_SQUARE},
b AS (SELECT c.id, ct.id AS triangle, ((x - ax) * (cy - ay) - (y - ay) * (cx - ax)) / ((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)) AS s,
    ((bx - ax) * (y - ay) - (b_y - ay) * (x - ax)) / ((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)) AS t FROM c, ct WHERE x BETWEEN least(ax, bx, cx) AND greatest(ax, bx, cx)),
f AS (SELECT id, min(triangle) AS triangle, arg_min(s, triangle) AS s, arg_min(t, triangle) AS t FROM b WHERE s >= 0 AND t >= 0 AND s + t <= 1 GROUP BY id)
SELECT c.id, triangle, {_r("s")} AS s, {_r("t")} AS t FROM c LEFT JOIN f USING (id)""",
    "interface_edges": f"WITH {_GRID}, {_EDGES}, {_RASTER}, {_MASK} SELECT e.p, e.q FROM e JOIN e t ON t.p = e.q AND t.q = e.p JOIN tg a ON a.id = e.face JOIN tg b ON b.id = t.face WHERE a.grp < b.grp",
    "land_water": f"""WITH RECURSIVE {_GRID}, {_EDGES}, {_RASTER}, {_MASK},
l AS (SELECT e.face AS a, t.face AS b FROM e JOIN e t ON t.p = e.q AND t.q = e.p JOIN tg x ON x.id = e.face JOIN tg y ON y.id = t.face WHERE x.grp = y.grp),
reach(id, seen) AS (SELECT id, id FROM tg UNION SELECT l.b, r.seen FROM reach r JOIN l ON l.a = r.id WHERE l.b > r.seen),
c AS (SELECT id, min(seen) AS label FROM reach GROUP BY id)
SELECT label, CAST(grp AS BIGINT) AS "group", count(*) AS faces FROM c JOIN tg USING (id) GROUP BY 1, 2""",
    "boundary_loop": f"""WITH RECURSIVE {_GRID}, {_EDGES}, o AS (SELECT e.p, e.q FROM e LEFT JOIN e t ON t.p = e.q AND t.q = e.p WHERE t.face IS NULL),
w(p, q, place) AS (SELECT p, q, 0::BIGINT FROM o WHERE p = 0 UNION ALL SELECT o.p, o.q, w.place + 1 FROM w JOIN o ON o.p = w.q WHERE o.p <> 0)
SELECT 0::BIGINT AS loop, place, p, q FROM w""",
    "stiffness_matrix": f"""WITH {_GRID}, {_CORNERS}, g AS (SELECT v0, v1, v2, abs((bx-ax)*(cy-ay)-(b_y-ay)*(cx-ax)) AS t, [b_y-cy, cy-ay, ay-b_y] AS gx, [cx-bx, ax-cx, bx-ax] AS gy FROM ct),
x AS (SELECT [v0, v1, v2][p] AS i, [v0, v1, v2][q] AS j, (gx[p] * gx[q] + gy[p] * gy[q]) / (2 * t) AS w FROM g, unnest(range(1, 4)) AS r(p), unnest(range(1, 4)) AS u(q))
SELECT i, j, {_r("sum(w)")} AS value FROM x GROUP BY i, j""",
    "load_vector": f"""WITH {_GRID}, {_CORNERS}, t AS (SELECT v0, v1, v2, {_AREA} * {_at("(1.0::DOUBLE/3)", "(1.0::DOUBLE/3)")} / 3 AS w FROM ct)
SELECT i, {_r("sum(w)", 9)} AS value FROM (SELECT unnest([v0, v1, v2]) AS i, w FROM t) GROUP BY i""",
    "quadrature_integral": f"""WITH {_GRID}, {_CORNERS} SELECT {_r("sum(" + _AREA + " * (-27.0::DOUBLE/48 * " + _at("(1.0::DOUBLE/3)", "(1.0::DOUBLE/3)") + " + 25.0::DOUBLE/48 * (" + _at("0.2", "0.2") + " + " + _at("0.6", "0.2") + " + " + _at("0.2", "0.6") + ")))", 9)} AS integral FROM ct""",
    "fem_l2_error": f"""WITH {_GRID}, {_CORNERS}, w AS (SELECT *, sin(pi()*ax)*sin(pi()*ay) AS u0, sin(pi()*bx)*sin(pi()*b_y) AS u1, sin(pi()*cx)*sin(pi()*cy) AS u2 FROM ct)
SELECT {_r("sqrt(sum(" + _AREA + " / 3 * (" + " + ".join(f"power(u0 * (1 - {s} - {t}) + u1 * {s} + u2 * {t} - {_at(s, t)}, 2)" for s, t in (("(1.0::DOUBLE/6)", "(1.0::DOUBLE/6)"), ("(2.0::DOUBLE/3)", "(1.0::DOUBLE/6)"), ("(1.0::DOUBLE/6)", "(2.0::DOUBLE/3)"))) + ")))", 9)} AS error FROM w""",
}
