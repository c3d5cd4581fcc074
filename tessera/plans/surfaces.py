"""Queries on diagrams as meshes, merged regions, samples and fields on triangles, and small dense matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import matrices
from tessera.functions import vectors as v
from tessera.operators import adaptation, fem, neighbours, topology, voronoi
from tessera.plans.geometry import _CORNERS, _EDGES, _GRID, _MASK, _PIX, _RASTER, _SPHERE, _SQUARE, _UV, _bump, _grid, _groups, _r, _raster_at
from tessera.sources import sampling, sites

R = v.rounded
LEAST, MOST = 0.01, 0.05


def diagram_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices that the cells of the sphere's sites share, each with its three cells."""
    vertices, _ = voronoi.shared_mesh(voronoi.diagram(sites.sphere_sites(spark, sf_dir)))
    return vertices.select("id", "i", "j", "k", *[R(F.col(c), 9).alias(c) for c in "xyz"])


def diagram_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells' polygons over shared vertices, from the least one on."""
    _, polygons = voronoi.shared_mesh(voronoi.diagram(sites.sphere_sites(spark, sf_dir)))
    start = F.array_position("vertices", F.array_min("vertices")).cast("int")
    turned = F.concat(F.slice("vertices", start, F.size("vertices")), F.slice("vertices", F.lit(1), start - 1))
    return polygons.select(F.col("id").alias("site"), F.array_join(turned, ",").alias("vertices"))


def diagram_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = voronoi.statistics(voronoi.diagram(sites.sphere_sites(spark, sf_dir)))
    return found.select("cells", "incomplete", "corners", R(F.col("area")).alias("area"), R(F.col("radius")).alias("radius"))


def dual_graph_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 nearest sites within two steps over the diagram's facets."""
    s = sites.sphere_sites(spark, sf_dir)
    links = voronoi.facets(voronoi.diagram(s)).filter("bj IS NOT NULL").select(F.col("bi").alias("a"), F.col("bj").alias("b"))
    found = neighbours.over_graph(s, links, 12, 2)
    return found.select("id", F.col("rank").cast("long").alias("rank"), "neighbour", R(F.col("d2"), 9).alias("d2"))


def region_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outlines of the grid's triangles merged by group: every outer edge p, q and the vertex r that follows."""
    m, groups = _groups(spark, sf_dir)
    found = topology.outlines(m.triangles, groups.select("id", F.col("group").cast("long").alias("label")))
    return found.select(F.col("label").alias("group"), "p", "q", "r")


def edge_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the grid and the length that the raster's sizes at their ends ask for."""
    m = _grid(spark, sf_dir)
    at = _raster_at(spark, sf_dir, m.vertices.select("id", F.col("x").alias("u"), F.col("y").alias("v")))
    size = at.select("id", adaptation.wanted_size(F.col("value"), LEAST, MOST).alias("h"))
    e = topology.unique_edges(m.triangles)
    for c in "ab":
        e = e.join(size.select(F.col("id").alias(c), F.col("h").alias(f"h{c}")), c)
    return e.select("a", "b", R(adaptation.size_between(F.col("ha"), F.col("hb")), 9).alias("size"))


def surface_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point of the grid for every order."""
    m = _grid(spark, sf_dir)
    ids = sites.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    found = sampling.on_surface(ids, m.triangles, m.vertices)
    return found.select("id", "triangle", *[R(F.col(c), 9).alias(c) for c in "xyz"])


def ocean_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites of the sphere where the raster is not land."""
    found = sampling.where_raster(sites.sphere_sites(spark, sf_dir), sites.raster(spark, sf_dir), sites.RASTER_WIDTH, sites.RASTER_HEIGHT, 50)
    return found.select("id", *[R(F.col(c), 9).alias(c) for c in "xyz"])


def _grid_values(spark: SparkSession, sf_dir: str, vertices: DataFrame) -> DataFrame:
    """i, value: at each vertex of the grid the raster's value."""
    at = _raster_at(spark, sf_dir, vertices.select("id", F.col("x").alias("u"), F.col("y").alias("v")))
    return at.select(F.col("id").alias("i"), F.col("value").cast("double").alias("value"))


def triangle_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _grid(spark, sf_dir)
    found = fem.triangle_gradients(m.triangles, m.vertices, _grid_values(spark, sf_dir, m.vertices))
    return found.select("id", R(F.col("gx"), 3).alias("gx"), R(F.col("gy"), 3).alias("gy"))


def vertex_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _grid(spark, sf_dir)
    found = fem.vertex_gradients(m.triangles, m.vertices, _grid_values(spark, sf_dir, m.vertices))
    return found.select("id", R(F.col("gx"), 3).alias("gx"), R(F.col("gy"), 3).alias("gy"))


def field_at_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function at the six nodes of second order of each of the grid's triangles."""
    m = _grid(spark, sf_dir)
    return fem.at_nodes(m.triangles, m.vertices, 2, _bump).select("id", "node", R(F.col("value"), 9).alias("value"))


def adapted_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's triangles after a round of adaptation to the raster's sizes, half to twice its spacing."""
    m = _grid(spark, sf_dir)
    step = 1.0 / sites.side(sites.table(spark, sf_dir, "customer"))

    def size(p: DataFrame) -> DataFrame:
        at = _raster_at(spark, sf_dir, p.select("id", F.col("x").alias("u"), F.col("y").alias("v")))
        return at.select("id", adaptation.wanted_size(F.col("value"), step / 2, step * 2).alias("h"))

    t, p = adaptation.adapted(m.triangles, m.vertices, size, 1)
    a, b, c = topology.corner_vectors()
    return topology.with_corners(t, p).select("id", "v0", "v1", "v2", R(v.planar_area(a, b, c), 9).alias("area"))


_FIELDS = ("l_quantity / 10", "l_extendedprice / 10000", "l_discount * 100", "l_tax * 100")


def covariance_inverses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Determinant, trace and inverse of the suppliers' covariances of four columns of their line items, plus 1 on the diagonal."""
    li = sites.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), *[F.expr(f).alias(f"f{k}") for k, f in enumerate(_FIELDS)])
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    cov = li.groupBy("id").agg(*[F.covar_pop(f"f{i}", f"f{j}").alias(f"c{i}{j}") for i, j in pairs])
    m = [[F.col(f"c{min(i, j)}{max(i, j)}") + (1.0 if i == j else 0.0) for j in range(4)] for i in range(4)]
    back = matrices.inverse(m)
    return cov.select("id", R(matrices.determinant(m), 3).alias("det"), R(matrices.trace(m)).alias("trace"), *[R(back[i][j]).alias(f"i{i}{j}") for i, j in pairs])


def covariance_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues of the suppliers' covariances of three columns of their line items, plus 1 on the diagonal."""
    li = sites.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), *[F.expr(f).alias(f"f{k}") for k, f in enumerate(_FIELDS[:3])])
    cov = li.groupBy("id").agg(*[F.covar_pop(f"f{i}", f"f{j}").alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)])
    found = matrices.eigen3([[F.col(f"c{min(i, j)}{max(i, j)}") + (1.0 if i == j else 0.0) for j in range(3)] for i in range(3)])
    return cov.select("id", *[R(e).alias(n) for e, n in zip(found, ("high", "middle", "low"), strict=True)])


QUERIES = {
    f.__name__: f
    for f in (
        diagram_vertices, diagram_polygons, diagram_statistics, dual_graph_knn, region_outlines, edge_sizes, surface_samples, ocean_sites,
        triangle_gradients, vertex_gradients, field_at_nodes, covariance_inverses, covariance_eigenvalues, adapted_grid,
    )
}

# --- SQL ---------------------------------------------------------------
# A corner of a site's cell is the point at the same distance from it and two others to which no other is nearer.
# The others are looked for among the site's 32 nearest, which is enough where sites are spread evenly.

_D3 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
def _ball(s: str = "s", n: str = "", weight: str = "0.0::DOUBLE") -> str:
    """The corners (vt) and facets (fc) of the cells of the sites s; the weight of a site is an expression over it."""
    w = weight.format
    return f"""
nb{n} AS (SELECT * FROM (SELECT a.id, b.id AS o, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, ({w("a.")} - {w("b.")}) / 2 AS g, row_number() OVER (PARTITION BY a.id ORDER BY {_D3}, b.id) AS r FROM {s} a JOIN {s} b ON a.id <> b.id) WHERE r <= 32),
cr{n} AS (SELECT a.id, a.o AS j, b.o AS k, a.dx AS ax, a.dy AS ay, a.dz AS az, b.dx AS bx, b.dy AS b_y, b.dz AS bz, a.g AS ag, b.g AS bg,
  a.dy * b.dz - a.dz * b.dy AS nx, a.dz * b.dx - a.dx * b.dz AS ny, a.dx * b.dy - a.dy * b.dx AS nz FROM nb{n} a JOIN nb{n} b ON a.id = b.id AND a.o < b.o),
cp{n} AS (SELECT *, nx * nx + ny * ny + nz * nz AS d, (ag * (b_y * nz - bz * ny) + bg * (ny * az - nz * ay)) AS hx, (ag * (bz * nx - bx * nz) + bg * (nz * ax - nx * az)) AS hy, (ag * (bx * ny - b_y * nx) + bg * (nx * ay - ny * ax)) AS hz FROM cr{n}),
cv{n} AS (SELECT c.id, j, k, hx / d + nx * g AS vx, hy / d + ny * g AS vy, hz / d + nz * g AS vz FROM (SELECT cp.*, sign(nx * x + ny * y + nz * z) * sqrt((1 - (hx * hx + hy * hy + hz * hz) / (d * d)) / d) AS g FROM cp{n} cp JOIN {s} USING (id)
  WHERE hx * hx + hy * hy + hz * hz <= d * d) c),
vt{n} AS (SELECT c.id, j, k, any_value(vx) AS vx, any_value(vy) AS vy, any_value(vz) AS vz FROM cv{n} c JOIN nb{n} USING (id) GROUP BY c.id, j, k
  HAVING max(CASE WHEN o IN (j, k) THEN 0 ELSE vx * dx + vy * dy + vz * dz - g END) <= 1e-14),
en{n} AS (SELECT id, unnest([j, k]) AS o, vx, vy, vz FROM vt{n}),
fc{n} AS (SELECT id, o, arg_min(vx, vx) AS px, arg_min(vy, vx) AS py, arg_min(vz, vx) AS pz, arg_max(vx, vx) AS qx, arg_max(vy, vx) AS qy, arg_max(vz, vx) AS qz FROM en{n} GROUP BY id, o HAVING count(*) = 2)"""


def _measured(s: str = "s", n: str = "") -> str:
    """The volume and moment (m) of each cell, which holds its site."""
    return f"""
w{n} AS (SELECT f.*, x, y, z, py * qz - pz * qy AS cx, pz * qx - px * qz AS cy, px * qy - py * qx AS cz, px * qx + py * qy + pz * qz AS pq FROM fc{n} f JOIN {s} USING (id)),
e{n} AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS c, x * cx + y * cy + z * cz AS up, x * px + y * py + z * pz AS a, x * qx + y * qy + z * qz AS b FROM w{n}),
m{n} AS (SELECT id, sum(2 * atan2(abs(up), 1 + a + b + pq)) AS volume, {", ".join(f"sum(0.5 * atan2(c, pq) * sign(up) * c{k} / c) AS m{k}" for k in "xyz")}, count(*) AS corners FROM e{n} GROUP BY id)"""


def _moved(n: str, to: str) -> str:
    """The sites at the middles of their cells."""
    return f"{to} AS (SELECT id, " + ", ".join(f"m{k} / sqrt(mx * mx + my * my + mz * mz) AS {k}" for k in "xyz") + f" FROM m{n})"


_BALL = f"""{_SPHERE}, {_ball()},
dv AS (SELECT DISTINCT ON (t) t, id, vx, vy, vz FROM (SELECT list_sort([id, j, k]) AS t, * FROM vt) ORDER BY t, id),
dn AS (SELECT row_number() OVER (ORDER BY t) - 1 AS vid, * FROM dv)"""
_CELLS = f"{_BALL}, {_measured()}"
# On the square a cell is cut by its site's bisectors and by the four sides: nx * vx + ny * vy <= g, from the site.
_FLAT = f"""{_SQUARE},
nb AS (SELECT id, o, nx, ny, (nx * nx + ny * ny) / 2 AS g FROM (SELECT a.id, b.id AS o, b.x - a.x AS nx, b.y - a.y AS ny, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS r FROM c a JOIN c b ON a.id <> b.id) WHERE r <= 32
  UNION ALL SELECT id, -1, -1, 0, x FROM c UNION ALL SELECT id, -2, 1, 0, 1 - x FROM c UNION ALL SELECT id, -3, 0, -1, y FROM c UNION ALL SELECT id, -4, 0, 1, 1 - y FROM c),
cr AS (SELECT a.id, a.o AS j, b.o AS k, a.nx AS ax, a.ny AS ay, a.g AS ag, b.nx AS bx, b.ny AS b_y, b.g AS bg, a.nx * b.ny - a.ny * b.nx AS d FROM nb a JOIN nb b ON a.id = b.id AND a.o < b.o),
cv AS (SELECT id, j, k, (ag * b_y - bg * ay) / d AS vx, (ax * bg - bx * ag) / d AS vy FROM cr WHERE abs(d) > 1e-15),
vt AS (SELECT cv.id, j, k, any_value(vx) AS vx, any_value(vy) AS vy FROM cv JOIN nb USING (id) GROUP BY cv.id, j, k HAVING max(CASE WHEN o IN (j, k) THEN 0 ELSE vx * nx + vy * ny - g END) <= 1e-13),
en AS (SELECT id, unnest([j, k]) AS o, vx, vy FROM vt),
fc AS (SELECT id, o, arg_min(vx, (vx, vy)) AS px, arg_min(vy, (vx, vy)) AS py, arg_max(vx, (vx, vy)) AS qx, arg_max(vy, (vx, vy)) AS qy FROM en GROUP BY id, o HAVING count(*) >= 2),
tr AS (SELECT id, x, y, px, py, qx, qy, 0.5 * abs(px * qy - py * qx) AS t FROM fc JOIN c USING (id))"""


def _uniform(salt: int, key: str = "o_orderkey") -> str:
    h = f"({key} % {sampling.PRIME})"
    for k in (48271 + salt, 69621):
        h = f"list_transform([{h}], lambda h: ((h * h) % {sampling.PRIME} * {k} + h * 16807 + {salt + 1}) % {sampling.PRIME})[1]"
    return f"({h} / {float(sampling.PRIME)}::DOUBLE)"


def _eliminated(n: int = 4) -> str:
    """Steps of Gauss-Jordan elimination on the rows of [A | 1], without pivoting as A is definite; det is the product of the pivots."""
    steps = ["g0 AS (SELECT id, 1.0::DOUBLE AS det, " + ", ".join(f"m{min(i, j)}{max(i, j)} AS a{i}{j}" for i in range(n) for j in range(n)) + ", " + ", ".join(f"{float(i == j)}::DOUBLE AS b{i}{j}" for i in range(n) for j in range(n)) + " FROM cv)"]
    for k in range(n):
        cell = lambda c, i, j: f"{c}{k}{j} / a{k}{k} AS {c}{i}{j}" if i == k else f"{c}{i}{j} - a{i}{k} * {c}{k}{j} / a{k}{k} AS {c}{i}{j}"  # noqa: E731, B023
        steps.append(f"g{k + 1} AS (SELECT id, det * a{k}{k} AS det, " + ", ".join(cell(c, i, j) for c in "ab" for i in range(n) for j in range(n)) + f" FROM g{k})")
    return ", ".join(steps)


_VALUES = f"vv AS (SELECT i.id, ra.value::DOUBLE AS h FROM (SELECT id, {_PIX} FROM (SELECT id, x AS u, y AS v FROM vx)) i LEFT JOIN ra USING (px, py))"
_SLOPES = f"""{_GRID}, {_CORNERS}, {_RASTER}, {_VALUES},
u AS (SELECT ct.*, p.h AS u0, q.h AS u1, r.h AS u2, (bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax) AS d FROM ct JOIN vv p ON p.id = v0 JOIN vv q ON q.id = v1 JOIN vv r ON r.id = v2),
gr AS (SELECT id, v0, v1, v2, ((u1 - u0) * (cy - ay) - (u2 - u0) * (b_y - ay)) / d AS gx, ((u2 - u0) * (bx - ax) - (u1 - u0) * (cx - ax)) / d AS gy FROM u)"""
_NODES = [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0), (0.0, 0.5), (0.5, 0.5), (0.0, 1.0)]

SQL = {
    "voronoi_sphere_cells": f"WITH {_CELLS} SELECT id AS site, {_r('volume', 9)} AS volume, {', '.join(_r(f'm{k}', 9) + f' AS m{k}' for k in 'xyz')}, CAST(corners AS INTEGER) AS corners FROM m",
    "voronoi_sphere_facets": f"""WITH {_BALL}, h AS (SELECT *, (px + qx) AS sx, (py + qy) AS sy, (pz + qz) AS sz FROM fc WHERE id < o), g AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS n FROM h)
SELECT id AS bi, o AS bj, {_r('2 * atan2(sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy) + (pz - qz) * (pz - qz)), n)', 9)} AS length, {', '.join(_r(f's{k} / n', 9) + f' AS m{k}' for k in 'xyz')} FROM g""",
    "voronoi_sphere_delaunay": f"WITH {_BALL} SELECT t[1] AS i, t[2] AS j, t[3] AS k FROM dv",
    "voronoi_square_cells": f"WITH {_FLAT} SELECT id AS site, {_r('sum(t)', 9)} AS volume, {_r('sum(t * (x + (px + qx) / 3))', 9)} AS mx, {_r('sum(t * (y + (py + qy) / 3))', 9)} AS my FROM tr GROUP BY id",
    # A cell of a power diagram may not hold its site, but it holds the middle of its corners.
    "power_sphere_cells": f"""WITH {_SPHERE}, {_ball(weight="0.01 * abs({}z)")}, su AS (SELECT id, sum(vx) AS x, sum(vy) AS y, sum(vz) AS z FROM vt GROUP BY id),
mid AS (SELECT id, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM su), {_measured("mid")}
SELECT s.id AS site, {_r("coalesce(volume, 0)", 9)} AS volume FROM s LEFT JOIN m USING (id)""",
    "lloyd_sphere": f"WITH {_SPHERE}, {_ball()}, {_measured()}, {_moved('', 's1')}, {_ball('s1', '1')}, {_measured('s1', '1')}, {_moved('1', 's2')} SELECT id, {_r('x', 9)} AS x, {_r('y', 9)} AS y, {_r('z', 9)} AS z FROM s2",
    "diagram_vertices": f"WITH {_BALL} SELECT vid AS id, t[1] AS i, t[2] AS j, t[3] AS k, {_r('vx', 9)} AS x, {_r('vy', 9)} AS y, {_r('vz', 9)} AS z FROM dn",
    "diagram_polygons": f"""WITH {_BALL}, o AS (SELECT v.id, vid, x, y, z, v.vx, v.vy, v.vz, first_value(v.vx) OVER f AS fx, first_value(v.vy) OVER f AS fy, first_value(v.vz) OVER f AS fz
  FROM vt v JOIN dn ON t = list_sort([v.id, j, k]) JOIN s ON s.id = v.id WINDOW f AS (PARTITION BY v.id ORDER BY vid)),
b AS (SELECT *, fx - x * (fx * x + fy * y + fz * z) AS ex, fy - y * (fx * x + fy * y + fz * z) AS ey, fz - z * (fx * x + fy * y + fz * z) AS ez FROM o),
l AS (SELECT id, vid, atan2(vx * (y * ez - z * ey) + vy * (z * ex - x * ez) + vz * (x * ey - y * ex), vx * ex + vy * ey + vz * ez) AS turn FROM b)
SELECT id AS site, string_agg(vid, ',' ORDER BY CASE WHEN turn < -1e-9 THEN turn + 2 * pi() ELSE turn END) AS vertices FROM l GROUP BY id""",
    "diagram_statistics": f"""WITH {_CELLS}, f AS (SELECT max(sqrt((vx - x) * (vx - x) + (vy - y) * (vy - y) + (vz - z) * (vz - z))) AS radius FROM vt JOIN s USING (id))
SELECT count(*) AS cells, 0::BIGINT AS incomplete, CAST(sum(corners) AS BIGINT) AS corners, {_r('4 * pi()')} AS area, {_r('any_value(radius)')} AS radius FROM m, f""",
    "dual_graph_knn": f"""WITH {_BALL}, l AS (SELECT id, o FROM fc), l2 AS (SELECT id, o FROM l UNION SELECT a.id, b.o FROM l a JOIN l b ON a.o = b.id WHERE a.id <> b.o),
k AS (SELECT a.id, b.id AS neighbour, {_D3} AS d2 FROM l2 JOIN s a ON a.id = l2.id JOIN s b ON b.id = l2.o),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, neighbour) - 1 AS rank FROM k) SELECT id, rank, neighbour, {_r('d2', 9)} AS d2 FROM r WHERE rank < 12""",
    "region_outlines": f"""WITH RECURSIVE {_GRID}, {_EDGES}, {_RASTER}, {_MASK},
h AS (SELECT e.face, e.k, e.p, e.q, a.grp, t.face AS tf, t.k AS tk FROM e JOIN tg a ON a.id = e.face LEFT JOIN (SELECT x.*, y.grp FROM e x JOIN tg y ON y.id = x.face) t ON t.p = e.q AND t.q = e.p AND t.grp = a.grp),
w(f0, k0, f, k) AS (SELECT face, k, face, (k + 1) % 3 FROM h WHERE tf IS NULL UNION ALL SELECT f0, k0, h.tf, (h.tk + 1) % 3 FROM w JOIN h ON h.face = w.f AND h.k = w.k WHERE h.tf IS NOT NULL)
SELECT CAST(o.grp AS BIGINT) AS "group", o.p, o.q, n.q AS r FROM w JOIN h o ON o.face = f0 AND o.k = k0 JOIN h n ON n.face = w.f AND n.k = w.k WHERE n.tf IS NULL""",
    "edge_sizes": f"""WITH {_GRID}, {_EDGES}, {_RASTER}, {_VALUES}, z AS (SELECT id, {LEAST} + h / 255 * {MOST - LEAST} AS h FROM vv),
u AS (SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM e), g AS (SELECT a, b, x.h AS p, greatest(x.h, y.h) AS hm, greatest(x.h, y.h) / least(x.h, y.h) AS r FROM u JOIN z x ON x.id = a JOIN z y ON y.id = b)
SELECT a, b, {_r('CASE WHEN abs(r - 1) < 1e-12 THEN p ELSE hm * (r - 1) / (r * ln(r)) END', 9)} AS size FROM g""",
    "surface_samples": f"""WITH {_GRID}, {_CORNERS}, d AS (SELECT o_orderkey AS id, CAST(floor({_uniform(0)} * (SELECT count(*) FROM tr)) AS BIGINT) AS triangle, sqrt({_uniform(1)}) AS r, {_uniform(2)} AS s FROM orders)
SELECT d.id, triangle, {_r('ax * (1 - r) + bx * r * (1 - s) + cx * r * s', 9)} AS x, {_r('ay * (1 - r) + b_y * r * (1 - s) + cy * r * s', 9)} AS y, 0.0::DOUBLE AS z FROM d JOIN ct ON ct.id = triangle""",
    "ocean_sites": f"WITH {_SPHERE}, {_RASTER} SELECT i.id, {_r('x', 9)} AS x, {_r('y', 9)} AS y, {_r('z', 9)} AS z FROM (SELECT *, {_PIX} FROM (SELECT *, {_UV} FROM s)) i JOIN ra USING (px, py) WHERE ra.value >= 50",
    "triangle_gradients": f"WITH {_SLOPES} SELECT id, {_r('gx', 3)} AS gx, {_r('gy', 3)} AS gy FROM gr",
    "vertex_gradients": f"WITH {_SLOPES} SELECT id, {_r('avg(gx)', 3)} AS gx, {_r('avg(gy)', 3)} AS gy FROM (SELECT unnest([v0, v1, v2]) AS id, gx, gy FROM gr) GROUP BY id",
    "field_at_nodes": f"WITH {_GRID}, {_CORNERS} " + " UNION ALL ".join(
        f"SELECT id, {k}::BIGINT AS node, {_r(f'sin(pi() * (ax * {1 - s - t} + bx * {s} + cx * {t})) * sin(pi() * (ay * {1 - s - t} + b_y * {s} + cy * {t}))', 9)} AS value FROM ct" for k, (s, t) in enumerate(_NODES)
    ),
    # Newton's steps from the trace fall to the largest root; the others follow from it.
    "covariance_eigenvalues": "WITH cv AS (SELECT l_suppkey AS id, " + ", ".join(f"covar_pop({_FIELDS[i]}, {_FIELDS[j]}) + {float(i == j)} AS m{i}{j}" for i in range(3) for j in range(i, 3)) + f""" FROM lineitem GROUP BY 1),
c AS (SELECT id, m00 + m11 + m22 AS t, m00 * m11 + m00 * m22 + m11 * m22 - m01 * m01 - m02 * m02 - m12 * m12 AS u, m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02) AS d FROM cv),
h0 AS (SELECT *, t AS h FROM c), {", ".join(f"h{k + 1} AS (SELECT id, t, u, d, CASE WHEN 3 * h * h - 2 * t * h + u > 0 THEN h - (((h - t) * h + u) * h - d) / (3 * h * h - 2 * t * h + u) ELSE h END AS h FROM h{k})" for k in range(40))}
SELECT id, {_r("h")} AS high, {_r("(t - h + sqrt(greatest(0, (t - h) * (t - h) - 4 * d / h))) / 2")} AS middle, {_r("(t - h - sqrt(greatest(0, (t - h) * (t - h) - 4 * d / h))) / 2")} AS low FROM h40""",
    "covariance_inverses": "WITH cv AS (SELECT l_suppkey AS id, " + ", ".join(f"covar_pop({_FIELDS[i]}, {_FIELDS[j]}) + {float(i == j)} AS m{i}{j}" for i in range(4) for j in range(i, 4)) + f""" FROM lineitem GROUP BY 1), {_eliminated()}
SELECT g4.id, {_r('det', 3)} AS det, {_r('m00 + m11 + m22 + m33')} AS trace, {', '.join(f"{_r(f'b{i}{j}')} AS i{i}{j}" for i in range(4) for j in range(i, 4))} FROM g4 JOIN cv USING (id)""",
}
