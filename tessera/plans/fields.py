"""Queries that solve for fields over meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import fem, topology
from tessera.plans.geometry import _CORNERS, _GRID, _bump, _grid, _r
from tessera.sources import meshes, sites

R = v.rounded


def _sides(spark: SparkSession, sf_dir: str, m: meshes.Mesh) -> DataFrame:
    """v0, v1, group: the boundary edges of the customers' grid; 3 in its first column, 1 in its last, else 2."""
    w = sites.side(sites.table(spark, sf_dir, "customer")) + 1
    column = lambda c: F.col(c) % w
    group = F.when((column("a") == 0) & (column("b") == 0), 3).when((column("a") == w - 1) & (column("b") == w - 1), 1).otherwise(2)
    return topology.boundary_edges(m.triangles).select(F.col("a").alias("v0"), F.col("b").alias("v1"), group.alias("group"))


def poisson_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solution for a bump as force on the customers' grid, with the heights x held on its boundary."""
    m = _grid(spark, sf_dir)
    edge = topology.boundary_edges(m.triangles).select(F.explode(F.array("a", "b")).alias("id")).distinct()
    fixed = m.vertices.join(edge, "id").select("id", F.col("x").alias("value"))
    u = fem.poisson(m.triangles, m.vertices, lambda p: 20 * _bump(p), fixed)
    return u.select("i", R(F.col("value"), 7).alias("value"))


def potential_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The potential of a flow through the customers' grid from its first column of vertices to its last."""
    m = _grid(spark, sf_dir)
    u, _ = fem.potential_flow(m.triangles, m.vertices, _sides(spark, sf_dir, m), 2.0)
    return u.select("i", R(F.col("value"), 7).alias("value"))


def flow_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fast the flow is in each triangle."""
    m = _grid(spark, sf_dir)
    u, _ = fem.potential_flow(m.triangles, m.vertices, _sides(spark, sf_dir, m), 2.0)
    return fem.triangle_gradients(m.triangles, m.vertices, u).select("id", R(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2), 5).alias("speed"))


QUERIES = {f.__name__: f for f in (poisson_field, potential_flow, flow_speed)}

# --- SQL: conjugate gradients with the diagonal, a step of the recursion each ---

_STIFF = """g AS (SELECT v0, v1, v2, abs((bx-ax)*(cy-ay)-(b_y-ay)*(cx-ax)) AS t, [b_y-cy, cy-ay, ay-b_y] AS gx, [cx-bx, ax-cx, bx-ax] AS gy FROM ct),
kk AS (SELECT i, j, sum(w) AS w FROM (SELECT [v0, v1, v2][p] AS i, [v0, v1, v2][q] AS j, (gx[p] * gx[q] + gy[p] * gy[q]) / (2 * t) AS w FROM g, unnest(range(1, 4)) AS r(p), unnest(range(1, 4)) AS u(q)) GROUP BY i, j),
be AS (SELECT least(p, q) AS a, greatest(p, q) AS b FROM (SELECT v0 AS p, v1 AS q FROM tr UNION ALL SELECT v1, v2 FROM tr UNION ALL SELECT v2, v0 FROM tr) GROUP BY 1, 2 HAVING count(*) = 1)"""


def _solved(matrix: str, right: str) -> str:
    """CTEs up to so (i, x) of the system of two subqueries (i, j, w) and (i, b)."""
    return f"""sm AS ({matrix}), sd AS (SELECT i, w AS d FROM sm WHERE i = j), sb AS ({right}),
cg(k, i, d, x, r, p) AS (SELECT 0, i, d, 0.0::DOUBLE, b, b / d FROM sb JOIN sd USING (i)
  UNION ALL SELECT k + 1, i, d, x, r, r / d + sum(r * r / d) OVER () / rho * p FROM (
    SELECT k, i, d, x + rho / pq * p AS x, r - rho / pq * q AS r, p, rho FROM (
      SELECT c.k, c.i, c.d, c.x, c.r, c.p, m.q, sum(c.r * c.r / c.d) OVER () AS rho, sum(c.p * m.q) OVER () AS pq
      FROM cg c JOIN (SELECT sm.i, sum(sm.w * o.p) AS q FROM cg o JOIN sm ON sm.j = o.i GROUP BY sm.i) m ON m.i = c.i) WHERE rho > 1e-26 AND k < 2000)),
so AS (SELECT i, x FROM cg WHERE k = (SELECT max(k) FROM cg))"""


_FORCE = "20 * sin(pi() * (ax+bx+cx) / 3) * sin(pi() * (ay+b_y+cy) / 3) * 0.5 * t0 / 3"
_HELD = f"""ld AS (SELECT unnest([v0, v1, v2]) AS i, {_FORCE} AS w FROM (SELECT *, abs((bx-ax)*(cy-ay)-(b_y-ay)*(cx-ax)) AS t0 FROM ct)),
fx AS (SELECT id AS i, x AS u FROM vx WHERE id IN (SELECT unnest([a, b]) FROM be))"""
_HELD_RIGHT = """SELECT i, sum(w) AS b FROM (SELECT i, w FROM ld UNION ALL SELECT kk.i, -kk.w * fx.u FROM kk JOIN fx ON fx.i = kk.j) WHERE i NOT IN (SELECT i FROM fx) GROUP BY i"""
_FREE = "SELECT i, j, w FROM kk WHERE i NOT IN (SELECT i FROM fx) AND j NOT IN (SELECT i FROM fx)"
_TAGGED = """ln AS (SELECT be.a, be.b, sqrt(power(q.x - p.x, 2) + power(q.y - p.y, 2)) * CASE WHEN be.a % (n + 1) = 0 AND be.b % (n + 1) = 0 THEN -1 WHEN be.a % (n + 1) = n AND be.b % (n + 1) = n THEN 1 ELSE 0 END AS w
  FROM be JOIN vx p ON p.id = be.a JOIN vx q ON q.id = be.b, n),
fl AS (SELECT vx.id AS i, coalesce(sum(f.w), 0) AS b FROM vx LEFT JOIN (SELECT unnest([a, b]) AS i, w FROM ln) f ON f.i = vx.id GROUP BY vx.id)"""
_FLOW = f"WITH RECURSIVE {_GRID}, {_CORNERS}, {_STIFF}, {_TAGGED}, " + _solved("SELECT * FROM kk", "SELECT i, b - avg(b) OVER () AS b FROM fl")
_FLOW += ", ps AS (SELECT i, x - avg(x) OVER () AS u FROM so)"

SQL = {
    "poisson_field": f"WITH RECURSIVE {_GRID}, {_CORNERS}, {_STIFF}, {_HELD}, {_solved(_FREE, _HELD_RIGHT)} SELECT i, {_r('x', 7)} AS value FROM (SELECT * FROM so UNION ALL SELECT * FROM fx)",
    "potential_flow": f"{_FLOW} SELECT i, {_r('u', 7)} AS value FROM ps",
    "flow_speed": f"""{_FLOW}, sl AS (SELECT ct.id, (bx-ax)*(cy-ay)-(b_y-ay)*(cx-ax) AS t, a.u * (b_y-cy) + b.u * (cy-ay) + c.u * (ay-b_y) AS gx, a.u * (cx-bx) + b.u * (ax-cx) + c.u * (bx-ax) AS gy
  FROM ct JOIN ps a ON a.i = v0 JOIN ps b ON b.i = v1 JOIN ps c ON c.i = v2) SELECT id, {_r('sqrt(gx * gx + gy * gy) / abs(t)', 5)} AS speed FROM sl""",
}
