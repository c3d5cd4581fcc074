"""Queries over diagrams, facet operators, matrices, graphs and fluids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import calculus, fluids, restricted, sparse, topology, voronoi
from tessera.operators.ordering import checkpointed
from tessera.plans.geometry import _SPHERE, _r
from tessera.sources import formats, meshes, sites

R = v.rounded
PLANE = voronoi.Domain(sphere=False)


# --- Diagrams; the SQL of most is in surfaces.py ---


def voronoi_sphere_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = voronoi.diagram(sites.sphere_sites(spark, sf_dir))
    return cells.select(F.col("id").alias("site"), R(F.col("volume"), 9).alias("volume"), *[R(F.col(f"m{k}"), 9).alias(f"m{k}") for k in "xyz"], F.size("points").alias("corners"))


def voronoi_sphere_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = voronoi.facets(voronoi.diagram(sites.sphere_sites(spark, sf_dir)))
    return f.select("bi", "bj", *[R(F.col(c), 9).alias(c) for c in ("length", "mx", "my", "mz")])


def voronoi_sphere_delaunay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.delaunay(voronoi.diagram(sites.sphere_sites(spark, sf_dir)))


def voronoi_square_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = voronoi.diagram(sites.square_sites(spark, sf_dir), PLANE)
    return cells.select(F.col("id").alias("site"), R(F.col("volume"), 9).alias("volume"), R(F.col("mx"), 9).alias("mx"), R(F.col("my"), 9).alias("my"))


def power_sphere_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sites.sphere_sites(spark, sf_dir).withColumn("w", 0.01 * F.abs("z"))
    return voronoi.diagram(s).select(F.col("id").alias("site"), R(F.col("volume"), 9).alias("volume"))


def lloyd_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = voronoi.lloyd(sites.sphere_sites(spark, sf_dir).select("id", "x", "y", "z"), 2)
    return moved.select("id", *[R(F.col(k), 9).alias(k) for k in "xyz"])


def transport_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of all sites' cells on the sphere, moved by Newton's method towards equal ones, to the operator's own tolerance and number of steps."""
    s = sites.sphere_sites(spark, sf_dir).select("id", "x", "y", "z")
    n = s.count()
    found = fluids.transport(s, s.select("id", F.lit(4 * math.pi / n).alias("target")))
    return found.select("id", R(F.col("volume")).alias("volume"))


def spring_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sites.sphere_sites(spark, sf_dir)
    p = s.select("id", "x", "y", "z", F.when(F.col("f") > 0, 10.0).otherwise(1.0).alias("mass"), *[F.lit(0.0).alias(f"u{k}") for k in "xyz"])
    out = fluids.spring_step(p, 1e-3, 0.1, lambda: (F.lit(0.0), F.lit(0.0), -F.col("mass")))
    return out.select("id", *[R(F.col(c), 9).alias(c) for c in ("x", "y", "z", "ux", "uy", "uz")])


def shallow_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = fluids.initial_state(sites.sphere_sites(spark, sf_dir), 2)
    return fluids.shallow_water_step(state, 30.0).select("id", R(F.col("h"), 3).alias("h"), *[R(F.col(f"u{k}"), 3).alias(f"u{k}") for k in "xyz"])


def restricted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of the sites' cells on a subdivided icosahedron with about as many triangles as there are embeddings."""
    s = sites.sphere_sites(spark, sf_dir)
    level = max(0, math.floor(math.log(max(s.count(), 20) / 20, 4)))
    m = meshes.subdivided_sphere(spark, level)
    found = restricted.cells(restricted.diagram(m.triangles, m.vertices, s.select("id", "x", "y", "z")))
    return found.select("site", *[R(F.col(c), 9).alias(c) for c in ("area", "mx", "my", "mz")])


# --- Facet operators, on the lattice that the customers' fields lie on ---


def _lattice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Square cells in rows of the root of the customers' number, the last row maybe shorter, and their facets."""
    c = sites.table(spark, sf_dir, "customer")
    n = sites.side(c)
    first, total = c.agg(F.min("c_custkey"), F.count("*")).first()
    cells = c.select((F.col("c_custkey") - first).alias("id"), F.col("c_acctbal").alias("f"))
    k = F.col("id")
    i, j = k % n, F.floor(k / n)
    cells = cells.select("id", ((i + 0.5) / n).alias("x"), ((j + 0.5) / n).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0 / (n * n)).alias("volume"), "f", (F.col("f") / 97).alias("ux"), (-F.col("f") / 53).alias("uy"), F.lit(0.0).alias("uz"), (F.abs("f") + 1).alias("h"))
    ids = cells.select("id")
    right = ids.filter((i < n - 1) & (k + 1 < total)).select(k.alias("bi"), (k + 1).alias("bj"), F.lit(1.0 / n).alias("length"), ((i + 1.0) / n).alias("mx"), ((j + 0.5) / n).alias("my"), F.lit(0.0).alias("mz"))
    up = ids.filter(k + n < total).select(k.alias("bi"), (k + n).alias("bj"), F.lit(1.0 / n).alias("length"), ((i + 0.5) / n).alias("mx"), ((j + 1.0) / n).alias("my"), F.lit(0.0).alias("mz"))
    return cells, right.unionByName(up)


def gradient_kincl(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, f = _lattice(spark, sf_dir)
    return calculus.gradient(f, cells, "f", "kincl").select("id", R(F.col("gx"), 3).alias("gx"), R(F.col("gy"), 3).alias("gy"))


def gradient_springel(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, f = _lattice(spark, sf_dir)
    return calculus.gradient(f, cells, "f").select("id", R(F.col("gx"), 3).alias("gx"), R(F.col("gy"), 3).alias("gy"))


def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, f = _lattice(spark, sf_dir)
    return calculus.divergence(f, cells, ("ux", "uy", "uz")).select("id", R(F.col("div"), 3).alias("div"))


def curl(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, f = _lattice(spark, sf_dir)
    return calculus.curl(f, cells, ("ux", "uy", "uz")).select("id", R(F.col("wz"), 3).alias("wz"))


def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, f = _lattice(spark, sf_dir)
    return calculus.laplacian(f, cells, "f").select("id", R(F.col("lap"), 3).alias("lap"))


def viscosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, f = _lattice(spark, sf_dir)
    return calculus.viscosity(f, cells, "h", ("ux", "uy", "uz"), fluids.GRAVITY).select("id", R(F.col("fx"), 3).alias("fx"), R(F.col("fy"), 3).alias("fy"))


def max_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, f = _lattice(spark, sf_dir)
    return calculus.max_displacement(f, cells.withColumn("w", F.col("f") / 1e9), "w").select("id", R(F.col("reach"), 9).alias("reach"))


def swe_initial_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _initial(spark, sf_dir, 1)


def swe_initial_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _initial(spark, sf_dir, 2)


def swe_initial_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _initial(spark, sf_dir, 5)


def _initial(spark: SparkSession, sf_dir: str, case: int) -> DataFrame:
    s = fluids.initial_state(sites.sphere_sites(spark, sf_dir), case)
    return s.select("id", *[R(F.col(c), 4).alias(c) for c in ("h", "hs", "ux", "uy", "uz")], R(F.col("fc"), 9).alias("fc"))


def conserved_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fluids.initial_state(sites.sphere_sites(spark, sf_dir), 5)
    n = s.count()
    t = fluids.totals(s.withColumn("volume", F.lit(4 * math.pi / n)))
    return t.select(R(F.col("mass"), 3).alias("mass"), R(F.col("momentum"), 2).alias("momentum"), R(F.col("energy"), 0).alias("energy"), R(F.col("area")).alias("area"))


def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the sites, written as JSON and read back through its arrays."""
    s = fluids.initial_state(sites.sphere_sites(spark, sf_dir), 2)
    text = formats.snapshot(s.select("id", "x", "y", "z", "h", F.lit(0.0).alias("w")))
    rows = formats.snapshot_rows(text)
    return rows.select(F.col("id").alias("place"), *[R(F.col(c)).alias(c) for c in "xyz"], R(F.col("h"), 4).alias("h"))


# --- Matrices and graphs --------------------------------------------------


def spmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sites.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("value"))
    return sparse.spmv(sites.coo(spark, sf_dir), x).select("i", R(F.col("value"), 3).alias("value"))


def transpose_spmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sites.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("value"))
    return sparse.spmv(sparse.transpose(sites.coo(spark, sf_dir), 0.5), x).select("i", R(F.col("value"), 2).alias("value"))


def spmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = checkpointed(sites.coo(spark, sf_dir))
    return sparse.spmm(sparse.transpose(a), a).select("i", "j", R(F.col("value"), 3).alias("value"))


def matrix_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.norms(sites.coo(spark, sf_dir)).select(R(F.col("norm")).alias("norm"), "nnz")


def _square_matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A symmetric, diagonally dominant matrix over the suppliers, and a right side."""
    s = sites.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("value"))
    n = s.count()
    pairs = sites.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("p"), (F.col("l_partkey") % n + 1).alias("q"), F.col("l_quantity").alias("w")).filter("p <> q")
    off = pairs.groupBy(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")).agg((-F.sum("w")).alias("value"))
    off = off.unionByName(sparse.transpose(off))
    diagonal = s.select("i").join(off.groupBy("i").agg(F.sum("value").alias("s")), "i", "left")
    return off.unionByName(diagonal.select("i", F.col("i").alias("j"), (1.0 - 1.5 * F.coalesce("s", F.lit(0.0))).alias("value"))), s


def jacobi_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _square_matrix(spark, sf_dir)
    return sparse.jacobi(a, b, 5).select("i", R(F.col("value")).alias("value"))


def conjugate_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solution; its SQL is a long run of Jacobi rounds, which shrink the error to two thirds each."""
    a, b = _square_matrix(spark, sf_dir)
    for c in ("i", "j"):  # part numbers reach one beyond the suppliers
        a = a.join(b.select(F.col("i").alias(c)), c, "left_semi")
    return sparse.conjugate_gradient(a.select("i", "j", "value"), b, 1e-12).select("i", R(F.col("value"), 8).alias("value"))


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.components(sites.graph_edges(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        voronoi_sphere_cells, voronoi_sphere_facets, voronoi_sphere_delaunay, voronoi_square_cells, power_sphere_cells, lloyd_sphere,
        restricted_cells, transport_step, spring_particles, shallow_water, gradient_kincl, gradient_springel, divergence, curl, laplacian, viscosity,
        max_displacement, swe_initial_1, swe_initial_2, swe_initial_5, conserved_totals, snapshot_rows, spmv, transpose_spmv, spmm,
        matrix_norms, jacobi_5, conjugate_gradient, connected_components,
    )
}

# --- SQL ---------------------------------------------------------------

_LATTICE = """n AS (SELECT greatest(2, CAST(floor(sqrt(count(*))) AS BIGINT)) AS n FROM customer),
co AS (SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS id, c_acctbal AS f FROM customer),
ce AS (SELECT id, id % n AS i, id // n AS j, n, (SELECT count(*) FROM customer) AS total, f FROM co, n),
c AS (SELECT id, i, j, n, total, (i + 0.5::DOUBLE) / n AS x, (j + 0.5::DOUBLE) / n AS y, 1.0::DOUBLE / (n * n) AS vol, f, f / 97 AS ux, -f / 53 AS uy, abs(f) + 1 AS h FROM ce),
fa AS (SELECT id AS bi, id + 1 AS bj, 1.0::DOUBLE / n AS l, (i + 1.0::DOUBLE) / n AS mx, (j + 0.5::DOUBLE) / n AS my FROM c WHERE i < n - 1 AND id + 1 < total
  UNION ALL SELECT id, id + n, 1.0::DOUBLE / n, (i + 0.5::DOUBLE) / n, (j + 1.0::DOUBLE) / n FROM c WHERE id + n < total),
-- each facet from both of its cells: a is the cell, b the other
g AS (SELECT a.id, a.x, a.y, b.x AS bx, b.y AS b_y, a.f, b.f AS bf, a.ux, a.uy, b.ux AS bux, b.uy AS buy, a.h, b.h AS bh, l, mx, my, a.vol,
    sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS r
  FROM (SELECT bi AS p, bj AS q, l, mx, my FROM fa UNION ALL SELECT bj, bi, l, mx, my FROM fa) JOIN c a ON a.id = p JOIN c b ON b.id = q)"""


def _initial_sql(h: str, hs: str, u: tuple[str, str, str], fc: str) -> str:
    lonlat = "atan2(y, x) AS lon, asin(greatest(least(z, 1), -1)) AS lat"
    return f"""WITH {_SPHERE}, t AS (SELECT *, {lonlat} FROM s), m AS (SELECT *, {hs} AS hs FROM t)
SELECT id, {_r(h, 4)} AS h, {_r('hs', 4)} AS hs, {_r(u[0], 4)} AS ux, {_r(u[1], 4)} AS uy, {_r(u[2], 4)} AS uz, {_r(fc, 9)} AS fc FROM m"""


_U0 = "(2 * pi() * 6371220.0::DOUBLE / (12 * 86400.0::DOUBLE))"
_OMEGA = "7.292e-5::DOUBLE"
_MOUNTAIN = "2000 * (1 - sqrt(least(pi() / 9 * (pi() / 9), (lon + pi() / 2) * (lon + pi() / 2) + (lat - pi() / 6) * (lat - pi() / 6))) / (pi() / 9))"
_H5 = f"(5960 - (6371220.0::DOUBLE * {_OMEGA} * 20 + 200) / 9.80616::DOUBLE * z * z - hs)"
_COO = "a AS (SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
_SYSTEM = """k AS (SELECT count(*) AS n FROM supplier),
pr AS (SELECT l_suppkey AS p, l_partkey % n + 1 AS q, l_quantity AS w FROM lineitem, k WHERE l_suppkey <> l_partkey % n + 1),
o AS (SELECT least(p, q) AS i, greatest(p, q) AS j, -sum(w) AS v FROM pr GROUP BY 1, 2),
off AS (SELECT i, j, v FROM o UNION ALL SELECT j, i, v FROM o),
dg AS (SELECT s_suppkey AS i, 1.0 - 1.5 * coalesce(s, 0) AS d, s_acctbal AS b FROM supplier LEFT JOIN (SELECT i, sum(v) AS s FROM off GROUP BY i) t ON t.i = s_suppkey)"""


def _jacobi(rounds: int) -> str:
    step = "x{1} AS (SELECT dg.i, (b - coalesce(s, 0)) / d AS x FROM dg LEFT JOIN (SELECT off.i, sum(v * x) AS s FROM off JOIN x{0} ON x{0}.i = off.j GROUP BY off.i) t ON t.i = dg.i)"
    return "x0 AS (SELECT i, 0.0::DOUBLE AS x FROM dg), " + ", ".join(step.format(k, k + 1) for k in range(rounds))


SQL = {
    "gradient_kincl": f"WITH {_LATTICE} SELECT id, {_r('sum(l * (x - mx) * (f - bf) / (r * vol))', 3)} AS gx, {_r('sum(l * (y - my) * (f - bf) / (r * vol))', 3)} AS gy FROM g GROUP BY id",
    "gradient_springel": f"WITH {_LATTICE} SELECT id, {_r('sum(l / r * ((bf - f) * (mx - (x + bx) / 2) - 0.5 * (f + bf) * (x - bx)) / vol)', 3)} AS gx, {_r('sum(l / r * ((bf - f) * (my - (y + b_y) / 2) - 0.5 * (f + bf) * (y - b_y)) / vol)', 3)} AS gy FROM g GROUP BY id",
    "divergence": f"WITH {_LATTICE} SELECT id, {_r('sum(l * ((x - mx) * (ux - bux) + (y - my) * (uy - buy)) / (r * vol))', 3)} AS div FROM g GROUP BY id",
    "curl": f"WITH {_LATTICE} SELECT id, {_r('sum(l * ((bux - ux) * (y - my) - (buy - uy) * (x - mx)) / (r * vol))', 3)} AS wz FROM g GROUP BY id",
    "laplacian": f"WITH {_LATTICE} SELECT id, {_r('sum(-l * (f - bf) / r / vol)', 3)} AS lap FROM g GROUP BY id",
    "viscosity": f"""WITH {_LATTICE}, q AS (SELECT *, -0.5 * (sqrt(9.80616 * h) + sqrt(9.80616 * bh)) * ((ux - bux) * (x - bx) + (uy - buy) * (y - b_y)) / sqrt(r * r + 1e-12) AS pi_ FROM g)
SELECT id, {_r('sum(-l * (x - mx) * pi_ / (r * vol))', 3)} AS fx, {_r('sum(-l * (y - my) * pi_ / (r * vol))', 3)} AS fy FROM q GROUP BY id""",
    "max_displacement": f"WITH {_LATTICE} SELECT id, {_r('min(abs(r * r + f / 1e9 - bf / 1e9) / (2 * r) / 2)', 9)} AS reach FROM g GROUP BY id",
    "swe_initial_1": _initial_sql("CASE WHEN acos(greatest(least(-y, 1), -1)) < 1.0::DOUBLE / 3 THEN 500 * (1 + cos(pi() * acos(greatest(least(-y, 1), -1)) * 3)) ELSE 0 END", "0.0::DOUBLE", (f"-{_U0} * y", f"{_U0} * x", "0"), f"2 * {_OMEGA} * z"),
    "swe_initial_2": _initial_sql(f"2.94e4 / 9.80616 - (6371220.0 * {_OMEGA} * {_U0} + 0.5 * {_U0} * {_U0}) / 9.80616 * x * x", "0.0::DOUBLE", ("0", f"{_U0} * z", f"-{_U0} * y"), f"-2 * {_OMEGA} * x"),
    "swe_initial_5": _initial_sql(_H5, _MOUNTAIN, ("-20 * y", "20 * x", "0"), f"2 * {_OMEGA} * z"),
    "conserved_totals": f"""WITH {_SPHERE}, t AS (SELECT *, atan2(y, x) AS lon, asin(greatest(least(z, 1), -1)) AS lat FROM s), m AS (SELECT *, {_MOUNTAIN} AS hs FROM t),
w AS (SELECT *, {_H5} AS h, 4 * pi() / (SELECT count(*) FROM s) AS vol, 400 * (x * x + y * y) AS s2 FROM m)
SELECT {_r('sum(vol * h)', 3)} AS mass, {_r('sum(vol * (sqrt(s2) + sqrt(9.80616 * h)))', 2)} AS momentum,
  {_r('sum(0.5 * vol * (h * s2 + 9.80616 * ((h + hs) * (h + hs) - hs * hs)))', 0)} AS energy, {_r('sum(vol)')} AS area FROM w""",
    "snapshot_rows": f"""WITH {_SPHERE} SELECT row_number() OVER (ORDER BY id) - 1 AS place, {_r('x')} AS x, {_r('y')} AS y, {_r('z')} AS z,
  {_r(f"2.94e4 / 9.80616 - (6371220.0 * {_OMEGA} * {_U0} + 0.5 * {_U0} * {_U0}) / 9.80616 * x * x", 4)} AS h FROM s""",
    "spmv": f"WITH {_COO} SELECT i, {_r('sum(v * s_acctbal)', 3)} AS value FROM a JOIN supplier ON s_suppkey = j GROUP BY i",
    "transpose_spmv": f"WITH {_COO} SELECT j AS i, {_r('sum(0.5 * v * p_retailprice)', 2)} AS value FROM a JOIN part ON p_partkey = i GROUP BY j",
    "spmm": f"WITH {_COO} SELECT p.j AS i, q.j AS j, {_r('sum(p.v * q.v)', 3)} AS value FROM a p JOIN a q ON p.i = q.i GROUP BY 1, 2",
    "matrix_norms": f"WITH {_COO} SELECT {_r('sqrt(sum(v * v))')} AS norm, count(*) AS nnz FROM a",
    "jacobi_5": f"WITH {_SYSTEM}, {_jacobi(5)} SELECT i, {_r('x')} AS value FROM x5",
    "conjugate_gradient": f"WITH {_SYSTEM}, {_jacobi(80)} SELECT i, {_r('x', 8)} AS value FROM x80",
    "connected_components": """WITH RECURSIVE e AS (SELECT o_custkey AS a, -1 - o_orderkey AS b FROM orders),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(id, seen) AS (SELECT a, a FROM l UNION SELECT l.b, r.seen FROM reach r JOIN l ON l.a = r.id)
SELECT id, min(seen) AS label FROM reach GROUP BY id""",
}
