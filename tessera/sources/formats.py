"""Readers and writers: OBJ text, snapshots in JSON, VTK points, site text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ordering import checkpointed, numbered
from tessera.sources import binary
from tessera.sources.meshes import Mesh


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """at, value: the lines of text files in the order of the files' names and of their places in them, numbered from 0.

    Spark deals files to tasks by size; inside a task a split's lines come in their order, so file, start of the split and running number order them all.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return checkpointed(numbered(lines, ["file", "start", "line"], "at").select("at", "value"))


def obj_lines(mesh: Mesh) -> DataFrame:
    """kind (0 vertex, 1 face), id, line of a mesh's OBJ text, in the order of the first two."""
    v = mesh.vertices.select(F.lit(0).alias("kind"), "id", F.format_string("v %.10f %.10f %.10f", "x", "y", "z").alias("line"))
    rows = [v]
    if mesh.triangles is not None:
        rows.append(mesh.triangles.select(F.lit(1).alias("kind"), "id", F.format_string("f %d %d %d", *[F.col(f"v{k}") + 1 for k in range(3)]).alias("line")))
    elif mesh.quads is not None:
        rows.append(mesh.quads.select(F.lit(1).alias("kind"), "id", F.format_string("f %d %d %d %d", *[F.col(f"v{k}") + 1 for k in range(4)]).alias("line")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def write_obj(mesh: Mesh, path: str) -> None:
    """OBJ text as ordered part files: vertices before faces, each by id."""
    obj_lines(mesh).repartitionByRange("kind", "id").sortWithinPartitions("kind", "id").select("line").write.mode("overwrite").text(path)


def read_obj(spark: SparkSession, path: str) -> Mesh:
    """A mesh from OBJ text; texture and normal indices are dropped, faces become triangles, quads or polygons by size."""
    words = ordered_lines(spark, path).select("at", F.split(F.trim("value"), r"\s+").alias("w"))
    v = numbered(words.filter(F.get("w", F.lit(0)) == "v"), ["at"], "id").select("id", *[F.get("w", F.lit(k + 1)).cast("double").alias(c) for k, c in enumerate("xyz")])
    f = numbered(words.filter(F.get("w", F.lit(0)) == "f"), ["at"], "id").select(
        "id", F.transform(F.slice("w", 2, F.size("w")), lambda c: F.substring_index(c, "/", 1).cast("long") - 1).alias("vertices")
    )
    corner = lambda n: f.filter(F.size("vertices") == n).select("id", *[F.get("vertices", F.lit(k)).alias(f"v{k}") for k in range(n)])
    return Mesh(v, corner(3), corner(4), f.filter(F.size("vertices") > 4))


#: Rows in one object of a snapshot.
CHUNK = 4096


def snapshot(particles: DataFrame) -> DataFrame:
    """part, json: objects of arrays x, y, z, h, w over so many rows in the order of ids, with their part and the domain."""
    fields = ("x", "y", "z", "h", "w")
    placed = numbered(particles.select("id", *fields), ["id"], "place").withColumn("part", F.floor(F.col("place") / CHUNK))
    rows = placed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias("rows"))
    arrays = [F.col(f"rows.{c}").alias(c) for c in fields]
    return rows.select("part", F.to_json(F.struct("part", *arrays, F.lit("sphere").alias("domain"))).alias("json"))


def snapshot_rows(objects: DataFrame) -> DataFrame:
    """id, x, y, z, h, w of the objects (json) of a snapshot, numbered from 0; an object without a part is the only one."""
    arrays = ", ".join(f"{c} array<double>" for c in ("x", "y", "z", "h", "w"))
    rows = objects.select(F.from_json("json", f"part bigint, {arrays}, domain string").alias("o")).select("o.*")
    each = rows.select(F.coalesce("part", F.lit(0)).alias("part"), F.posexplode(F.arrays_zip("x", "y", "z", "h", "w")).alias("at", "s"))
    return each.select((F.col("part") * CHUNK + F.col("at")).alias("id"), "s.*")


def write_snapshot(particles: DataFrame, path: str) -> None:
    snapshot(particles).select("json").write.mode("overwrite").text(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y, z, h, w from the lines of a snapshot."""
    return snapshot_rows(spark.read.text(path).select(F.col("value").alias("json")))


def write_statistics(history: DataFrame, path: str) -> None:
    """One JSON object a row: the statistics of each round, with their running averages if they are there."""
    history.select(F.to_json(F.struct(*history.columns)).alias("json")).write.mode("overwrite").text(path)


def compare_statistics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The objects of several runs' statistics, with the run (its place in the list) they are from."""
    runs = [spark.read.json(p).withColumn("run", F.lit(k)) for k, p in enumerate(paths)]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


# Keywords of the public text format for meshes, with the columns of their rows.
KEYWORDS = {"Vertices": ("x", "y", "z"), "Edges": ("v0", "v1"), "Triangles": ("v0", "v1", "v2"), "Quadrilaterals": ("v0", "v1", "v2", "v3")}


def mesh_lines(mesh: Mesh) -> DataFrame:
    """section, id, line of a mesh's text in the order of the first two; rows end with a reference of 0, corners count from 1."""
    spark = mesh.vertices.sparkSession
    out = spark.sql("SELECT 0 AS section, 0L AS id, 'MeshVersionFormatted 2' AS line UNION ALL SELECT 0, 1L, 'Dimension 3' UNION ALL SELECT 9, 0L, 'End'")
    parts = {"Vertices": mesh.vertices, "Edges": mesh.lines, "Triangles": mesh.triangles, "Quadrilaterals": mesh.quads}
    for k, (word, rows) in enumerate(parts.items(), 1):
        if rows is not None:
            columns = KEYWORDS[word]
            number = [F.format_string("%.16e", c) if word == "Vertices" else (F.col(c) + 1).cast("string") for c in columns]
            head = rows.agg(F.count("*").alias("n")).select(F.lit(k).alias("section"), F.lit(-1).cast("long").alias("id"), F.format_string(f"{word}\n%d", "n").alias("line"))
            out = out.unionByName(head).unionByName(rows.select(F.lit(k).alias("section"), "id", F.concat_ws(" ", *number, F.lit("0")).alias("line")))
    return out


def write_mesh(mesh: Mesh, path: str) -> None:
    """Text as ordered part files."""
    mesh_lines(mesh).repartitionByRange("section", "id").sortWithinPartitions("section", "id").select("line").write.mode("overwrite").text(path)


def read_mesh_text(spark: SparkSession, path: str) -> Mesh:
    """A mesh from its text; a row belongs to the last keyword before it, and ids are its place from 0."""
    lines = ordered_lines(spark, path).select("at", F.split(F.trim("value"), r"\s+").alias("w"))
    heads = lines.filter(F.get("w", F.lit(0)).rlike("^[A-Za-z]")).select("at", F.get("w", F.lit(0)).alias("word")).orderBy("at").collect()  # one row a keyword

    def rows(word: str) -> DataFrame:
        own = F.lit(False)
        for k, h in enumerate(heads):
            if h["word"] == word:
                own = own | ((F.col("at") > h["at"]) & ((F.col("at") < heads[k + 1]["at"]) if k + 1 < len(heads) else F.lit(True)))
        kept = numbered(lines.filter(own & (F.size("w") > len(KEYWORDS[word]))), ["at"], "id")
        cell = lambda k: F.get("w", F.lit(k)).cast("double") if word == "Vertices" else F.get("w", F.lit(k)).cast("long") - 1
        return kept.select("id", *[cell(k).alias(c) for k, c in enumerate(KEYWORDS[word])])

    return Mesh(rows("Vertices"), rows("Triangles"), rows("Quadrilaterals"), lines=rows("Edges"))


def read_any(spark: SparkSession, path: str) -> Mesh:
    """A mesh by its name's extension, in any case: obj, mesh or meshb."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    readers = {"obj": read_obj, "mesh": read_mesh_text, "meshb": binary.read_binary}
    if kind not in readers:
        raise ValueError(f"no reader for meshes named .{kind}")
    return readers[kind](spark, path)


def solution_lines(values: DataFrame, columns: list[str], at_vertices: bool = True) -> DataFrame:
    """section, id, line of the text of a scalar (one column) or vector field at vertices or triangles."""
    word = "SolAtVertices" if at_vertices else "SolAtTriangles"
    kind = 1 if len(columns) == 1 else 2
    head = values.agg(F.count("*").alias("n")).select(
        F.lit(0).alias("section"), F.lit(-1).cast("long").alias("id"), F.format_string(f"MeshVersionFormatted 2\nDimension 3\n{word}\n%d\n1 {kind}", "n").alias("line")
    )
    rows = values.select(F.lit(1).alias("section"), "id", F.concat_ws(" ", *[F.format_string("%.16e", c) for c in columns]).alias("line"))
    return head.unionByName(rows).unionByName(values.sparkSession.sql("SELECT 2 AS section, 0L AS id, 'End' AS line"))


def site_text(sites: DataFrame) -> DataFrame:
    """id, line: coordinates with 16 decimals."""
    return sites.select("id", F.format_string("%.16e %.16e %.16e", "x", "y", "z").alias("line"))


def vtk_lines(points: DataFrame) -> DataFrame:
    """section, id, line of the points as VTK text."""
    head = points.agg(F.count("*").alias("n")).select(
        F.lit(0).alias("section"), F.lit(-1).cast("long").alias("id"), F.format_string("# vtk DataFile Version 2.0\npoints\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS %d float", "n").alias("line")
    )
    return head.unionByName(points.select(F.lit(1).alias("section"), "id", F.format_string("%.8e %.8e %.8e", "x", "y", "z").alias("line")))


def vtk_points(points: DataFrame, path: str) -> None:
    """VTK text as part files in the order of ids; put together they are one file."""
    vtk_lines(points).repartitionByRange("section", "id").sortWithinPartitions("section", "id").select("line").write.mode("overwrite").text(path)
