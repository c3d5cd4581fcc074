"""Mesh files in many parts, as text and in binary form."""

import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import binary, formats, meshes


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def same(a, b, *columns):
    assert rows(a, *columns) == rows(b, *columns)


@pytest.fixture(scope="module")
def grid(spark):
    m = meshes.grid(spark, 40, 40)
    lines = m.triangles.select("id", "v0", "v1", (F.col("id") % 5).alias("group"))
    polygons = spark.range(300).select("id", F.transform(F.sequence(F.lit(0), 2 + F.col("id") % 9), lambda k: (k * 7 + F.col("id")) % 1000).alias("vertices"), (F.col("id") % 3).alias("group"))
    return meshes.Mesh(m.vertices, m.triangles.withColumn("group", F.col("id") % 7 - 1), m.quads, polygons, lines)


def unlike_parts(text: list[str], path: Path, seed: int) -> str:
    """The lines in 8 files whose names are in order and whose sizes are not."""
    path.mkdir()
    cuts = sorted(np.random.default_rng(seed).choice(len(text), 7, replace=False).tolist())
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)], strict=True)):
        (path / f"part-{k:05d}.txt").write_text("".join(line + "\n" for line in text[a:b]))
    return str(path)


@pytest.mark.parametrize("seed", [1, 2])
def test_text_in_parts_of_unlike_size(spark, grid, tmp_path, seed):
    plain = meshes.Mesh(grid.vertices, grid.triangles, grid.quads, None, grid.lines)
    lines = [r["line"] for r in formats.mesh_lines(plain).orderBy("section", "id").collect()]
    got = formats.read_mesh_text(spark, unlike_parts([x for line in lines for x in line.split("\n")], tmp_path / "m.mesh", seed))
    same(got.vertices, grid.vertices, "id", "x", "y", "z")
    same(got.triangles, grid.triangles, "id", "v0", "v1", "v2")
    same(got.quads, grid.quads, "id", "v0", "v1", "v2", "v3")
    same(got.lines, grid.lines, "id", "v0", "v1")
    obj = [r["line"] for r in formats.obj_lines(plain).orderBy("kind", "id").collect()]
    back = formats.read_any(spark, unlike_parts(obj, tmp_path / "m.OBJ", seed))
    same(back.triangles, grid.triangles, "id", "v0", "v1", "v2")
    assert np.abs(np.array(rows(back.vertices, "id", "x", "y")) - np.array(rows(grid.vertices, "id", "x", "y"))).max() < 1e-9


def test_text_written_by_tasks(spark, grid, tmp_path):
    formats.write_mesh(meshes.Mesh(grid.vertices, grid.triangles), str(tmp_path / "w.mesh"))
    got = formats.read_any(spark, str(tmp_path / "w.mesh"))
    same(got.vertices, grid.vertices, "id", "x", "y", "z")
    same(got.triangles, grid.triangles, "id", "v0", "v1", "v2")


@pytest.mark.parametrize("parts", [1, 9])
def test_binary_round_trip_in_parts_and_splits(spark, grid, tmp_path, parts):
    path = str(tmp_path / "b.meshb")
    binary.write_binary(grid, path, parts)
    assert len(list(Path(path).glob("part-*"))) >= min(parts, 2) - 1 and not list(Path(path).glob("tmp-*"))
    for got in (formats.read_any(spark, path), binary.read_binary(spark, "file:" + path, rows=117)):
        same(got.vertices, grid.vertices, "id", "x", "y", "z")
        same(got.triangles, grid.triangles, "id", "v0", "v1", "v2", "group")
        same(got.quads, grid.quads, "id", "v0", "v1", "v2", "v3")
        same(got.lines, grid.lines, "id", "v0", "v1", "group")
        same(got.polygons, grid.polygons, "id", "vertices", "group")
        assert {r["group"] for r in got.quads.select("group").distinct().collect()} == {-1}
    whole = b"".join(p.read_bytes() for p in sorted(Path(path).glob("part-*")))
    one = tmp_path / "one.meshb"
    one.write_bytes(whole)
    same(binary.read_binary(spark, str(one), rows=1000).polygons, grid.polygons, "id", "vertices", "group")
    binary.write_binary(meshes.Mesh(grid.vertices.limit(3)), path, 2)  # overwrites
    again = binary.read_binary(spark, path)
    assert again.vertices.count() == 3 and again.triangles.count() == 0 and again.polygons.count() == 0


def test_single_precision_in_the_plane(spark, tmp_path):
    head = struct.pack("<iiiii", 1, 1, 3, 20, 2)
    vertices = struct.pack("<iii", 4, 20 + 12 + 2 * 12, 2) + struct.pack("<ffi", 0.5, 0.25, 3) + struct.pack("<ffi", 1.5, -2.0, 0)
    edges = struct.pack("<iii", 5, 20 + 36 + 12 + 12, 1) + struct.pack("<iii", 1, 2, 9)
    path = tmp_path / "v1.meshb"
    path.write_bytes(head + vertices + edges + struct.pack("<ii", 54, 0))
    got = binary.read_binary(spark, str(path))
    assert rows(got.vertices, "id", "x", "y", "z", "group") == [(0, 0.5, 0.25, 0.0, 2), (1, 1.5, -2.0, 0.0, -1)]
    assert rows(got.lines, "id", "v0", "v1", "group") == [(0, 0, 1, 8)]
    (tmp_path / "bad.meshb").write_bytes(b"\0" * 40)
    with pytest.raises(Exception, match="binary mesh"):
        binary.read_binary(spark, str(tmp_path / "bad.meshb")).vertices.count()


def test_solutions(spark, grid, tmp_path):
    v = grid.vertices
    binary.write_solution(v, ["x"], str(tmp_path / "s"), parts=3)
    binary.write_solution(v, ["x", "y", "z"], str(tmp_path / "v"), at_vertices=False, parts=4)
    assert rows(binary.read_solution(spark, str(tmp_path / "s"), rows=100), "id", "values") == [(i, [x]) for i, x in rows(v, "id", "x")]
    assert rows(binary.read_solution(spark, str(tmp_path / "v"), False), "id", "values") == [(i, [x, y, z]) for i, x, y, z in rows(v, "id", "x", "y", "z")]
