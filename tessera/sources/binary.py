"""Meshes and solutions in the public binary mesh format: a source read in splits, a sink written in parts.

A file is a chain of sections: code, position of the next one, count, rows of one length. The driver walks the chain
with a few small reads; every split then reads its own range of rows. A path is one file, or a folder of parts whose bytes,
in the order of their names, are the file. Parts are written by tasks over rows dealt by range,
to names of their own attempt that the commit keeps, so a lost task leaves nothing behind that is read.

Rows have group, the file's reference less one (no group is written as reference 0). Polygons are two sections: the place of each
one's first vertex, and all vertices in a row; a split reads its headers, one more, and the vertices between.
Empty tables are sections without rows, absent ones read as empty.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.operators.ordering import checkpointed, numbered
from tessera.sources.meshes import Mesh

# Codes of the sections, and how many vertices a row names. Those of polygons could not be looked up here.
CODES = {"dimension": 3, "vertices": 4, "lines": 5, "triangles": 6, "quads": 7, "end": 54, "at_vertices": 62, "at_triangles": 64, "polygons": 207, "polygon_vertices": 208}
CORNERS = {"lines": 2, "triangles": 3, "quads": 4}
#: Rows of a split.
SPLIT = 1 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):  # with one slash or three
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Parts:
    """The bytes of a file, or of a folder's parts in the order of their names."""

    def __init__(self, path: str):
        self.fs, at = file_system(path)
        info = self.fs.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        files = [info] if info.type == fs.FileType.File else sorted((f for f in self.fs.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("part-")), key=lambda f: f.base_name)
        self.names, self.sizes = [f.path for f in files], [f.size for f in files]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def read(self, start: int, length: int) -> bytes:
        out, end = [], start + length
        for name, low, high in zip(self.names, self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            if low < end and high > start:
                with self.fs.open_input_file(name) as f:
                    f.seek(max(start - low, 0))
                    out.append(f.read(min(end, high) - max(start, low)))
        got = b"".join(out)
        if len(got) != length:
            raise ValueError(f"{length} bytes at {start} are beyond the file's end")
        return got


@dataclass
class Section:
    code: int
    count: int
    start: int  # of its rows
    types: tuple[int, ...] = ()


@dataclass
class Header:
    version: int
    dimension: int
    sections: dict[int, Section]


def read_header(parts: Parts) -> Header:
    """The sections of a file, from its chain of positions."""
    one, version = struct.unpack("<ii", parts.read(0, 8))
    if one != 1 or version not in (1, 2, 3, 4):
        raise ValueError("not a little-endian binary mesh of version 1 to 4")
    place, number = ("<i" if version < 3 else "<q"), ("<i" if version < 4 else "<q")
    at, found = 8, Header(version, 3, {})
    end = int(parts.starts[-1])
    while 0 < at < end:
        code = struct.unpack("<i", parts.read(at, 4))[0]
        at += 4
        after = struct.unpack(place, parts.read(at, struct.calcsize(place)))[0]
        at += struct.calcsize(place)
        if code == CODES["end"]:
            break
        if code == CODES["dimension"]:
            found.dimension = struct.unpack("<i", parts.read(at, 4))[0]
        else:
            count = struct.unpack(number, parts.read(at, struct.calcsize(number)))[0]
            at += struct.calcsize(number)
            types: tuple[int, ...] = ()
            if code in (CODES["at_vertices"], CODES["at_triangles"]):
                n = struct.unpack("<i", parts.read(at, 4))[0]
                types = struct.unpack(f"<{n}i", parts.read(at + 4, 4 * n))
                at += 4 + 4 * n
            found.sections[code] = Section(code, count, at, types)
        if after and after <= at - 4:
            raise ValueError("the chain of sections runs back")
        at = after
    return found


def row_type(section: str, header: Header, types: tuple[int, ...] = ()) -> np.dtype:
    real, whole = ("<f4" if header.version == 1 else "<f8"), ("<i4" if header.version < 4 else "<i8")
    if section == "vertices":
        return np.dtype([("x", real, (header.dimension,)), ("ref", whole)])
    if section in CORNERS:
        return np.dtype([("v", whole, (CORNERS[section],)), ("ref", whole)])
    if section == "polygons":
        return np.dtype([("first", whole), ("ref", whole)])
    if section == "polygon_vertices":
        return np.dtype([("v", whole)])
    # Numbers of a scalar, a vector and a symmetric tensor.
    return np.dtype([("x", real, (sum({1: 1, 2: header.dimension, 3: header.dimension * (header.dimension + 1) // 2}[t] for t in types),))])


def schema_of(section: str) -> str:
    if section == "vertices":
        return "id long, x double, y double, z double, group long"
    if section == "polygons":
        return "id long, vertices array<long>, group long"
    if section in CORNERS:
        return "id long, " + ", ".join(f"v{k} long" for k in range(CORNERS[section])) + ", group long"
    return "id long, values array<double>"


@dataclass
class Rows(InputPartition):
    first: int
    count: int


class SectionReader(DataSourceReader):
    def __init__(self, path: str, section: str, rows: int):
        self.path, self.section, self.rows = path, section, rows
        self.header = read_header(Parts(path))

    def partitions(self) -> list[Rows]:
        found = self.header.sections.get(CODES[self.section])
        n = found.count if found else 0
        return [Rows(k, min(self.rows, n - k)) for k in range(0, n, self.rows)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        parts, section, n = Parts(self.path), self.header.sections[CODES[self.section]], partition.count
        kind = row_type(self.section, self.header, section.types)

        def rows(start: int, count: int) -> np.ndarray:
            return np.frombuffer(parts.read(section.start + start * kind.itemsize, count * kind.itemsize), kind)

        got, ids = rows(partition.first, n), pa.array(np.arange(partition.first, partition.first + n))
        if self.section == "vertices":
            x = [pa.array(got["x"][:, k].astype(np.float64)) if k < self.header.dimension else pa.array(np.zeros(n)) for k in range(3)]
            columns = [ids, *x]
        elif self.section in CORNERS:
            columns = [ids, *[pa.array(got["v"][:, k].astype(np.int64) - 1) for k in range(CORNERS[self.section])]]
        elif self.section == "polygons":
            inner = self.header.sections[CODES["polygon_vertices"]]
            last = partition.first + n == section.count
            end = inner.count + 1 if last else int(rows(partition.first + n, 1)["first"][0])
            first = np.append(got["first"].astype(np.int64), end)
            word = row_type("polygon_vertices", self.header)
            v = np.frombuffer(parts.read(inner.start + int(first[0] - 1) * word.itemsize, int(end - first[0]) * word.itemsize), word)["v"].astype(np.int64) - 1
            columns = [ids, pa.ListArray.from_arrays(pa.array((first - first[0]).astype(np.int32)), pa.array(v))]
        else:
            width = got["x"].shape[1]
            columns = [ids, pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * width).astype(np.int32)), pa.array(got["x"].ravel().astype(np.float64)))]
        if "ref" in (kind.names or ()):
            columns.append(pa.array(got["ref"].astype(np.int64) - 1))
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema_of(self.section).split(", ")])


@dataclass
class Written(WriterCommitMessage):
    task: int
    name: str


class PartsWriter(DataSourceArrowWriter):
    """Writes rows (section, id, x, n, raw), dealt by range and sorted by section and id, as parts of one file."""

    def __init__(self, path: str, names: list[str], header: Header):
        self.path, self.names, self.header = path, names, header

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        store, at = file_system(self.path)
        store.create_dir(at)
        name = f"{at}/tmp-{task.partitionId():05d}-{uuid.uuid4().hex}"
        with store.open_output_stream(name) as out:
            for batch in iterator:
                section = np.asarray(batch.column(0))
                cuts = np.flatnonzero(np.diff(section)) + 1
                for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(section)], strict=True):
                    if high > low:
                        self._rows(out, self.names[section[low]], batch.slice(low, high - low))
        return Written(task.partitionId(), name)

    def _rows(self, out, section: str, part: pa.RecordBatch) -> None:
        raw = part.column(4).to_pylist()
        heads = [b for b in raw if b is not None]
        for b in heads:
            out.write(b)
        part = part.slice(len(heads))  # a section's head comes first
        if not part.num_rows:
            return
        kind = row_type(section, self.header, self.header.sections[CODES[section]].types) if section not in ("begin", "end") else None
        rows = np.zeros(part.num_rows, kind)
        x, n = (np.asarray(part.column(k).flatten()) for k in (2, 3))
        if "x" in kind.names:
            rows["x"] = x.reshape(rows["x"].shape)
        n = n.reshape(part.num_rows, -1)
        if "v" in kind.names:
            rows["v"] = n[:, : rows["v"].shape[1]] if rows["v"].ndim == 2 else n[:, 0]
        if "first" in kind.names:
            rows["first"] = n[:, 0]
        if "ref" in kind.names:
            rows["ref"] = n[:, -1]
        out.write(rows.tobytes())

    def commit(self, messages: list[Written | None]) -> None:
        store, at = file_system(self.path)
        for f in store.get_file_info(fs.FileSelector(at)):
            if f.base_name.startswith("part-"):
                store.delete_file(f.path)
        for m in filter(None, messages):
            store.move(m.name, f"{at}/part-{m.task:05d}.meshb")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        store, at = file_system(self.path)
        for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith("tmp-"):
                store.delete_file(f.path)


class MeshSource(DataSource):
    """Format `binary_mesh`; options: path, section, and rows (of a split)."""

    @classmethod
    def name(cls) -> str:
        return "binary_mesh"

    def schema(self) -> str:
        return schema_of(self.options["section"])

    def reader(self, schema) -> SectionReader:
        return SectionReader(self.options["path"], self.options["section"], int(self.options.get("rows", SPLIT)))

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        version, dimension, *sections = self.options["layout"].split(";")
        header = Header(int(version), int(dimension), {})
        for s in sections:
            code, *types = map(int, s.split(","))
            header.sections[code] = Section(code, 0, 0, tuple(types))
        return PartsWriter(self.options["path"], self.options["names"].split(","), header)


def read_section(spark: SparkSession, path: str, section: str, rows: int = SPLIT) -> DataFrame:
    spark.dataSource.register(MeshSource)
    return spark.read.format("binary_mesh").option("section", section).option("rows", rows).load(path)


def read_binary(spark: SparkSession, path: str, rows: int = SPLIT) -> Mesh:
    """A mesh from its binary form; ids are places from 0."""
    get = lambda s: read_section(spark, path, s, rows)
    return Mesh(get("vertices"), get("triangles"), get("quads"), get("polygons"), get("lines"))


def read_solution(spark: SparkSession, path: str, at_vertices: bool = True, rows: int = SPLIT) -> DataFrame:
    """id, values of a solution at vertices or triangles."""
    return read_section(spark, path, "at_vertices" if at_vertices else "at_triangles", rows)


def _write(spark: SparkSession, path: str, dimension: int, sections: list[tuple[str, DataFrame, tuple[int, ...]]], parts: int | None) -> None:
    """sections: name, rows (id, x, n), types of a solution's values."""
    rows = None
    for k, (_, df, _) in enumerate(sections, 1):
        own = df.select(F.lit(k).alias("section"), "id", F.col("x").cast("array<double>").alias("x"), F.col("n").cast("array<long>").alias("n"), F.lit(None).cast("binary").alias("raw"))
        rows = own if rows is None else rows.unionByName(own)
    rows = checkpointed(rows)
    counts = {r["section"]: r["count"] for r in rows.groupBy("section").count().collect()}
    version = 4 if max([0, *counts.values()]) >= (1 << 31) - 1 else 3
    header = Header(version, dimension, {})
    number = "<i" if version < 4 else "<q"
    heads, at = [(0, -1, struct.pack("<iiiqi", 1, version, CODES["dimension"], 24, dimension))], 24
    for k, (name, _, types) in enumerate(sections, 1):
        n = counts.get(k, 0)
        told = struct.pack(number, n) + (struct.pack(f"<{len(types) + 1}i", len(types), *types) if types else b"")
        header.sections[CODES[name]] = Section(CODES[name], n, at + 12 + len(told), types)
        after = at + 12 + len(told) + n * row_type(name, header, types).itemsize
        heads.append((k, -1, struct.pack("<iq", CODES[name], after) + told))
        at = after
    heads.append((len(sections) + 1, -1, struct.pack("<iq", CODES["end"], 0)))
    made = spark.createDataFrame(heads, "section int, id long, raw binary").select("section", "id", F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("array<long>").alias("n"), "raw")
    every = rows.unionByName(made)
    dealt = every.repartitionByRange(parts, "section", "id") if parts else every.repartitionByRange("section", "id")
    layout = ";".join([str(version), str(dimension), *[",".join(map(str, (s.code, *s.types))) for s in header.sections.values()]])
    spark.dataSource.register(MeshSource)
    out = dealt.sortWithinPartitions("section", "id").write.format("binary_mesh").mode("overwrite")
    out.option("layout", layout).option("names", ",".join(["begin", *[s for s, _, _ in sections], "end"])).save(path)


def write_binary(mesh: Mesh, path: str, parts: int | None = None) -> None:
    """A mesh as a folder of parts, sections by id; ids of vertices must be their places from 0, as corners name them."""
    nothing = F.lit(None)
    ref = lambda df: (F.coalesce(F.col("group"), F.lit(-1)) + 1 if "group" in df.columns else F.lit(0)).cast("long")
    sections = [("vertices", mesh.vertices.select("id", F.array("x", "y", "z").alias("x"), F.array(ref(mesh.vertices)).alias("n")), ())]
    for name, df in (("lines", mesh.lines), ("triangles", mesh.triangles), ("quads", mesh.quads)):
        if df is not None:
            sections.append((name, df.select("id", nothing.alias("x"), F.array(*[F.col(f"v{k}") + 1 for k in range(CORNERS[name])], ref(df)).alias("n")), ()))
    if mesh.polygons is not None:
        corner = mesh.polygons.select("id", ref(mesh.polygons).alias("ref"), F.posexplode("vertices").alias("pos", "v"))
        corner = checkpointed(numbered(corner, ["id", "pos"], "at"))
        first = corner.groupBy("id").agg(F.min("at").alias("at"), F.first("ref").alias("ref"))
        sections.append(("polygons", first.select("id", nothing.alias("x"), F.array(F.col("at") + 1, "ref").alias("n")), ()))
        sections.append(("polygon_vertices", corner.select(F.col("at").alias("id"), nothing.alias("x"), F.array(F.col("v") + 1).alias("n")), ()))
    _write(mesh.vertices.sparkSession, path, 3, sections, parts)


def write_solution(values: DataFrame, columns: list[str], path: str, at_vertices: bool = True, parts: int | None = None) -> None:
    """A scalar (one column), a vector (three) or a symmetric tensor (six) for every id, as a folder of parts."""
    kind = {1: 1, 3: 2, 6: 3}[len(columns)]
    rows = values.select("id", F.array(*columns).alias("x"), F.array().cast("array<long>").alias("n"))
    _write(values.sparkSession, path, 3, [("at_vertices" if at_vertices else "at_triangles", rows, (kind,))], parts)
