"""Embedding near-duplicates by tiles of vectors that tasks read.

Unit vectors have a cosine of at least c exactly where their squared distance is
at most D = 2 (1 - c). The vectors are rotated to the principal axes of a bounded
sample; the squared distance over the first axes alone, one dense product in single
precision, rules most pairs out. As many axes are taken as leave few pairs of the
sample. What passes is tested over all axes and verified with the full unit vectors in
double precision.

Representatives are written once. A task holds a tile of them and reads half of the others
(a tile meets those that follow it in a ring), so every pair meets in one task, nothing
is copied or shuffled for it, and tasks are alike whatever the spread. The work is the
square of the representatives; the disk is in proportion to them.

Pairs don't leave the task that verifies them: a vector gets the number of its
links there and a vector that these links join it to. Numbers add up,
and the joins make the components over all tasks.

Equal unit vectors (bit for bit; told by 128 bits of hashes) are joined as one
representative with a count, so copies cost nothing.

Nulls and edges: null vectors, and ones with null or non-finite components or no
length, link with nothing and form components of their own; vectors of another
number of components than most never meet them (each number is its own join);
repeated rows of an id are separate vectors with the same id.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import checkpointed, quoted
from tessera.operators.graphs import components
from tessera.operators.stored import Files, batches, stored

COSINE = 0.95
#: Bytes of a task's tile of vectors, about.
TILE_BYTES = 16_000_000
#: Vectors of the sample that the rotation is fitted on.
SAMPLE = 4_000
#: Share of the sample's pairs that the first axes may leave.
LEFT = 1e-3
#: Slack of the single-precision filter; what passes is verified in double precision.
SLACK = 1e-5
#: Rows of a tile and of what it meets that are compared at once, and links that are joined at once.
HELD_ROWS, MET_ROWS, JOINED = 256, 2048, 1 << 20
#: Components that a task turns or verifies at once.
AT_ONCE = 1 << 20


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows, and which have one."""
    with np.errstate(all="ignore"):
        x = x.astype(np.float64)
        # Scaled by the largest component first, so that squares neither overflow nor vanish.
        big = np.abs(x).max(axis=1)
        ok = np.isfinite(x).all(axis=1) & (big > 0)
        x /= big[:, None]
        size = np.zeros(len(x))
        for k in range(x.shape[1]):
            size += x[:, k] * x[:, k]
        x /= np.sqrt(size)[:, None]
        return x + 0.0, ok


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, h1, h2 (hashes of the unit vector), d (components), raw (the vector's bytes); all but id null where it can't link."""
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    rows = vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).cast("array<float>" if single else "array<double>").alias("v"))
    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("d", T.IntegerType()), T.StructField("raw", T.BinaryType())]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p.slice(k, 2048) for p in parts for k in range(0, p.num_rows, 2048)):
            ids, lists = batch.column(0), batch.column(1)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            hashes, raw = np.zeros((len(sizes), 2), dtype=np.int64), [None] * len(sizes)
            for d in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == d)
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                u, ok = units(x)
                for k, row in zip(at[ok].tolist(), np.flatnonzero(ok).tolist(), strict=True):
                    hashes[k] = np.frombuffer(blake2b(u[row].tobytes(), digest_size=16).digest(), np.int64)
                    raw[k] = x[row].tobytes()
            none = np.array([r is None for r in raw], dtype=bool)
            arrays = [ids, *[pa.array(hashes[:, k], mask=none) for k in (0, 1)], pa.array(sizes.astype(np.int32), mask=none), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "h1", "h2", "d", "raw"])

    return rows.mapInArrow(run, schema)


def rotation(representatives: DataFrame, dim: int, budget: float) -> tuple[np.ndarray, int]:
    """Principal axes of a bounded sample, the widest first, and how many of them rule out most of its pairs."""
    sample = [r["raw"] for r in representatives.orderBy("h1", "h2").limit(SAMPLE).select("raw").collect()]
    x, _ = units(_vectors(sample, dim))
    if len(x) < 2:
        return np.eye(dim), dim
    _, axes = np.linalg.eigh(np.cov(x.T).reshape(dim, dim) + 1e-9 * np.eye(dim))
    turn = np.ascontiguousarray(axes[:, ::-1])
    y = (x[: SAMPLE // 2] @ turn).astype(np.float32)
    gap = np.zeros((len(y), len(y)), dtype=np.float32)
    near = []
    for k in range(0, dim, 8):
        part = y[:, k : k + 8]
        size = (part * part).sum(axis=1)
        gap += size[:, None] + size - 2 * part @ part.T
        near.append(((gap <= budget + SLACK).sum() - len(y)) / gap.size)
    axes_taken = next(k for k, share in enumerate(near) if share <= near[-1] + LEFT)
    return turn, min(dim, 8 * axes_taken + 8)


def _vectors(raw: list[bytes] | pa.Array, dim: int) -> np.ndarray:
    """The rows of vectors given by their bytes, of single or double precision."""
    raw = raw if isinstance(raw, list) else raw.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=np.float32 if raw and len(raw[0]) == 4 * dim else np.float64).reshape(len(raw), dim)


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (for each row the least row of its group) with the groups of rows i and j made one, link by link."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


class _Rows:
    """Vectors of a run of representatives: their bytes, their places on the rotated axes, and both sides of the product that tells distances over the first axes."""

    def __init__(self, parts: list[pa.RecordBatch], turn: np.ndarray, axes: int):
        table = pa.Table.from_batches(parts)
        self.keys, self.copies = table["key"].combine_chunks(), np.asarray(table["copies"].combine_chunks(), dtype=float)
        self.raw = np.concatenate([_vectors(b.column("raw"), len(turn)) for b in parts])
        step = max(1, AT_ONCE // len(turn))
        self.at = np.concatenate([(units(self.raw[k : k + step])[0] @ turn).astype(np.float32) for k in range(0, len(self.raw), step)])
        first, one = self.at[:, :axes], np.ones((len(self.at), 1), dtype=np.float32)
        size = (first * first).sum(axis=1, keepdims=True)
        self.left, self.right = np.hstack([-2 * first, size, one]), np.hstack([first, one, size])
        self.others = np.zeros(len(self.at))

    def __len__(self) -> int:
        return len(self.at)


def _set(mask: np.ndarray) -> np.ndarray:
    """Places of the few that hold, looked for eight at a time."""
    if mask.size % 8:
        return np.flatnonzero(mask)
    some = np.flatnonzero(mask.reshape(-1).view(np.uint64))
    at, k = np.nonzero(mask.reshape(-1, 8)[some])
    return 8 * some[at] + k


def _linked(u: np.ndarray, w: np.ndarray, cosine: float) -> np.ndarray:
    return np.einsum("nd,nd->n", u, w) >= cosine


def _near(held: _Rows, m: int, met: _Rows, k: int, axes: int, cosine: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of held (from m on) and of met (from k on) that can be linked, HELD_ROWS by MET_ROWS of them, and whether they are."""
    budget = np.float32(2 * (1 - cosine) + SLACK)
    h, o = slice(m, m + HELD_ROWS), slice(k, k + MET_ROWS)
    gap = held.left[h] @ met.right[o].T
    hit = _set(gap <= budget)
    if 16 * len(hit) > gap.size:  # a crowd: all at once, and one by one what is too close to call
        u, w = units(held.raw[h])[0], units(met.raw[o])[0]
        score = u @ w.T
        ok = score >= cosine
        i, j = np.nonzero(np.abs(score - cosine) < 1e-9)
        ok[i, j] = _linked(u[i], w[j], cosine)
        i, j = np.nonzero(ok)
        return m + i, k + j, True
    found = [hit[:0]]
    step = max(1, AT_ONCE // held.at.shape[1])
    for c in range(0, len(hit), step):
        i, j = np.divmod(hit[c : c + step], gap.shape[1])
        rest = held.at[m + i, axes:] - met.at[k + j, axes:]
        found.append(hit[c : c + step][gap[i, j] + (rest * rest).sum(axis=1) <= budget])
    i, j = np.divmod(np.concatenate(found), gap.shape[1])
    return m + i, k + j, False


def _met(held: _Rows, root: np.ndarray, met: _Rows, axes: int, cosine: float) -> np.ndarray:
    """root of the held rows and those they meet (maybe themselves), by all links between both; these are counted."""
    own = met is held
    shift = 0 if own else len(held)
    root = root if own else np.concatenate([root, shift + np.arange(len(met))])
    links: dict[bool, list] = {True: [], False: []}
    kept = 0

    def joined(root: np.ndarray) -> np.ndarray:
        for sure, found in links.items():
            i, j = (np.concatenate([f[side] for f in found]) for side in (0, 1)) if found else (np.empty(0, int),) * 2
            found.clear()
            if not sure:
                step = max(1, AT_ONCE // held.at.shape[1])
                ok = [_linked(units(held.raw[i[c : c + step]])[0], units(met.raw[j[c : c + step]])[0], cosine) for c in range(0, len(i), step)]
                i, j = (x[np.concatenate(ok)] if ok else x for x in (i, j))
            held.others += np.bincount(i, weights=met.copies[j], minlength=len(held))
            met.others += np.bincount(j, weights=held.copies[i], minlength=len(met))
            root = _joined(root, i, shift + j)
        return root

    for m in range(0, len(held), HELD_ROWS):
        for k in range(m // MET_ROWS * MET_ROWS if own else 0, len(met), MET_ROWS):
            i, j, sure = _near(held, m, met, k, axes, cosine)
            if own:
                i, j = i[i < j], j[i < j]
            if len(i):
                links[sure].append((i, j))
                kept += len(i)
            if kept > JOINED:
                root, kept = joined(root), 0
    return joined(root)


def tile_links(spark, files: Files, turn: np.ndarray, axes: int, cosine: float, kind: T.DataType) -> DataFrame:
    """key, others (links, copies counted), root (a key that these join it to) of linked representatives, by tile and what it meets."""
    dim, total = len(turn), sum(n for _, n in files)
    wanted = max(2 * spark.sparkContext.defaultParallelism, -(-total * 8 * dim // TILE_BYTES))
    tile = max(1, -(-total // wanted))
    count = -(-total // tile)
    schema = T.StructType([T.StructField("key", kind), T.StructField("others", T.LongType()), T.StructField("root", kind)])
    columns = ["key", "copies", "raw"]

    def told(rows: _Rows, root: np.ndarray, held: _Rows) -> pa.RecordBatch:
        on = np.flatnonzero(rows.others)
        return pa.RecordBatch.from_arrays([rows.keys.take(pa.array(on)), pa.array(rows.others[on].astype(np.int64)), held.keys.take(pa.array(root[on]))], names=["key", "others", "root"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in (t for p in parts for t in p.column(0).to_pylist()):
            held = _Rows(list(batches(files, columns, t * tile, (t + 1) * tile)), turn, axes)
            root = _met(held, np.arange(len(held)), held, axes, cosine)
            # Half of the ring; of two tiles opposite each other the first meets the second.
            last = t + (count - 1) // 2 + (count % 2 == 0 and t < count // 2)
            for low, high in ((t + 1, min(last + 1, count)), (0, last + 1 - count)):
                for batch in batches(files, columns, low * tile, high * tile, max(MET_ROWS, AT_ONCE // dim)) if low < high else ():
                    met = _Rows([batch], turn, axes)
                    both = _met(held, root, met, axes, cosine)
                    root = both[: len(held)]  # a group with links has held rows, which are numbered first
                    yield told(met, both[len(held) :], held)
            yield told(held, root, held)

    return spark.range(0, count, 1, count).mapInArrow(run, schema)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    read = unit_rows(vectors, id_col, vector_col)
    rows = checkpointed(read.select("id", "h1", "h2"))
    # Equal vectors are one representative, keyed by its least id.
    reps = read.filter("raw IS NOT NULL AND id IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("key"), F.count("*").alias("copies"), F.first("d").alias("d"), F.first("raw").alias("raw"))
    reps, files = stored(reps)
    dims = [r["d"] for r in reps.groupBy("d").count().orderBy("d").collect()]
    found = rows.select(F.col("id").alias("key"), F.lit(0).cast("long").alias("others"), F.col("id").alias("root")).limit(0)
    for dim in dims:
        of, its = (reps, files) if len(dims) == 1 else stored(reps.filter(F.col("d") == dim))
        found = found.unionByName(tile_links(vectors.sparkSession, its, *rotation(of, dim, 2 * (1 - cosine)), cosine, rows.schema["id"].dataType))
    found = checkpointed(found)
    degree = found.groupBy("key").agg(F.sum("others").alias("others")).withColumnRenamed("key", "linked")
    labels = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    told = (
        reps.join(degree, reps["key"] == degree["linked"], "left")
        .join(labels, reps["key"] == labels["id"], "left")
        .select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "key").alias("component_id"))
    )
    # Vectors that can't link have no hashes and no representative.
    out = rows.join(checkpointed(told), ["h1", "h2"], "left")
    out = out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
