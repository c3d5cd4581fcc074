"""Exact top-k search by distributed selection in score histograms.

Queries are scored against all rows, in blocks: queries and candidates are dealt to
blocks by hash, and each task scores one block of queries against one of candidates.
A round counts the scores of every query in BINS equal bins of its range; summed over
all tasks, the counts tell the bin of the kth highest score, which is the next round's
range. With BINS = 1,024 and scores of 18 bits the kth value is known after two rounds,
and one more scoring lets pass what lies above it and, of the ties at it, the least ids.

A task sends at most k bins a query: the kth highest of all is not below the kth
highest of the task's own, so its lower bins can't matter. Of ties a task sends as many
as are wanted. So neither scores nor large groups of ties leave a task.

Components become floor(scale * x) as double, whole numbers. By Cauchy-Schwarz no
partial sum of a score exceeds the largest squared length, which tells whether products
in single precision are exact, or in double, or whether Python's integers are needed.

Nulls and edges: vectors that are null or hold null or non-finite components (or
components that scale makes infinite) take no part; vectors meet those with the same
number of components only; rows that repeat an id are queries and candidates of their
own, so a query's own row is left out once (rows of an id are told apart by a 64-bit
hash of the vector); rows without an id are candidates, last among ties; scores
beyond a long are set to its ends; no queries or no candidates, no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import checkpointed, quoted

BITS = 10
BINS = 1 << BITS
#: Rows of a block of queries or candidates, at most about, and those below which a block isn't split further.
BLOCK, LEAST = 8192, 512
#: Scores that a task holds at once.
TILE = 1 << 20
LONG = 1 << 63


def blocks(rows: int, wanted: int) -> int:
    """Number of blocks: of at most about BLOCK rows, and as many as are wanted while they hold LEAST."""
    return max(-(-rows // BLOCK), min(-(-rows // LEAST), wanted), 1)


def prepared(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, h, dim, copies, v: each different row that takes part, and how often it is there."""
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).alias("v"))
    unfit = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double") * scale) == float("inf"))
    rows = rows.filter("v IS NOT NULL").filter(~F.exists("v", unfit))
    rows = rows.groupBy("id", "v").agg(F.count("*").alias("copies"))
    return rows.select("id", F.xxhash64("v").alias("h"), F.size("v").alias("dim"), "copies", "v")


def whole(vectors: pa.Array, dim: int, scale: int, kind: type) -> np.ndarray:
    """Rows of whole numbers, in a type that holds their products exactly."""
    x = np.floor(np.asarray(vectors.flatten(), dtype=np.float64) * scale).reshape(len(vectors), dim)
    return np.array([[int(c) for c in r] for r in x], dtype=object).reshape(x.shape) if kind is object else x.astype(kind)


def scored(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    s = q @ c.T
    if s.dtype == object:
        return np.array([[min(max(int(x), -LONG), LONG - 1) for x in r] for r in s], dtype=object).reshape(s.shape)
    return s.astype(np.int64)


COLUMNS = ("id", "h", "copies", "v", "lo", "above")


def tiles(table: pa.Table, scale: int, kind: type):
    """(queries, candidates) as dicts of arrays, then for runs of queries: first row, end, scores, column of each one's own row or -1."""
    dim = table["dim"][0].as_py()
    at_query = table["lo"].is_valid()
    both = []
    for part in (table.filter(at_query), table.filter(pc.invert(at_query)).sort_by([("id", "ascending"), ("h", "ascending")])):
        arrays = {c: part[c].combine_chunks() for c in COLUMNS}
        both.append({"x": whole(arrays.pop("v"), dim, scale, kind)} | {"ids": arrays["id"]} | {c: a.to_numpy(zero_copy_only=False) for c, a in arrays.items() if c != "id"})
    q, c = both
    place = {k: i for i, k in enumerate(zip(c["ids"].to_pylist(), c["h"].tolist(), strict=True))}
    own = np.array([place.get(k, -1) for k in zip(q["ids"].to_pylist(), q["h"].tolist(), strict=True)], dtype=np.int64)

    def runs():
        step = max(1, TILE // max(1, len(c["x"])))
        for a in range(0, len(q["x"]) if len(c["x"]) else 0, step):
            b = min(a + step, len(q["x"]))
            yield a, b, scored(q["x"][a:b], c["x"]), own[a:b]

    return q, c, runs()


class Grid:
    """Blocks of queries against blocks of candidates."""

    def __init__(self, rows: DataFrame, queries: DataFrame, n: int, n_queries: int, scale: int, kind: type):
        wanted = 2 * rows.sparkSession.sparkContext.defaultParallelism
        self.rows, self.queries, self.scale, self.kind = rows, queries, scale, kind
        self.by_rows, self.by_queries = blocks(n, wanted), blocks(n_queries, 1)

    def dealt(self, state: DataFrame) -> DataFrame:
        """Each candidate for every block of queries, each query with its state for every block of candidates."""
        every = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
        own = lambda count, name: F.pmod(F.xxhash64("id", "h"), F.lit(count)).cast("int").alias(name)
        none = F.lit(None).cast("long")
        c = self.rows.select("dim", every(self.by_queries, "qb"), own(self.by_rows, "cb"), "id", "h", "copies", "v", none.alias("lo"), none.alias("above"))
        q = self.queries.join(state, ["id", "h"]).select("dim", own(self.by_queries, "qb"), every(self.by_rows, "cb"), "id", "h", "copies", "v", "lo", "above")
        tasks = self.by_rows * self.by_queries
        return c.unionByName(q).repartition(max(tasks, min(4 * tasks, 1000)), "dim", "qb", "cb").groupBy("dim", "qb", "cb")

    def counted(self, state: DataFrame, bits: int, k: int) -> DataFrame:
        """id, h, low, n: low ends and counts of the highest bins of each query's range of 2^bits scores from lo on, until k are counted with those above it."""
        schema = "id long, h long, low long, n long"
        out = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("low", pa.int64()), ("n", pa.int64())])
        shift, scale, kind = max(bits - BITS, 0), self.scale, self.kind

        def run(table: pa.Table) -> pa.Table:
            q, c, runs = tiles(table, scale, kind)
            found = []
            for a, b, s, own in runs:
                # What lies above the range has been counted; what lies below can't matter.
                bins = (s - q["lo"][a:b, None].astype(s.dtype)) >> shift
                inside = (bins >= 0) & (bins < 1 << min(bits, BITS))
                r, col = np.nonzero(inside)
                at = bins[r, col].astype(np.int64)
                n = np.bincount(r * BINS + at, weights=c["copies"][col], minlength=(b - a) * BINS).astype(np.int64).reshape(b - a, BINS)
                mine = np.flatnonzero(own >= 0)
                mine = mine[inside[mine, own[mine]]]
                n[mine, bins[mine, own[mine]].astype(np.int64)] -= 1
                before = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
                r, at = np.nonzero((n > 0) & (before < (k - q["above"][a:b])[:, None]))
                found.append((a + r, at, n[r, at]))
            if not found:
                return out.empty_table()
            r, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.table([q["ids"].take(pa.array(r)), pa.array(q["h"][r]), pa.array(q["lo"][r] + (at << shift)), pa.array(n)], schema=out)

        return self.dealt(state).applyInArrow(run, schema)

    def passed(self, state: DataFrame, k: int) -> DataFrame:
        """id, h, vec_id, score, copies of what lies above each query's lo, and of the least ids at it as many as are wanted."""
        schema = "id long, h long, vec_id long, score long, copies long"
        out = pa.schema([(c, pa.int64()) for c in ("id", "h", "vec_id", "score", "copies")])
        scale, kind = self.scale, self.kind

        def run(table: pa.Table) -> pa.Table:
            q, c, runs = tiles(table, scale, kind)
            found = []
            for a, b, s, own in runs:
                lo, need = q["lo"][a:b], k - q["above"][a:b]
                mask = s >= lo[:, None]
                mine = np.flatnonzero(own >= 0)
                alone = mine[c["copies"][own[mine]] == 1]
                mask[alone, own[alone]] = False
                r, col = np.nonzero(mask)  # by query, then by id
                score = s[r, col].astype(np.int64)
                tie = score == lo[r]
                ties = np.cumsum(tie)
                first = np.searchsorted(r, r)
                rank = ties - ties[first] + tie[first]  # of a tie among the query's own, from 1
                keep = ~tie | (rank <= need[r])
                r, col, score = r[keep], col[keep], score[keep]
                found.append((a + r, col, score, c["copies"][col] - (col == own[r])))
            if not found:
                return out.empty_table()
            r, col, score, copies = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.table([q["ids"].take(pa.array(r)), pa.array(q["h"][r]), c["ids"].take(pa.array(col)), pa.array(score), pa.array(copies)], schema=out)

        return self.dealt(state).applyInArrow(run, schema)


def narrowed(state: DataFrame, counted: DataFrame, k: int) -> DataFrame:
    """The state with each query's range cut to the bin of its kth highest score; as it was where there are fewer than k in all."""
    key = Window.partitionBy("id", "h").orderBy(F.desc("low"))
    sums = counted.groupBy("id", "h", "low").agg(F.sum("n").alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(key)).join(state, ["id", "h"])
    held = sums.filter((F.col("upto") >= k - F.col("above")) & (F.col("upto") - F.col("n") < k - F.col("above")))
    held = held.select("id", "h", F.col("low").alias("to"), (F.col("above") + F.col("upto") - F.col("n")).alias("over"))
    return state.join(held, ["id", "h"], "left").select("id", "h", F.coalesce("to", "lo").alias("lo"), F.coalesce("over", "above").alias("above"))


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query row against all other rows, ties to the smaller id.

    is_query: a condition on the column `id`.
    """
    if k < 1 or scale < 1:
        raise ValueError("k and scale must be at least 1")
    rows = checkpointed(prepared(vectors, id_col, vector_col, scale))
    queries = rows.filter(is_query & F.col("id").isNotNull())
    square = F.aggregate("v", F.lit(0.0), lambda t, c: t + F.pow(F.abs(c.cast("double") * scale) + 1, 2.0))  # of floors, or more
    told = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(square).alias("most")).first()
    if not told["q"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = told["most"] * (1 + 1e-9) + 1
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 52 else object
    bits = 64 if most >= 1 << 62 else math.frexp(most)[1] + 1
    grid = Grid(rows, queries, told["n"], told["q"], scale, kind)
    state = queries.select("id", "h", F.lit(-(1 << (bits - 1))).cast("long").alias("lo"), F.lit(0).cast("long").alias("above"))
    while True:
        state = checkpointed(narrowed(state, grid.counted(state, bits, k), k))
        if bits <= BITS:
            break
        bits -= BITS
    order = Window.partitionBy("id", "h").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = grid.passed(state, k).withColumn("_", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("copies")
    again = best.join(queries.select("id", "h", F.col("copies").alias("times")), ["id", "h"])
    return again.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times")))).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
