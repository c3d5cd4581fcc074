"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ordering import Rounds


#: Links that a task gathers at once.
HELD = 500_000


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) that join the same nodes as those given: each node with the least one that a run of HELD links joins it to."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        ends = np.concatenate([b.column(c).to_numpy() for c in (0, 1) for b in held])
        names, at = np.unique(ends, return_inverse=True)
        p, q = at[: len(at) // 2], at[len(at) // 2 :]
        least = np.arange(len(names))
        while len(p):
            low = np.minimum(least[p], least[q])
            for end in (p, q):
                np.minimum.at(least, least[end], low)
            while not np.array_equal(least, further := least[least]):
                least = further
            apart = least[p] != least[q]
            p, q = p[apart], q[apart]
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[least])], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > HELD:
            yield out()
            held = []
    if held:
        yield out()


def components(edges: DataFrame, gather: bool = False) -> DataFrame:
    """id, label (least id reachable) of every node of edges (a, b); null ends are left out.

    A large star links the greater neighbours of a node to the least node it knows,
    a small star does so with the lesser ones. Edges never grow in number, and each
    pair of stars shortens paths at least to about half, so a path of n nodes takes
    about log n rounds. Least ids are summed up before they are shuffled, and a node
    with very many neighbours only meets one row in a join, which can be split.
    gather: before the first round tasks gather links of nodes with like ids, which shortens the paths of
    graphs whose ids follow their shape, like meshes.
    """
    rounds = Rounds(edges.sparkSession)
    ends = F.array(*[F.struct(u.alias("u"), v.alias("v")) for u, v in ((F.greatest("a", "b"), F.least("a", "b")), (F.col("a"), F.col("a")), (F.col("b"), F.col("b")))])
    links = rounds.next(edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.explode(ends).alias("e")).select("e.*").distinct())
    if gather and links.schema["u"].dataType == T.LongType() == links.schema["v"].dataType:
        ranged = links.repartitionByRange("u").sortWithinPartitions("u")
        links = rounds.next(ranged.mapInArrow(_gathered, "u long, v long").distinct())
    before = None
    while (now := links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()) != before:
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        known = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v >= u").join(known, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = rounds.next(least.select("u", F.col("m").alias("v")).unionByName(small).distinct())
    return links.select(F.col("u").alias("id"), F.col("v").alias("label"))
