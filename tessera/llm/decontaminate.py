"""Benchmark decontamination with a broadcast hash set of test n-grams.

A benchmark text gives its windows of 10 consecutive words (a shorter text with
words gives one window of all its words). Windows live in a sorted array of
64-bit hashes that is broadcast; a scan hashes every window of the training
texts, looks it up and compares the words themselves before it counts.

The broadcast is bounded: the distinct (window, item) pairs are dealt into
blocks of at most about BLOCK_PAIRS, and the documents pass the blocks one after
the other, written to the checkpoint folder between two blocks.

Nulls and edges: a null or empty text has no words and is never contaminated; an
item without words has no windows; an item whose id is null counts for hits but
is not listed; repeated items count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import add_columns, as_bytes, checkpointed, quoted, words

WINDOW = 10
BLOCK_PAIRS = 100_000
# The words of a text before it is lower-cased.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (window, item): the window's words joined by spaces, the item's id as a string."""
    source = benchmark.select(F.col(quoted(id_col)).cast("string").alias("item"), F.col(quoted(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, items = [], []
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                w = words(text)
                got = {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else ()
                found.extend(got)
                items.extend(repeat(item, len(got)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()).cast(pa.string()), pa.array(items, pa.string())], names=["window", "item"]
            )

    return source.mapInArrow(run, "window string, item string").distinct()


class WindowIndex:
    """Lookup of one block of windows: word ids, and for each window length a sorted hash array."""

    def __init__(self, pairs: list[tuple[str, str | None]]):
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for window, item in pairs:
            key = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in window.encode().split(b" "))
            owners.setdefault(key, set()).update([] if item is None else [item])
        self.by_length = []
        for n in sorted({len(k) for k in owners}):
            keys = [k for k in owners if len(k) == n]
            ids = np.array(keys, dtype=np.int64)
            base = 0x9E3779B97F4A7C15
            while True:
                powers = np.array([pow(base, i + 1, 1 << 64) for i in range(n)], dtype=np.uint64)
                hashes = (ids.astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64)
                order = np.argsort(hashes)
                if len(np.unique(hashes)) == len(hashes):
                    break
                base += 2
            self.by_length.append((n, powers, hashes[order], ids[order], [sorted(owners[keys[i]]) for i in order]))

    def scan(self, texts: list[bytes | None], before: list | None) -> tuple[list[int], list[list[dict]], list[set[str]]]:
        """For each text its number of words, its merged hit spans (words, last exclusive) and the items found."""
        each = [words(t) for t in texts]
        counts = [len(w) for w in each]
        size = sum(counts) + len(each)
        # A zero after each text keeps windows from crossing into the next one.
        ids = np.fromiter(map(self.vocab.get, chain.from_iterable(w + [b""] for w in each), repeat(0)), np.int64, size)
        starts = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64) + 1)])
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        change = np.zeros(size + 1, dtype=np.int64)
        items: list[set[str]] = [set() for _ in each]
        for n, powers, hashes, known, owners in self.by_length:
            if size < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(at):
                continue
            h = np.zeros(len(at), dtype=np.uint64)
            for k in range(n):
                h += ids[at + k].astype(np.uint64) * powers[k]
            pos = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[pos] == h
            at, pos = at[same], pos[same]
            if len(at):
                real = (ids[at[:, None] + np.arange(n)] == known[pos]).all(axis=1)
                at, pos = at[real], pos[real]
            np.add.at(change, at, 1)
            np.add.at(change, at + n, -1)
            of = np.searchsorted(starts, at, side="right") - 1
            for d, p in set(zip(of.tolist(), pos.tolist(), strict=True)):
                items[d].update(owners[p])
        for d, spans in enumerate(before or ()):
            for s in spans or ():
                change[starts[d] + s["first"]] += 1
                change[starts[d] + s["last"]] -= 1
        hit = np.concatenate([[0], np.cumsum(change[:-1]) > 0, [0]]).astype(np.int8)
        edges = np.diff(hit)
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        spans: list[list[dict]] = [[] for _ in each]
        for d, a, b in zip((np.searchsorted(starts, first, side="right") - 1).tolist(), first.tolist(), last.tolist(), strict=True):
            spans[d].append({"first": a - int(starts[d]), "last": b - int(starts[d])})
        return counts, spans, items


def flag(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_pairs: int = BLOCK_PAIRS, keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, hit_spans (merged word ranges, last exclusive), items (found ids as sorted strings)."""
    pairs = benchmark_windows(benchmark, item_col, item_text_col, window)
    blocks = 1
    collected = pairs.limit(block_pairs + 1).collect()
    if len(collected) > block_pairs:
        pairs = checkpointed(pairs)
        blocks = -(-pairs.count() * 5 // (block_pairs * 4))
    out = docs
    for k in range(blocks):
        if blocks > 1:
            collected = pairs.filter(F.expr(f"pmod(xxhash64(window), {blocks})") == k).collect()
        index = docs.sparkSession.sparkContext.broadcast(WindowIndex([(r["window"], r["item"]) for r in collected]))
        again = k > 0

        def kernel(x: dict[str, pa.Array], index=index, again=again) -> dict[str, object]:
            counts, spans, items = index.value.scan(as_bytes(x[text_col]), x["hit_spans"].to_pylist() if again else None)
            if again:
                items = [a.union(b or ()) for a, b in zip(items, x["items"].to_pylist(), strict=True)]
            return {"n_words": counts, "hit_spans": spans, "items": [sorted(i) for i in items]}

        out = add_columns(
            out,
            [text_col] + (["hit_spans", "items"] if again else []),
            [
                T.StructField("n_words", T.LongType()),
                T.StructField("hit_spans", _SPANS),
                T.StructField("items", T.ArrayType(T.StringType())),
            ],
            kernel,
            keep=None if k + 1 < blocks else keep,
        )
        if k + 1 < blocks:
            out = checkpointed(out)
    return out


def hit_words() -> F.Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + (s["last"] - s["first"]))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    flagged = flag(docs, benchmark, keep=[id_col])
    return flagged.select(
        id_col,
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, in their own columns, without those that hold a benchmark window."""
    inner = docs.toDF(*[f"c{i}_" for i in range(len(docs.columns))])
    text = inner.columns[docs.columns.index("text")]
    kept = flag(inner, benchmark, text_col=text).filter(F.size("hit_spans") == 0)
    return kept.select(*inner.columns).toDF(*docs.columns)


def cut_spans(text: str | None, spans: list[dict]) -> str | None:
    """The text without its hit word ranges, white space and punctuation inside them included."""
    if not text or not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, end = [], 0
    for s in spans:
        out.append(text[end : at[s["first"]][0]])
        end = at[s["last"] - 1][1]
    return "".join([*out, text[end:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, in their own columns, with the hit word ranges cut out of the texts."""
    inner = docs.toDF(*[f"c{i}_" for i in range(len(docs.columns))])
    text = inner.columns[docs.columns.index("text")]
    flagged = flag(inner, benchmark, text_col=text)

    def kernel(x: dict[str, pa.Array]) -> dict[str, object]:
        return {text: [cut_spans(t, s) for t, s in zip(x[text].to_pylist(), x["hit_spans"].to_pylist(), strict=True)]}

    cut = add_columns(flagged, [text, "hit_spans"], [T.StructField(text, T.StringType())], kernel, keep=inner.columns)
    return cut.select(*inner.columns).toDF(*docs.columns)
