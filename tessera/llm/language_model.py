"""LM scoring by a hashed maximum-entropy model with a tree-factored softmax.

Every token belongs to one of 256 slots, 16 classes of 16: the most frequent
training tokens have slots of their own, others share slots by their last two
bytes. A shared slot has 256 leaves, 16 branches of 16: its most frequent tokens
have leaves of their own, so that some 12,000 words are told apart by what comes
before them; the rest share leaves by their last three bytes. Given its history h
a token w has the probability

    P(class | h) * P(slot | class, h) * P(branch | slot, h) * P(leaf | branch, h)
      * (c(w) + 1) / (N(leaf) + V(leaf) + 1)

with the training counts c, N tokens and V distinct ones in the leaf; a slot of its
own, or one without training tokens, has a single leaf. The
softmaxes are linear in hashed features of the history: the slots of the last
two tokens, the last word with its slot, and skips to the second and third last
slot; below a slot the last word and the second last slot. (The last factor leaves room for one unknown token, so everything has a
probability and all sum to at most one.)

Training: token counts come from all training documents. The weights start at zero, where the gradient of a row
is what was counted in it less what the biases expect; as both are whole numbers known after one pass, that step
goes by the logarithm of their ratio. Each further round takes the gradient over all training documents at the
weights of the round before (counted less expected, over expected). The sums are of whole numbers, expected shares of a
token in units of 1 / SHARE, so they are the same in any order: neither partitions nor cores nor the
order of the rows change a score. Weights have a fixed size (4 x 2^16 x 16 numbers), which
with the tokens that have slots and leaves of their own alone reaches the driver.

Texts are split into tokens once: documents are packed into blocks of up to
BLOCK_TOKENS distinct tokens (or BLOCK_BYTES), each a list of its tokens and the
numbers of its documents' tokens in that list. Counts, training and scoring read
the blocks. Scoring needs the counts of a block's tokens. The vocabulary grows with
the corpus, so it is not broadcast: a block's tokens are dealt by their hashes to as many
buckets as there are blocks, a part of a block in a bucket is one row, and a bucket adds up
the counts of its tokens and returns them to the blocks by their places. A frequent token is one entry a block.

Nulls and edges: a null text is an empty one, whose only token is the end;
documents whose id is null are trained on; without training documents all
counts are 0 and the softmaxes stay even. Repeated rows are scored, and trained on,
as often as they occur. A document with more distinct tokens than a block has is a
block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import blank_tokens, checkpointed, quoted

CLASSES = 16
SLOTS = CLASSES * CLASSES
HEAD = 192
#: Leaves of a shared slot, those of them that one token has alone, and how many of the most frequent tokens may have any.
LEAVES = CLASSES * CLASSES
OWN_LEAVES = 192
TOLD = HEAD + (SLOTS - HEAD) * OWN_LEAVES
BITS = 16
FEATURES = 4
#: Levels of the tree: classes, slots, and the branches and leaves of shared slots.
LEVELS = 4
#: Passes after the first; parts of a step that are taken, and the counts by which rarely used rows are damped, in the first and in later ones.
ROUNDS = 1
FIRST_STEP, FIRST_DAMPING = 0.4, 10.0
STEP, DAMPING = 0.25, 20.0
#: Greatest change of a weight in a later round.
MOST = 1.0
#: Tokens that are handled at once, tokens of documents taken from a block at once, and the units that expected shares are rounded to.
BATCH, PIECE = 65_536, 262_144
SHARE = 4096
#: Greatest size of a weight, so that sums of FEATURES of them can be exponentiated.
WEIGHT = 8.0
#: Distinct tokens and bytes of text after which a block ends.
BLOCK_TOKENS, BLOCK_BYTES = 1_000_000, 12_000_000
#: Buckets that tokens are dealt to at least.
BUCKETS = 32
#: Training tasks: so many by core, or one for so many tokens if these are more; each hands on its sums, of a fixed size.
TASKS_PER_CORE, TASK_TOKENS = 2, 20_000_000
#: Rows of the weights that go together to the sum over all tasks.
CHUNK = 256
END = b""  # no word is empty
_LOG10 = np.log(10.0)


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")) % 7 == 2, F.lit(False))


class _Numbers(dict):
    """Numbers of tokens in the order of their first use."""

    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of rows (id, held_out, text): block, id, held_out, n (tokens) by document, vocab, and at (their numbers in vocab, whose tokens are joined by blanks).

    Every document ends with the end token, number 0. Numbers have 16 bits, or 32
    in blocks of more tokens than that.
    """
    kind = rows.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("id", T.ArrayType(kind)), T.StructField("held_out", T.ArrayType(T.BooleanType()))]
        + [T.StructField("n", T.ArrayType(T.LongType())), T.StructField("vocab", T.BinaryType()), T.StructField("at", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        made, size, numbers = 0, 0, _Numbers({END: 0})
        ids, held, counts, at = [], [], [], []

        def out() -> pa.RecordBatch:
            tokens = list(numbers)
            flat = np.concatenate(at).astype(np.uint16 if len(tokens) <= 1 << 16 else np.uint32)
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            arrays = [pa.array([task + made]), whole(pa.concat_arrays(ids)), whole(pa.concat_arrays(held)), whole(pa.array(counts, pa.int64())), pa.array([b" ".join(tokens)], pa.binary()), pa.array([flat.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

        for batch in batches:
            for k, text in enumerate(batch.column(2)):
                t = text.as_py()
                words = blank_tokens(t.encode() if t else None)
                own = np.zeros(len(words) + 1, dtype=np.uint32)
                own[:-1] = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
                ids.append(batch.column(0).slice(k, 1))
                held.append(batch.column(1).slice(k, 1))
                counts.append(len(own))
                at.append(own)
                size += len(t or "")
                if size > BLOCK_BYTES or len(numbers) > BLOCK_TOKENS:
                    yield out()
                    made, size, numbers = made + 1, 0, _Numbers({END: 0})
                    ids, held, counts, at = [], [], [], []
        if ids:
            yield out()

    return rows.select("id", "held_out", "text").mapInArrow(run, schema)


def _numbers(at: pa.Scalar, n: np.ndarray) -> np.ndarray:
    raw = at.as_py()
    return np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * n.sum() else np.uint32).astype(np.int64)


def _joined(tokens: list[bytes], numbers: np.ndarray) -> list[bytes]:
    """Tokens joined by blanks, and their numbers in 32 bits, or 64 where these don't do."""
    small = not len(numbers) or numbers.max() < 1 << 32
    return [b" ".join(tokens), numbers.astype(np.uint32 if small else np.int64).tobytes()]


def _split(tokens: bytes, numbers: bytes) -> tuple[list[bytes], np.ndarray]:
    words = tokens.split(b" ")
    return words, np.frombuffer(numbers, dtype=np.uint32 if len(numbers) == 4 * len(words) else np.int64).astype(np.int64)


def token_counts(blocks: DataFrame) -> DataFrame:
    """block, tokens, at, n: a row of the tokens (joined by blanks) that a bucket has and their n over all documents that aren't held
    out, where block is null and n > 0; and rows of the numbers `at` of a block's tokens in it and their n, where tokens is null."""
    buckets = max(BUCKETS, blocks.count())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held, n, vocab, at in zip(*batch.columns, strict=True):
                n, tokens = np.array(n.as_py()), vocab.as_py().split(b" ")
                on = np.repeat(~np.array(held.as_py()), n)
                count = np.bincount(_numbers(at, n)[on], minlength=len(tokens))
                bucket = (hashes_of(tokens) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                ends = np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()
                rows = []
                for k, (i, j) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                    if i < j:
                        here = order[i:j]
                        rows.append((k, here.astype(np.uint32).tobytes(), *_joined([tokens[x] for x in here.tolist()], count[here])))
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
                arrays = [pa.array([block.as_py()] * len(rows), pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "bucket", "at", "tokens", "n"])

    def add(bucket: pa.Table) -> pa.Table:
        numbers, parts, counts = _Numbers(), [], []
        for tokens, n in zip(bucket["tokens"], bucket["n"], strict=True):
            words, n = _split(tokens.as_py(), n.as_py())
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            counts.append(n)
        total = np.zeros(len(numbers), dtype=np.int64)
        for part, n in zip(parts, counts, strict=True):
            total[part] += n  # a block has a token once
        words = [w for w, n in zip(numbers, total.tolist(), strict=True) if n]
        tokens, n = _joined(words, total[total > 0]) if words else (None, None)
        back = [_joined([], total[part])[1] for part in parts]
        return pa.table(
            {
                "block": pa.array([None, *bucket["block"].to_pylist()], pa.int64()),
                "tokens": pa.array([tokens, *[None] * len(parts)], pa.binary()),
                "at": pa.array([None, *bucket["at"].to_pylist()], pa.binary()),
                "n": pa.array([n, *back], pa.binary()),
            }
        )

    dealt = blocks.select("block", "held_out", "n", "vocab", "at").mapInArrow(deal, "block long, bucket int, at binary, tokens binary, n binary")
    return dealt.groupBy("bucket").applyInArrow(add, "block long, tokens binary, at binary, n binary")


def most_frequent(counts: DataFrame) -> list[bytes]:
    """The TOLD most frequent training tokens, of equally frequent ones the least first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, n in zip(*batch.columns, strict=True):
                words, n = _split(tokens.as_py(), n.as_py())
                least = np.partition(n, -TOLD)[-TOLD] if len(n) > TOLD else 0
                on = np.flatnonzero(n >= least).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in on], pa.binary()), pa.array(n[on])], names=["token", "n"])

    found = counts.filter("tokens IS NOT NULL").select("tokens", "n").mapInArrow(run, "token binary, n long")
    return [bytes(r["token"]) for r in found.orderBy(F.desc("n"), "token").limit(TOLD).collect()]


def slots_of(tokens: list[bytes], head: dict[bytes, int]) -> np.ndarray:
    """The slots of tokens: their own, or one by their last two bytes."""
    return np.fromiter((head[w] if w in head else HEAD + zlib.crc32(w[-2:]) % (SLOTS - HEAD) for w in tokens), np.int64, len(tokens))


class Tree:
    """head: the tokens that have slots of their own; leaf: the leaves in their slots of the tokens that have one alone. top: tokens by falling count."""

    def __init__(self, top: list[bytes]):
        self.head = {w: i for i, w in enumerate(top[:HEAD])}
        self.leaf, used = {}, [0] * SLOTS
        for w, s in zip(top[HEAD:], slots_of(top[HEAD:], {}).tolist(), strict=True):
            if used[s] < OWN_LEAVES:
                self.leaf[w] = used[s]
                used[s] += 1

    def places(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Slots and leaves of tokens; the leaf of a token with a slot of its own is 0."""
        slots, leaf = slots_of(tokens, self.head), self.leaf
        leaves = np.fromiter((leaf[w] if w in leaf else OWN_LEAVES + zlib.crc32(w[-3:]) % (LEAVES - OWN_LEAVES) for w in tokens), np.int64, len(tokens))
        return slots, np.where(slots < HEAD, 0, leaves)


def by_leaf(counts: DataFrame, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(SLOTS, LEAVES) training tokens, and distinct ones, of the leaves."""
    held = counts.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SLOTS * LEAVES), dtype=np.int64)
        for batch in batches:
            for tokens, n in zip(*batch.columns, strict=True):
                words, n = _split(tokens.as_py(), n.as_py())
                slots, leaves = held.value.places(words)
                at = slots * LEAVES + leaves
                np.add.at(total[0], at, n)
                total[1] += np.bincount(at, minlength=SLOTS * LEAVES)
        on = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (on, total[0, on], total[1, on])], names=["at", "n", "v"])

    out = np.zeros((2, SLOTS * LEAVES), dtype=np.int64)
    summed = counts.filter("tokens IS NOT NULL").select("tokens", "n").mapInArrow(run, "at long, n long, v long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    for r in summed.collect():  # a row a leaf
        out[:, r["at"]] = r["n"], r["v"]
    return out[0].reshape(SLOTS, LEAVES), out[1].reshape(SLOTS, LEAVES)


def hashes_of(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))


def _row(salt: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), (salt + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1), dtype=np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return (h * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - BITS)


def history(slots: np.ndarray, hashes: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, ...]:
    """The slots of the last three tokens and the hash of the last, for every token; position: its number in its text."""

    def back(x: np.ndarray, k: int, none: int) -> np.ndarray:
        out = np.full(len(x), none, dtype=x.dtype)
        out[k:] = x[:-k]
        out[position < k] = none
        return out

    return (*(back(slots, k, SLOTS) for k in (1, 2, 3)), back(hashes, 1, 1))


def features(level: int, own: np.ndarray, s1: np.ndarray, s2: np.ndarray, s3: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """(FEATURES, tokens) rows of the class table (level 0) or the slot table (1). own: the tokens' classes."""
    parts = [(s1, s2), (s1, w1), (s2,), (s3,)]
    return np.stack([_row(i, *p) if level == 0 else _row(8 + i, own, *p) for i, p in enumerate(parts)]).astype(np.int64)


def below(level: int, node: np.ndarray, s2: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """(2, tokens) rows of the branch table (level 2) or the leaf table (3), whose nodes have equally many rows each."""
    size = (ROWS // NODES[level]).bit_length() - 1
    rows = np.stack([_row(16 + 2 * level, w1), _row(17 + 2 * level, s2)]).astype(np.int64) >> (BITS - size)
    return (node << size) + rows


class Weights:
    """tables: class, slot, branch and leaf weights, (4, rows, 16); bias: (16,) for classes and (nodes, 16) for the others in their node.

    slot_counts: training tokens of the slots; leaf_counts: (SLOTS, LEAVES), of the leaves.
    """

    def __init__(self, slot_counts: np.ndarray, leaf_counts: np.ndarray | None = None):
        self.tables = np.zeros((LEVELS, 1 << BITS, CLASSES), dtype=np.float32)
        share = slot_counts.reshape(CLASSES, CLASSES).astype(np.float64) + 0.5
        self.class_bias = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
        self.slot_bias = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
        shared = (np.zeros((SLOTS, LEAVES)) if leaf_counts is None else leaf_counts)[HEAD:].reshape(-1, CLASSES) + 0.5 / CLASSES
        branch = shared.sum(axis=1).reshape(-1, CLASSES)
        self.below_bias = [np.log(x / x.sum(axis=1, keepdims=True)).astype(np.float32) for x in (branch, shared)]

    def bias(self, level: int, own: np.ndarray) -> np.ndarray:
        return self.class_bias if level == 0 else (self.slot_bias, *self.below_bias)[level - 1].take(own, axis=0)

    def scores(self, level: int, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Log-odds of 16 classes, or of the 16 children of each token's node."""
        table = self.tables[level]
        z = table.take(rows[0], axis=0)
        for f in rows[1:]:
            z += table.take(f, axis=0)
        z += self.bias(level, own)
        return z

    def log_p(self, level: int, rows: np.ndarray, own: np.ndarray, want: np.ndarray) -> np.ndarray:
        z = self.scores(level, rows, own)
        top = z[np.arange(len(z)), want]
        return top - np.log(_added(np.exp(z, out=z)))


def _added(z: np.ndarray) -> np.ndarray:
    """Sums of the 16 columns, by halves: the same for a row wherever it stands."""
    while z.shape[1] > 1:
        half = z.shape[1] // 2
        z = z[:, :half] + z[:, half:]
    return z[:, 0]


Texts = Iterator[tuple[np.ndarray, ...]]
ROWS = 1 << BITS
#: Nodes of the levels.
NODES = (1, CLASSES, SLOTS - HEAD, (SLOTS - HEAD) * CLASSES)


def _batches(texts: Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """level, rows of the features, nodes and wanted columns of batches of tokens (slots, hashes, position and, for shared slots, leaf of every one)."""
    for s, hashes, position, *leaves in texts:
        before = history(s, hashes, position)
        for level, _, rows, own, want in _steps(s, before, leaves[0] if leaves else None):
            yield level, rows, own, want


def _steps(s: np.ndarray, before: tuple[np.ndarray, ...], leaves: np.ndarray | None, shared: np.ndarray | None = None):
    """level, places, rows of the features, nodes and wanted columns of batches of tokens, of the lower levels only for tokens in shared slots (a mask by slot)."""
    own = s // CLASSES
    for a in range(0, len(s), BATCH):
        cut = slice(a, a + BATCH)
        for level, want in ((0, own[cut]), (1, s[cut] % CLASSES)):
            yield level, cut, features(level, own[cut], *(x[cut] for x in before)), own[cut], want
    if leaves is None:
        return
    on = np.flatnonzero(s >= HEAD if shared is None else shared[s])
    for a in range(0, len(on), BATCH):
        at = on[a : a + BATCH]
        slot, leaf, s2, w1 = s[at] - HEAD, leaves[at], before[1][at], before[3][at]
        branch = slot * CLASSES + leaf // CLASSES
        yield 2, at, below(2, slot, s2, w1), slot, leaf // CLASSES
        yield 3, at, below(3, branch, s2, w1), branch, leaf % CLASSES


def counted(texts: Texts) -> np.ndarray:
    """(5, ROWS, 16) counts: of the classes by row of the class table, of the slots, of the classes by row of the slot table, of the branches and of the leaves."""
    total = np.zeros((5, ROWS * CLASSES), dtype=np.int64)
    for level, rows, own, want in _batches(texts):
        total[level + (level > 1)] += np.bincount((rows * CLASSES + want).ravel(), minlength=ROWS * CLASSES)
        if level == 1:
            total[2] += np.bincount((rows * CLASSES + own).ravel(), minlength=ROWS * CLASSES)
    return total.reshape(5, ROWS, CLASSES)


def expected(weights: Weights, texts: Texts) -> np.ndarray:
    """(4, ROWS, 16): sums of the tokens' probabilities by row, in whole units of 1 / SHARE."""
    total = np.zeros((LEVELS, CLASSES, ROWS))
    for level, rows, own, _ in _batches(texts):
        p = weights.scores(level, rows, own)
        np.exp(p, out=p)
        p *= (SHARE / _added(p))[:, None]
        np.rint(p, out=p)
        for into, of in zip(total[level], np.ascontiguousarray(p.T, dtype=np.float64), strict=True):
            for row in rows:
                into += np.bincount(row, weights=of, minlength=ROWS)
    return total.transpose(0, 2, 1).astype(np.int64)


def _summed(texts: DataFrame, of, tables: int) -> np.ndarray:
    """(tables, ROWS, 16): of(the training documents' tokens) of every task, added up as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = of(batches).reshape(-1, CHUNK * CLASSES)
        on = np.flatnonzero(made.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array([made[c].tobytes() for c in on], pa.binary())], names=["chunk", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK * CLASSES, dtype=np.int64)
        for x in table["sums"]:
            total += np.frombuffer(x.as_py(), dtype=np.int64)
        return pa.table({"chunk": table["chunk"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((tables * ROWS // CHUNK, CHUNK * CLASSES), dtype=np.int64)
    for r in texts.mapInArrow(run, "chunk int, sums binary").groupBy("chunk").applyInArrow(added, "chunk int, sums binary").collect():  # of a fixed size
        out[r["chunk"]] = np.frombuffer(r["sums"], dtype=np.int64)
    return out.reshape(tables, ROWS, CLASSES)


def _walk(batches: Iterator[pa.RecordBatch], tree: Tree) -> Texts:
    """The training documents of blocks, in pieces of whole documents of about PIECE tokens."""
    for batch in batches:
        for held, n, vocab, raw in zip(*batch.columns, strict=True):
            n, tokens = np.array(n.as_py()), vocab.as_py().split(b" ")
            slots, leaves = (x.astype(np.uint8) for x in tree.places(tokens))
            hashes = hashes_of(tokens).astype(np.uint32)
            del tokens
            mine, ends, raw = ~np.array(held.as_py()), np.cumsum(n), raw.as_buffer()
            every = np.frombuffer(raw, dtype=np.uint16 if raw.size == 2 * ends[-1] else np.uint32)
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(PIECE, ends[-1], PIECE)) + 1, len(n)))
            for i, j in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist(), strict=True):
                at = every[ends[i] - n[i] : ends[j - 1]][np.repeat(mine[i:j], n[i:j])]
                size = n[i:j][mine[i:j]]
                if len(size):
                    yield slots[at].astype(np.int64), hashes[at].astype(np.uint64), np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size), leaves[at].astype(np.int64)


def train(blocks: DataFrame, weights: Weights, tree: Tree, tokens: int, rounds: int = ROUNDS) -> Weights:
    """Weights after the first step and the rounds over all training documents."""
    sc = blocks.sparkSession.sparkContext
    texts = blocks.select("held_out", "n", "vocab", "at").coalesce(max(TASKS_PER_CORE * sc.defaultParallelism, tokens // TASK_TOKENS))
    held = sc.broadcast(tree)
    count = _summed(texts, lambda batches: counted(_walk(batches, held.value)), 5).astype(np.float64)
    seen = count[[0, 1, 3, 4]]
    # By the biases alone; a row of the slot table may be shared by several classes, one of a lower table is a node's.
    even = np.empty_like(seen)
    even[0] = seen[0].sum(axis=1, keepdims=True) * np.exp(weights.class_bias.astype(np.float64))
    even[1] = count[2] @ np.exp(weights.slot_bias.astype(np.float64))
    for level in (2, 3):
        even[level] = seen[level].sum(axis=1, keepdims=True) * np.repeat(np.exp(weights.bias(level, np.arange(NODES[level])).astype(np.float64)), ROWS // NODES[level], axis=0)
    del count
    share = even / np.maximum(even.sum(axis=2, keepdims=True), 1e-9)
    tiny = 1e-12  # rows that no token uses stay at zero
    step = FIRST_STEP * np.log((seen + FIRST_DAMPING * share + tiny) / (even + FIRST_DAMPING * share + tiny))
    weights.tables = np.clip(step, -WEIGHT, WEIGHT).astype(np.float32)
    for _ in range(rounds):
        now = sc.broadcast((weights, tree))
        sums = _summed(texts, lambda batches, now=now: expected(now.value[0], _walk(batches, now.value[1])), LEVELS) / SHARE
        step = np.clip(STEP * (seen - sums) / (sums + DAMPING * share + tiny), -MOST, MOST)
        weights.tables = np.clip(weights.tables + step, -WEIGHT, WEIGHT).astype(np.float32)
    return weights


def marked(blocks: DataFrame, tree: Tree) -> DataFrame:
    """blocks with the slots and leaves (8 bits) and hashes (32 bits) of their tokens in place of these."""
    kinds = {f.name: f.dataType for f in blocks.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ("block", "id", "held_out", "n", "at")] + [T.StructField(c, T.BinaryType()) for c in ("slots", "leaves", "hashes")])
    held = blocks.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, vocab = batch.columns
            told = [v.as_py().split(b" ") for v in vocab]
            places = [[x.astype(np.uint8).tobytes() for x in held.value.places(v)] for v in told]
            hashes = pa.array([hashes_of(v).astype(np.uint32).tobytes() for v in told], pa.binary())
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array([x[k] for x in places], pa.binary()) for k in (0, 1)), hashes], names=[f.name for f in schema])

    return blocks.select("block", "id", "held_out", "n", "at", "vocab").mapInArrow(run, schema)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), is_held_out(id_col).alias("held_out"), F.col(quoted(text_col)).alias("text"))
    blocks = checkpointed(packed(rows))
    counts = checkpointed(token_counts(blocks))
    tree = Tree(most_frequent(counts))
    tokens, distinct = by_leaf(counts, tree)
    total, vocabulary = int(tokens.sum()), int(distinct.sum())
    weights = train(blocks, Weights(tokens.sum(axis=1), tokens), tree, total, rounds)

    known = counts.filter("tokens IS NULL AND block IS NOT NULL").select("block", "at", "n")
    shared = (np.arange(SLOTS) >= HEAD) & (tokens.sum(axis=1) > 0)
    held = docs.sparkSession.sparkContext.broadcast((weights, tokens + distinct + 1, shared))
    schema = T.StructType(
        [T.StructField(id_col, rows.schema["id"].dataType), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
    )
    floor = np.log10(float(total + vocabulary + 1))

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        model, room, shared = held.value
        row = {c: left[c].combine_chunks() for c in left.column_names}
        slots, leaves, hashes = (np.frombuffer(row[c][0].as_py(), dtype=k) for c, k in (("slots", np.uint8), ("leaves", np.uint8), ("hashes", np.uint32)))
        slots, leaves, hashes = slots.astype(np.int64), leaves.astype(np.int64), hashes.astype(np.uint64)
        count = np.zeros(len(slots), dtype=np.int64)
        for at, n in zip(right["at"], right["n"], strict=True):
            at, n = np.frombuffer(at.as_py(), dtype=np.uint32), n.as_py()
            count[at] = np.frombuffer(n, dtype=np.uint32 if len(n) == 4 * len(at) else np.int64)
        share = np.log10(count + 1.0)
        inside = share - np.log10(room[slots, leaves])
        n = np.array(row["n"][0].as_py())
        every = _numbers(row["at"][0], n)
        ends = np.cumsum(n)
        known, base, score = (np.empty(len(n), dtype=k) for k in (np.int64, float, float))
        # Pieces of whole documents, of about BATCH tokens.
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(BATCH, ends[-1], BATCH)) + 1, len(n)))
        for i, j in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist(), strict=True):
            at = every[ends[i] - n[i] : ends[j - 1]]
            first = np.cumsum(n[i:j]) - n[i:j]
            s = slots[at]
            before = history(s, hashes[at], np.arange(len(at)) - np.repeat(first, n[i:j]))
            log_p = inside[at]
            for level, here, rows, own, want in _steps(s, before, leaves[at], shared):  # a long document is more than one batch here
                log_p[here] += model.log_p(level, rows, own, want) / _LOG10
            known[i:j] = np.add.reduceat((count[at] > 0).astype(np.int64), first)
            base[i:j] = np.add.reduceat(share[at], first) - n[i:j] * floor
            score[i:j] = np.add.reduceat(log_p, first)
        return pa.Table.from_arrays(
            [row["id"].values, row["held_out"].values, pa.array(n), pa.array(known), pa.array(np.full(len(n), total)), pa.array(base), pa.array(score)],
            names=[f.name for f in schema],
        )

    return marked(blocks, tree).groupBy("block").cogroup(known.groupBy("block")).applyInArrow(rate, schema)
