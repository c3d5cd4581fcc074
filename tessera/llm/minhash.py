"""Near-duplicate groups by ProbMinHash, banding and exact verification.

A text's elements are its shingles of five words (a shorter text with words is
one shingle), weighted 1 + ln(count). Every element is a Poisson process of
arrivals at the rate of its weight; each arrival falls on a random register, and
a register keeps the element that came first. An element stops once its next
arrival is later than the latest register. Two texts agree on a register with
the probability Jaccard similarity of their weighted shingles.

1. Texts with the same word sequence are one class; its least id stands for it.
2. Bands of registers put representatives into buckets. A text with repeated
   shingles has a second signature, of its shingles without weights, whose bands
   are dealt like those of the first (a text without repeats has one signature for
   both), so pairs alike by either measure meet. Buckets with the same members are
   one.
3. In every bucket members of other groups are verified against a hub, the member
   whose buckets are largest, STAR_ROUNDS times; links join groups in between.
   Hubs only meet members that agree with them on LIKELY of some signature's
   registers, as the others seldom link.
4. In buckets that still hold several groups, all members of all groups but the
   largest are compared with each other and with the largest, whatever their
   signatures say, in tasks of two tiles of about TILE shingles each. So every two
   members of a bucket either are linked through others or have been compared; only
   the groups that a link joins leave a task. A group of thousands of near copies
   beside some strangers costs as many rows as it has members.
5. Linked are texts whose similarity is 0.8 or more: the probability Jaccard of
   the weighted shingles, or the plain Jaccard of their sets. Texts are read twice,
   for signatures and for the shingles of bucket members; after that only 48-bit
   hashes of shingles and their counts move.

Nulls and edges: texts without words (null, empty, punctuation only) are classes
of their own; a null id gets a null class; rows that repeat an id with another
text are classed by their own texts, so an id may have several classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import add_columns, as_bytes, checkpointed, quoted, words
from tessera.operators.graphs import components
from tessera.operators.ordering import Rounds

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Agreement from which star rounds compare a pair; the tiles decide the others.
LIKELY = 0.67
STAR_ROUNDS = 2
#: Distinct shingles of a tile, about; a longer text is a tile of its own.
TILE = 500_000
_CACHED_WORDS = 100_000
_word_hashes: dict[bytes, int] = {}
_MASK48 = np.uint64((1 << 48) - 1)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(each: list[list[bytes]]) -> np.ndarray:
    global _word_hashes
    missing = set(chain.from_iterable(each)).difference(_word_hashes)
    if len(_word_hashes) + len(missing) > _CACHED_WORDS:
        _word_hashes = {}
        missing = set(chain.from_iterable(each))
    _word_hashes.update((w, xxhash.xxh3_64_intdigest(w)) for w in missing)
    return np.fromiter(map(_word_hashes.__getitem__, chain.from_iterable(each)), np.uint64, sum(map(len, each)))


def shingles(each: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts given as words: text number, 48-bit hash, count; sorted by text."""
    h = word_hashes(each)
    n = np.array([len(w) for w in each], dtype=np.int64)
    starts = np.cumsum(n) - n
    made = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    of = np.repeat(np.arange(len(each)), made)
    first = np.repeat(starts, made) + np.arange(len(of)) - np.repeat(np.cumsum(made) - made, made)
    size = np.minimum(n, SHINGLE)[of]
    s = np.zeros(len(of), dtype=np.uint64)
    for k in range(SHINGLE):
        on = size > k
        s[on] += _mixed(h[first[on] + k]) * _POWERS[k]
    keys, counts = np.unique((of.astype(np.uint64) << np.uint64(48)) | (_mixed(s) & _MASK48), return_counts=True)
    return (keys >> np.uint64(48)).astype(np.int64), keys & _MASK48, counts


def weights(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


def sketch(texts: int, of: np.ndarray, elements: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """(texts, registers) of 16-bit element marks: the element that arrived first."""
    best = np.full(texts * registers, np.inf)
    mark = np.zeros(texts * registers, dtype=np.uint16)
    time = np.zeros(len(of))
    state = _mixed(elements)
    tag = (_mixed(elements ^ np.uint64(0xA5A5A5A5)) >> np.uint64(48)).astype(np.uint16)
    while len(of):
        state = _mixed(state + np.uint64(0x9E3779B97F4A7C15))
        u = ((state >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53
        time = time - np.log(u) / weight
        at = of * registers + (_mixed(state ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, at, time)
        won = best[at] == time
        mark[at[won]] = tag[won]
        on = time < best.reshape(texts, registers).max(axis=1)[of]
        of, time, state, tag, weight = of[on], time[on], state[on], tag[on], weight[on]
    return mark.reshape(texts, registers)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (digest of the word sequence; null without words), sig (16-bit marks as binary), flat (those without weights; null without repeats), size (distinct shingles)."""
    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))

    def kernel(x: dict[str, pa.Array]) -> dict[str, object]:
        each = [words(t) for t in as_bytes(x["text"])]
        sigs: list[bytes | None] = []
        flat: list[bytes | None] = [None] * len(each)
        size: list[int] = []
        for k in range(0, len(each), 4096):  # text numbers must fit 16 bits
            part = each[k : k + 4096]
            of, e, n = shingles(part)
            size += np.bincount(of, minlength=len(part)).tolist()
            sigs += [s.tobytes() if w else None for s, w in zip(sketch(len(part), of, e, weights(n)), part, strict=True)]
            repeats = np.unique(of[n > 1])
            on = np.isin(of, repeats)
            plain = sketch(len(repeats), np.searchsorted(repeats, of[on]), e[on], np.ones(int(on.sum())))
            for i, s in zip(repeats.tolist(), plain, strict=True):
                flat[k + i] = s.tobytes()
        return {"key": list(map(text_key, each)), "sig": sigs, "flat": flat, "size": size}

    fields = [T.StructField(c, T.BinaryType()) for c in ("key", "sig", "flat")] + [T.StructField("size", T.IntegerType())]
    return add_columns(source, ["text"], fields, kernel, ["id"])


def text_key(each: list[bytes]) -> bytes | None:
    """A digest of a word sequence; none of an empty one."""
    return md5(b" ".join(each)).digest() if each else None


def element_table(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, e (sorted 48-bit shingles), n (their counts as 32-bit numbers; null if all are 1) of the chosen (id, key), each key once."""
    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    source = source.join(chosen.hint("merge"), "id")  # one plan at every size

    def kernel(x: dict[str, pa.Array]) -> dict[str, object]:
        each = [words(t) for t in as_bytes(x["text"])]
        elements, counts = [], []
        for w in each:
            _, e, n = shingles([w])
            elements.append(np.ascontiguousarray(e.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
            counts.append(n.astype("<u4").tobytes() if (n > 1).any() else None)
        return {"own": list(map(text_key, each)), "e": elements, "n": counts}

    made = add_columns(source, ["text"], [T.StructField(c, T.BinaryType()) for c in ("own", "e", "n")], kernel, ["key"])
    made = checkpointed(made.filter("own = key").drop("own"))
    if made.count() > chosen.count():  # some rows repeat an id and its text
        made = checkpointed(made.groupBy("key").agg(F.first("e").alias("e"), F.first("n").alias("n")))
    return made


def elements_of(e: bytes, n: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and weights of a row of the element table."""
    wide = np.zeros((len(e) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(e, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel(), weights(np.frombuffer(n, dtype="<u4")) if n is not None else np.ones(len(wide))


def similarity(a: bytes | None, b: bytes | None) -> float:
    """The greater of the probability Jaccard of weighted shingles and the Jaccard of their sets."""
    of, e, n = shingles([words(a), words(b)])
    return _similar((e[of == 0], weights(n[of == 0])), (e[of == 1], weights(n[of == 1])))


def _similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    plain = len(common) / (len(a[0]) + len(b[0]) - len(common))
    if not len(common) or (np.all(a[1] == 1) and np.all(b[1] == 1)):
        return plain
    # For element d the sum over x of max(a(x)/a(d), b(x)/b(d)): with q = b(d)/a(d),
    # elements with b(x)/a(x) > q take their b share, the others their a share.
    wa, wb = np.concatenate([a[1], np.zeros(len(b[0]) - len(common))]), np.zeros(len(a[0]) + len(b[0]) - len(common))
    wb[i] = b[1][j]
    only = np.ones(len(b[0]), dtype=bool)
    only[j] = False
    wb[len(a[0]) :] = b[1][only]
    with np.errstate(divide="ignore"):
        ratio = wb / wa
    order = np.argsort(ratio)
    below_a, below_b = np.cumsum(wa[order]), np.cumsum(wb[order])
    q = wb[i] / wa[i]
    at = np.searchsorted(ratio[order], q, side="right") - 1
    total = below_a[at] / wa[i] + (below_b[-1] - below_b[at]) / wb[i]
    return max(plain, float((1.0 / total).sum()))


def verified(pairs: DataFrame, elements: DataFrame, least: float) -> DataFrame:
    """a, b: the labels of the pairs (key, hub, label, hub_label) whose texts are similar enough."""
    mine = elements.select("key", F.col("e").alias("e1"), F.col("n").alias("n1"))
    hubs = elements.select(F.col("key").alias("hub"), F.col("e").alias("e2"), F.col("n").alias("n2"))
    both = pairs.join(mine, "key").join(hubs, "hub").select("hub", "label", "hub_label", "e1", "n1", "e2", "n2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hub, label, hub_label, *packed = batch.columns
            keep, at, known = [], None, None
            for i, h in enumerate(hub.to_pylist()):
                if h != at:  # pairs of one hub mostly come in a row
                    at, known = h, elements_of(packed[2][i].as_py(), packed[3][i].as_py())
                keep.append(_similar(elements_of(packed[0][i].as_py(), packed[1][i].as_py()), known) >= least - 1e-12)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([label.filter(mask), hub_label.filter(mask)], names=["a", "b"])

    return both.mapInArrow(run, "a binary, b binary").distinct()


def _elements(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    _, e, n = shingles([words(text)])
    return e, weights(n)


def buckets(classes: DataFrame) -> DataFrame:
    """bucket, key, size, degree (members of its buckets) of all buckets with two members or more; of buckets with the same members one."""
    hashed = lambda c: F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(c, b * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    )
    both = F.when(F.col("flat").isNull(), hashed("sig")).otherwise(F.array_union(hashed("sig"), hashed("flat")))
    bands = checkpointed(classes.select("key", "size", F.explode(both).alias("bucket")))
    sets = (
        bands.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
        .filter("n > 1")
        .groupBy("n", "x", "y")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", "n")
    )
    kept = checkpointed(bands.join(sets, "bucket"))
    degree = kept.groupBy("key").agg(F.sum("n").alias("degree"))
    return checkpointed(kept.select("bucket", "key", "size").join(degree, "key"))


def likely(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """The pairs (key, hub, label, hub_label) that agree on LIKELY of the registers of some signature."""
    mine = sigs.select("key", F.col("sig").alias("s1"), F.col("flat").alias("f1"))
    hubs = sigs.select(F.col("key").alias("hub"), F.col("sig").alias("s2"), F.col("flat").alias("f2"))
    both = pairs.join(mine, "key").join(hubs, "hub").select(*pairs.columns, "s1", "s2", F.coalesce("f1", "s1").alias("f1"), F.coalesce("f2", "s2").alias("f2"))
    columns, bound = pairs.columns, least - SIMILARITY + LIKELY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2, f1, f2 = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in batch.columns[len(columns) :])
            mask = pa.array(np.maximum((s1 == s2).mean(axis=1), (f1 == f2).mean(axis=1)) >= bound)
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns[: len(columns)]], names=columns)

    return both.mapInArrow(run, pairs.schema)


def hubs_of(state: DataFrame, first: bool) -> DataFrame:
    """bucket, hub, hub_label of buckets with several groups: at first the member of highest degree, later the one outside the least group."""
    if first:  # every member is a group of its own
        return state.groupBy("bucket").agg(F.max(F.struct("degree", "key", "label")).alias("h")).select("bucket", F.col("h.key").alias("hub"), F.col("h.label").alias("hub_label"))
    groups = checkpointed(state.groupBy("bucket", "label").agg(F.max(F.struct("degree", "key")).alias("h")))
    split = groups.groupBy("bucket").agg(F.min("label").alias("low"), F.count("*").alias("n")).filter("n > 1").select("bucket", "low")
    # The least group was the hub's before, or holds one member of many.
    best = groups.join(split, "bucket").filter("label <> low").groupBy("bucket").agg(F.max(F.struct("h", "label")).alias("g"))
    return best.select("bucket", F.col("g.h.key").alias("hub"), F.col("g.label").alias("hub_label"))


def links(members: DataFrame, sigs: DataFrame, elements: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """key, label: the group of every member of a bucket, the least key of those it is similar to through others."""
    rounds = Rounds(members.sparkSession)
    state = members.withColumn("label", F.col("key"))

    def joined(edges: DataFrame) -> DataFrame:
        roots = components(edges).toDF("label", "new")
        return rounds.next(state.join(roots, "label", "left").select("bucket", "key", "size", "degree", F.coalesce("new", "label").alias("label")))

    for k in range(STAR_ROUNDS):
        hubs = checkpointed(hubs_of(state, k == 0))
        pairs = state.join(hubs, "bucket").filter("label <> hub_label").select("key", "hub", "label", "hub_label").distinct()
        edges = checkpointed(verified(likely(pairs, sigs, least), elements, least))
        if edges.isEmpty():
            break
        state = joined(edges)
    edges = checkpointed(bucket_links(state, elements, least))
    if not edges.isEmpty():
        state = joined(edges)
    return state.select("key", "label").distinct()


def bucket_links(state: DataFrame, elements: DataFrame, least: float) -> DataFrame:
    """a < b: labels that some link joins, of all members of buckets that hold several labels."""
    groups = state.groupBy("bucket", "label").agg(F.sum("size").alias("size"))
    split = groups.groupBy("bucket").agg(F.max(F.struct("size", "label")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("n")).filter("n > 1")
    tiles = lambda size: F.greatest(F.ceil(size / TILE), F.lit(1)).cast("int")
    split = checkpointed(split.select("bucket", F.col("main.label").alias("main"), tiles(F.col("main.size")).alias("of_main"), tiles(F.col("size") - F.col("main.size")).alias("of_rest")))
    at_main = F.col("label") == F.col("main")
    rows = state.join(split, "bucket").withColumn("own", F.pmod(F.xxhash64("key"), F.when(at_main, F.col("of_main")).otherwise(F.col("of_rest"))).cast("int"))
    # A tile is first (side 1), second (2) or both (3) of its pair. Tiles of the largest
    # group (numbers from of_rest) are second only, and don't meet each other.
    place = lambda a, b, side: F.struct(a.alias("ta"), b.alias("tb"), side.alias("side"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own, rest = F.col("own"), F.col("of_rest")
    places = F.when(at_main, F.transform(every("of_rest"), lambda t: place(t, rest + own, F.lit(2)))).otherwise(
        F.concat(
            F.transform(every("of_rest"), lambda t: place(F.least(own, t), F.greatest(own, t), F.when(t == own, 3).when(t > own, 1).otherwise(2))),
            F.transform(every("of_main"), lambda t: place(own, rest + t, F.lit(1))),
        )
    )
    placed = rows.select("bucket", "key", "label", F.explode(places).alias("p")).select("bucket", "key", "label", "p.*").join(elements, "key")

    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"].combine_chunks())
        names = table["label"].to_pylist()
        by_number = sorted(set(names))
        numbers = {x: k for k, x in enumerate(by_number)}
        label = np.array([numbers[x] for x in names])
        known = [elements_of(e, n) for e, n in zip(table["e"].to_pylist(), table["n"].to_pylist(), strict=True)]
        pairs = [sorted((by_number[a], by_number[b])) for a, b in tile_links(known, label, side, least)]
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([y for _, y in pairs], pa.binary())})

    return placed.groupBy("bucket", "ta", "tb").applyInArrow(run, "a binary, b binary").distinct()


def tile_links(known: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of labels that some similar pair of texts joins, of all pairs with side 1 and side 2 (3 is both) and differing labels.

    Texts meet over an index of their elements. Shared elements give the plain
    Jaccard; the probability Jaccard is computed where a bound from above allows it.
    """
    rows, size = len(known), np.array([len(e) for e, _ in known])
    plain = np.array([bool((w == 1).all()) for _, w in known])
    mass = np.array([w.sum() for _, w in known])
    ends = np.cumsum(size)
    _, element, count = np.unique(np.concatenate([e for e, _ in known]), return_inverse=True, return_counts=True)
    order = np.argsort(element, kind="stable")
    row = np.repeat(np.arange(rows, dtype=np.int32), size)[order]
    weight = np.concatenate([w for _, w in known])[order]
    starts = np.cumsum(count) - count
    group = np.arange(int(label.max()) + 1)  # labels joined so far
    found: list[tuple[int, int]] = []
    # Of two differing labels one is not the most common: its texts look up the others.
    for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        open_ = ((side | side[i]) == 3) & (group[label] != group[label[i]])
        if not open_.any():
            continue
        own = element[ends[i] - size[i] : ends[i]]
        # What is common to similar texts has at least that share of this one's shingles, and
        # of their weight: one of its rarest, whose share is just more than the rest, is common.
        rare = np.argsort(count[own], kind="stable")
        w = known[i][1][rare]
        most = max(int((1 - least + 1e-9) * size[i]), int(np.searchsorted(np.cumsum(w), (1 - least + 1e-9) * mass[i], side="right"))) + 1
        first = own[rare[:most]]
        n = count[first]
        near = np.zeros(rows, dtype=bool)
        near[row[np.repeat(starts[first] - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        open_ &= near
        if not open_.any():
            continue
        n = count[own]
        at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        mine = np.repeat(known[i][1], n)
        on = open_[row[at]]
        at, mine = at[on], mine[on]
        who, theirs = row[at], weight[at]
        shared = np.bincount(who, minlength=rows)
        alike = shared / (size[i] + size - shared) >= least - 1e-12
        maybe = (shared > 0) & ~alike & ~(plain & plain[i])
        if maybe.any():
            on = maybe[who]
            who, mine, theirs = who[on], mine[on], theirs[on]
            only_mine, only_theirs = mass[i] - np.bincount(who, mine, rows), mass - np.bincount(who, theirs, rows)
            # The sum over x of max(a(x)/a(d), b(x)/b(d)) is at least that with a's, or b's, shares for all common x.
            total = np.maximum(mass[i] / mine + only_theirs[who] / theirs, mass[who] / theirs + only_mine[who] / mine)
            maybe &= np.bincount(who, 1 / total, rows) >= least - 1e-9
        for k in np.flatnonzero(alike | maybe).tolist():
            a, b = group[label[i]], group[label[k]]
            if a != b and (alike[k] or _similar(known[i], known[k]) >= least - 1e-12):
                group[group == max(a, b)] = min(a, b)
                found.append((int(label[i]), int(label[k])))
    return found


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """id, key of every row, and key, class_id of every key."""
    signed = checkpointed(signatures(docs, id_col, text_col))
    classes = signed.filter("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(*[F.min(c).alias(c) for c in ("id", "sig", "flat", "size")])
    classes = checkpointed(classes)
    members = buckets(classes)
    chosen = checkpointed(classes.select("id", "key").join(members.select("key").distinct(), "key", "left_semi"))
    elements = element_table(docs, chosen, id_col, text_col)
    labels = checkpointed(links(members, classes.select("key", "sig", "flat"), elements, least).join(classes.select("key", "id"), "key"))
    least_ids = labels.groupBy("label").agg(F.min("id").alias("class_id"))
    named = labels.join(least_ids, "label").select("key", "class_id")
    named = classes.select("key", "id").join(named, "key", "left").select("key", F.coalesce("class_id", "id").alias("class_id"))
    return signed.select("id", "key"), checkpointed(named)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """id, class_id of every row: the least id of its group of copies and near copies."""
    rows, named = _classes(docs, id_col, text_col, least)
    out = rows.join(named, "key", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """docs, in their own columns, with the one of least id of each group.

    Rows without an id stay. Rows that repeat an id and its words become one (the
    least, column by column); one that repeats an id with other words stays if it is
    the least of its own group.
    """
    rows, named = _classes(docs, id_col, text_col, least)
    classed = checkpointed(rows.filter("id IS NOT NULL").join(named, "key", "left"))
    repeated = checkpointed(classed.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    gone = classed.filter("class_id < id").select("id").unionByName(repeated)
    inner = docs.toDF(*[f"c{i}_" for i in range(len(docs.columns))])
    own, text = (inner.columns[docs.columns.index(c)] for c in (id_col, text_col))
    out = inner.join(gone.withColumnRenamed("id", own), own, "left_anti")
    if not repeated.isEmpty():
        again = inner.join(repeated.withColumnRenamed("id", own), own, "left_semi")
        again = add_columns(again, [text], [T.StructField("key", T.BinaryType())], lambda x: {"key": [text_key(words(t)) for t in as_bytes(x[text])]})
        again = again.join(named, "key", "left").filter(F.col("class_id").isNull() | (F.col("class_id") == F.col(own)))
        first = again.groupBy(own, "key").agg(F.min(F.struct(*inner.columns)).alias("row"))
        out = out.unionByName(first.select("row.*"))
    return out.select(*inner.columns).toDF(*docs.columns)
