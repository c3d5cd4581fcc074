"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Pre-tokenisation works on arrays of codepoints. Each codepoint becomes a symbol
(its class, told apart further by the codepoints that follow it), each symbol is
a transition function on eight states, and the state before every codepoint
comes from an associative scan: the functions that products of symbols can give
form a small monoid, so composing two of them is one look-up in a table. A text
is cut where the state and the symbol say so; no regex is used.

The slices go through a cache from slice to ids; a miss merges its byte pairs by
rank. Token offsets (bytes) are kept beside the ids, so a range of tokens can be
decoded and placed in its text.

Nulls and edges: a null text encodes like an empty one, to no ids; decoding no
ids gives an empty text. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import add_columns

#: Slices in a worker's cache; it starts afresh once it holds more.
CACHE_SLICES = 400_000
_NEVER = 1 << 30

# Codepoint classes.
_OTHER, _LETTER, _NUMBER, _WHITE, _SPACE, _QUOTE = range(6)
# The white space of the split pattern's \s beyond ASCII and Unicode's separator categories.
_MORE_WHITE = (*range(0x09, 0x0E), 0x20, 0x85)
# Endings that the split pattern cuts off after an apostrophe.
_SHORT, _LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")

# Symbols.
_S_OTHER, _S_LETTER, _S_NUMBER, _S_RUN, _S_LAST, _S_LEAD, _S_END, _S_CUT1, _S_CUT2 = range(9)
# States: what the codepoint before belongs to.
_FRESH, _LED, _IN_OTHER, _IN_LETTERS, _IN_NUMBERS, _IN_WHITE, _CUT1, _CUT2 = range(8)


@cache
def class_table() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, _OTHER, dtype=np.uint8)
    first = {"L": _LETTER, "N": _NUMBER, "Z": _WHITE}
    for c in range(sys.maxunicode + 1):
        k = first.get(unicodedata.category(chr(c))[0])
        if k is not None:
            out[c] = k
    out[list(_MORE_WHITE)] = _WHITE
    out[0x20] = _SPACE
    out[0x27] = _QUOTE
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice begins at the symbol."""
    if symbol == _S_LETTER:
        if state in (_CUT1, _CUT2):
            return (_FRESH if state == _CUT1 else _CUT1), False
        return _IN_LETTERS, state not in (_LED, _IN_LETTERS)
    if symbol == _S_NUMBER:
        return _IN_NUMBERS, state not in (_LED, _IN_NUMBERS)
    if symbol == _S_RUN:  # white space before white space or the end
        return _IN_WHITE, state != _IN_WHITE
    if symbol == _S_LAST:  # the last white space of a run, and no space
        return _FRESH, True
    if symbol == _S_LEAD:  # a space that belongs to what follows
        return _LED, True
    if symbol == _S_END:
        return _FRESH, True
    if symbol in (_S_CUT1, _S_CUT2) and state not in (_LED, _IN_OTHER):
        return (_CUT1 if symbol == _S_CUT1 else _CUT2), True
    return _IN_OTHER, state not in (_LED, _IN_OTHER)


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Generators by symbol, the product table, each function's value by state, and cuts by (state, symbol)."""
    gens = [tuple(_step(s, y)[0] for s in range(8)) for y in range(9)]
    known: dict[tuple[int, ...], int] = {tuple(range(8)): 0}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    funcs = np.array(list(known), dtype=np.uint8)
    product = np.array([[known[tuple(g[s] for s in f)] for g in known] for f in known], dtype=np.uint8 if len(known) < 256 else np.uint16)
    cuts = np.array([[_step(s, y)[1] for y in range(9)] for s in range(8)])
    return np.array([known[g] for g in gens], dtype=product.dtype), product, funcs, cuts


def _table(rows: np.ndarray, bits: int) -> bytes:
    """rows as a 256-byte table addressed by row << bits | column, for bytes.translate."""
    out = np.zeros(256, dtype=np.uint8)
    for i, row in enumerate(rows):
        out[(i << bits) : (i << bits) + len(row)] = row
    return out.tobytes()


@cache
def tables() -> tuple[bytes, bytes, bytes, bytes]:
    """Byte tables: symbol to function, function and function to product, function and state to state, symbol and state to cut."""
    gens, product, funcs, cuts = monoid()
    assert len(product) <= 16, "two functions must fit a byte"
    return gens.astype(np.uint8).tobytes().ljust(256, b"\0"), _table(product, 4), _table(funcs, 3), _table(cuts.T, 3)


def _looked_up(table: bytes, high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    return np.frombuffer(((high << bits) | low).tobytes().translate(table), dtype=np.uint8)


def states_before(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """The automaton's state before each symbol, by a blocked associative scan."""
    generator, product, apply, _ = tables()
    n = len(symbols)
    rows = max(1, -(-n // width))
    f = np.zeros(rows * width, dtype=np.uint8)
    f[:n] = np.frombuffer(symbols.tobytes().translate(generator), dtype=np.uint8)
    f = f.reshape(rows, width).T.copy()  # one block a column
    for j in range(1, width):  # prefixes inside blocks, all blocks at once
        f[j] = _looked_up(product, f[j - 1], f[j], 4)
    carry = f[-1].copy()  # prefixes over blocks: doubling
    gap = 1
    while gap < rows:
        carry[gap:] = _looked_up(product, carry[:-gap], carry[gap:], 4)
        gap *= 2
    start = np.zeros(rows, dtype=np.uint8)
    start[1:] = _looked_up(apply, carry[:-1], np.full(rows - 1, _FRESH, dtype=np.uint8), 3)
    state = np.empty((width, rows), dtype=np.uint8)
    state[0] = start
    for j in range(1, width):
        state[j] = _looked_up(apply, f[j - 1], start, 3)
    return state.T.reshape(-1)[:n]


@cache
def _latin_classes() -> bytes:
    return class_table()[:256].tobytes()


def classes(text: str) -> bytes:
    """The class of each codepoint; a table of 256 serves texts within Latin-1."""
    try:
        return text.encode("latin-1").translate(_latin_classes())
    except UnicodeEncodeError:
        return class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].tobytes()


_SYMBOL_OF = bytes([_S_OTHER, _S_LETTER, _S_NUMBER, _S_LAST, _S_LEAD, _S_OTHER, _S_END]).ljust(256, b"\0")
_END = 6  # the class of the mark after each text


def cut_points(texts: list[str]) -> np.ndarray:
    """Starts of slices in the texts laid end to end, each followed by an end mark that is a slice of its own."""
    joined = b"".join(x for t in texts for x in (classes(t), bytes([_END])))
    kind = np.frombuffer(joined, dtype=np.uint8)
    symbols = np.frombuffer(joined.translate(_SYMBOL_OF), dtype=np.uint8).copy()
    white = (kind == _WHITE) | (kind == _SPACE)
    goes_on = np.ones(len(kind), dtype=bool)
    goes_on[:-1] = white[1:] | (kind[1:] == _END)
    symbols[white & goes_on] = _S_RUN
    quotes = np.flatnonzero(kind == _QUOTE)
    if len(quotes):
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        of = np.searchsorted(starts, quotes, side="right") - 1
        for q, d in zip(quotes.tolist(), of.tolist(), strict=True):
            after = texts[d][q - starts[d] + 1 : q - starts[d] + 3]
            if after[:1] in _SHORT:
                symbols[q] = _S_CUT1
            elif after in _LONG:
                symbols[q] = _S_CUT2
    return np.flatnonzero(_looked_up(tables()[3], symbols, states_before(symbols), 3))


def split(texts: list[str]) -> list[list[str]]:
    """The slices of each text, all texts in one array."""
    cuts = cut_points(texts)
    out, base, at = [], 0, 0
    ends = np.searchsorted(cuts, np.cumsum([len(t) + 1 for t in texts]) - 1)
    for t, e in zip(texts, ends.tolist(), strict=True):
        edges = (cuts[at : e + 1] - base).tolist()  # the last is the end mark's
        out.append([t[a:b] for a, b in zip(edges, edges[1:])])
        base += len(t) + 1
        at = e + 1
    return out


class Merger:
    """Ids of slices by a rank file, with a bounded cache."""

    def __init__(self, path: str):
        self.tokens: list[bytes] = []
        with open(path, "rb") as lines:
            for line in lines:
                token, rank = line.split()
                assert int(rank) == len(self.tokens), "ranks must count from 0"
                self.tokens.append(base64.b64decode(token))
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int32)
        self.shared = list(range(len(self.tokens)))
        self.digits = [str(i) for i in range(len(self.tokens))]
        self.cached: dict[str, tuple[int, ...]] = {}
        self.bytes_to_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {
            (left << 32) | right: rank
            for rank, t in enumerate(self.tokens)
            for k in range(1, len(t))
            if (left := self.ranks.get(t[:k])) is not None and (right := self.ranks.get(t[k:])) is not None
        }
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)

    def ids(self, texts: list[list[str]]) -> list[list[int]]:
        """The ids of each text's slices; slices that the cache lacks are merged together."""
        if len(self.cached) > CACHE_SLICES:
            self.cached = {}
        flat = list(chain.from_iterable(texts))
        got = list(map(self.cached.get, flat))
        if None in got:
            missed = [i for i, g in enumerate(got) if g is None]
            fresh = dict(self.merge_all({flat[i] for i in missed}))
            for i in missed:
                got[i] = fresh[flat[i]]
            self.cached.update(fresh)
        rest = iter(got)
        return [list(chain.from_iterable(islice(rest, len(t)))) for t in texts]

    def merge_all(self, pieces: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Each slice with its ids; slices of like length share arrays."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            data = p.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(data)
            if rank is not None:
                yield p, (self.shared[rank],)
            elif len(data) > 64:
                yield p, self._merge_long(data)
            else:
                by_width.setdefault(-(-len(data) // 4) * 4, []).append((p, data))
        for width, group in by_width.items():
            for k in range(0, len(group), 8192):
                some = group[k : k + 8192]
                yield from zip((p for p, _ in some), self._merge_block([d for _, d in some], width), strict=True)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, _NEVER where they don't merge; an id of -1 merges with nothing."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], _NEVER)

    def _merge_block(self, group: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Joins in every slice the pair of least rank, the leftmost first, until none has a rank; a round does one pair in each slice."""
        n = len(group)
        raw = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in group), dtype=np.uint8).reshape(n, width)
        size = np.array([len(d) for d in group])
        there = np.arange(width) < size[:, None]
        ids = np.full((n, width + 1), -1, dtype=np.int64)  # the last column stands for no neighbour
        ids[:, :width][there] = self.bytes_to_ids[raw[there]]
        rank = self._ranks_of(ids[:, :-1], ids[:, 1:])
        after = np.minimum(np.arange(1, width + 1), size[:, None])
        after[after == size[:, None]] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        rows = np.arange(n)
        while len(rows):
            i = rank[rows].argmin(axis=1)
            least = rank[rows, i]
            on = least < _NEVER
            rows, i, least = rows[on], i[on], least[on]
            j = after[rows, i]
            ids[rows, i] = least
            ids[rows, j] = -1
            rank[rows, j] = _NEVER
            k = after[rows, j]
            after[rows, i] = k
            before[rows, k] = i
            rank[rows, i] = self._ranks_of(ids[rows, i], ids[rows, k])
            h = before[rows, i]
            has = h >= 0
            rank[rows[has], h[has]] = self._ranks_of(ids[rows[has], h[has]], ids[rows[has], i[has]])
        left = ids[:, :width] >= 0
        # One int object for each id keeps the cache small and its look-ups near.
        flat = list(map(self.shared.__getitem__, ids[:, :width][left].tolist()))
        ends = np.cumsum(left.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same for one slice by a heap over a linked list: n log n for slices of any length."""
        ranks, n = self.ranks, len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or part[i] is None or len(part[i]) + len(part[j]) != size or ranks.get(part[i] + part[j]) != r:
                continue
            part[i] += part[j]
            part[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (q := ranks.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (q, a, len(part[a]) + len(part[b])))
        return tuple(ranks[p] for p in part if p is not None)


@cache
def merger(path: str) -> Merger:
    return Merger(path)


def encode_texts(path: str, texts: list[str | None]) -> list[list[int]]:
    return merger(path).ids(split([t or "" for t in texts]))


def decode_ids(path: str, each: list[list[int] | None]) -> list[bytes]:
    get = merger(path).tokens.__getitem__
    return [b"".join(map(get, ids or ())) for ids in each]


def _lists(each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.concatenate([[0], np.cumsum([len(i) for i in each])]).astype(np.int32)
    return ends, np.fromiter(chain.from_iterable(each), np.int32, int(ends[-1]))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", offsets_col: str = "offsets", keep: list[str] | None = None) -> DataFrame:
    """docs with the ids of each text and each token's first byte in the text's UTF-8."""

    def kernel(x: dict[str, pa.Array]) -> dict[str, object]:
        ends, flat = _lists(encode_texts(path, x[text_col].to_pylist()))
        size = np.concatenate([[0], np.cumsum(merger(path).lengths[flat], dtype=np.int64)])
        at = (size[:-1] - np.repeat(size[ends[:-1]], np.diff(ends))).astype(np.int32)
        return {ids_col: pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), offsets_col: pa.ListArray.from_arrays(pa.array(ends), pa.array(at))}

    return add_columns(docs, [text_col], [T.StructField(c, T.ArrayType(T.IntegerType())) for c in (ids_col, offsets_col)], kernel, keep)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """encoded with the bytes that each row's ids stand for; null ids give no bytes."""
    source = encoded.withColumn("_sized_", F.lit(""))
    kernel = lambda x: {bytes_col: decode_ids(path, x[ids_col].to_pylist())}
    return add_columns(source, ["_sized_", ids_col], [T.StructField(bytes_col, T.BinaryType())], kernel, encoded.columns if keep is None else keep)


def decode_range(text: str, offsets: list[int], first: int, last: int) -> bytes:
    """The bytes of tokens first to last (exclusive), cut from the text by their offsets."""
    data = text.encode()
    return data[offsets[first] : offsets[last] if last < len(offsets) else len(data)] if first < last else b""


def report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encoding and decoding share a task, so ids go straight from one to the other.
    """

    def kernel(x: dict[str, pa.Array]) -> dict[str, object]:
        each = encode_texts(path, x[text_col].to_pylist())
        digits = merger(path).digits.__getitem__
        return {
            "n_tokens": [len(ids) for ids in each],
            "ids_sha256": [sha256(",".join(map(digits, ids)).encode()).hexdigest() for ids in each],
            "decoded_sha256": [sha256(d).hexdigest() for d in decode_ids(path, each)],
        }

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return add_columns(docs, [text_col], fields, kernel, [id_col])
