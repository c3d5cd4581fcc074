"""Personal data: base patterns and a skip-chain conditional random field.

Base spans are regular matches per kind, checked (octets, Luhn sum, digit
counts). Beyond them a conditional random field labels the tokens that hold a
digit or an at sign: chain potentials join neighbouring tokens, skip potentials
join a token with the last one before it that is the same or similar (the same
core, the same digits, the same part before an at sign), and loopy message
passing over the whole document makes distant mentions agree. Each token has at
most three skip links, to the last of its fellows, so their number grows with
the text and not with its square.

The field is trained here on what the base patterns label in all documents: tasks
count feature sets with their labels and label pairs along links, Spark adds the
counts up, and from them a multinomial logistic regression gives the token
potentials and smoothed label pairs the others. Tokens that the field labels with a marginal of at least
CERTAIN become spans if no base span overlaps them.

Nulls and edges: a null text is an empty one and has no spans; texts are labelled
whole, whatever their length.
"""

from __future__ import annotations

import re
from ast import literal_eval
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import add_columns, quoted, slices

# Kinds in the order of the output.
KINDS = ("email", "ip", "card", "phone")
CERTAIN = 0.9
ROUNDS, DAMPING = 6, 0.3
_LABELS = len(KINDS) + 1  # 0 is none

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs are tried from their first digit only, as no later digit could match where it fails.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_NOT_DIGIT = re.compile(r"[^0-9]")
_EDGE = "\"'.,;:!?()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        start = end + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    if not text or not _ANY.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


# Token features.
_SIZES = (1, 2, 4, 8, 11, 16, 20)
_FEATURES = 20


def _features(token: str, core: str, digits: str) -> list[int]:
    n = len(digits)
    letters = sum(c.isalpha() for c in core)
    out = [0, 1 + sum(n >= s for s in _SIZES)]
    flags = (
        "@" in core,
        0 < core.find("@") < len(core) - 1,
        core.count(".") == 3,
        core.count(".") in (1, 2),
        token.startswith("+"),
        token.startswith("("),
        "-" in core,
        letters == 0,
        letters > n,
        "=" in token or '"' in token,
        16 <= n <= 19 and luhn(digits),
    )
    return out + [9 + i for i, f in enumerate(flags) if f]


@dataclass
class Graph:
    """The candidate tokens of one text: spans of their cores, features, and links (first, second, is a skip)."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    links: list[tuple[int, int, int]]


def graph(text: str) -> Graph:
    spans, features, links = [], [], []
    last: dict[tuple[str, str], int] = {}
    end = -2
    for m in _TOKEN.finditer(text):
        token = m[0]
        if not _ANY.search(token):
            continue
        core = token.strip(_EDGE)
        digits = _NOT_DIGIT.sub("", core)
        start = m.start() + token.find(core) if core else m.start()
        i = len(spans)
        spans.append((start, start + len(core)))
        features.append(_features(token, core, digits))
        if i and m.start() - end == 1:
            links.append((i - 1, i, 0))
        end = m.end()
        keys = [("core", core.lower())] if len(core) >= 6 else []
        if len(digits) >= 7:
            keys.append(("digits", digits))
        if "@" in core and len(core.split("@")[0]) >= 3:
            keys.append(("local", core.split("@")[0].lower()))
        skips = {last[k] for k in keys if k in last}
        links += [(j, i, 1) for j in sorted(skips)]
        last.update(dict.fromkeys(keys, i))
    return Graph(spans, features, links)


def token_labels(g: Graph, base: list[tuple[int, int, int]]) -> np.ndarray:
    """The kind (from 1) of the first base span that overlaps each token, else 0."""
    out = np.zeros(len(g.spans), dtype=np.int64)
    starts = np.array([a for a, _ in g.spans])
    ends = np.array([b for _, b in g.spans])
    for kind, a, b in reversed(base):
        i, j = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
        out[i:j] = kind + 1
    return out


@dataclass
class Field:
    weights: np.ndarray  # features x labels
    pairs: np.ndarray  # chain and skip: labels x labels, in logs


def _node_scores(features: list[list[int]], weights: np.ndarray) -> np.ndarray:
    sizes = np.array([len(f) for f in features])
    flat = np.fromiter((i for f in features for i in f), np.int64, int(sizes.sum()))
    return np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0)


def evidence(texts: Iterable[str | None]) -> Counter:
    """How often a token's features meet a label, (features, label), and a pair of labels a link, (is a skip, first, second)."""
    seen: Counter = Counter()
    for text in texts:
        if not text or not _ANY.search(text):
            continue
        g = graph(text)
        y = token_labels(g, base_spans(text)).tolist()
        seen.update((tuple(f), v) for f, v in zip(g.features, y, strict=True))
        seen.update((skip, y[i], y[j]) for i, j, skip in g.links)
    return seen


def train_field(seen: Mapping[tuple, int]) -> Field:
    """Piecewise training on counts of evidence."""
    count = {k: n for k, n in sorted(seen.items(), key=repr) if len(k) == 2}
    pairs = np.full((2, _LABELS, _LABELS), 0.1)
    pairs[1] += 2 * np.eye(_LABELS)  # before any evidence, like tokens have like labels
    for k, n in seen.items():
        if len(k) == 3:
            pairs[k] += n
    weights = np.zeros((_FEATURES, _LABELS))
    if count:
        x = np.zeros((len(count), _FEATURES))
        for row, (f, _) in enumerate(count):
            x[row, list(f)] = 1
        y = np.array([v for _, v in count])
        n = np.array(list(count.values()), dtype=float)
        want = np.eye(_LABELS)[y]
        speed = np.full_like(weights, 1e-8)
        for _ in range(400):
            score = x @ weights
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            step = x.T @ ((want - p) * n[:, None]) / n.sum() - 1e-5 * weights
            speed += step * step
            weights += 0.3 * step / np.sqrt(speed)
    # How much likelier a label pair is along a link than by chance.
    joint = pairs / pairs.sum(axis=(1, 2), keepdims=True)
    chance = joint.sum(axis=2, keepdims=True) * joint.sum(axis=1, keepdims=True)
    return Field(weights, np.log(joint / chance))


def marginals(scores: np.ndarray, links: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Label marginals by loopy message passing; links: (first, second, is a skip) rows."""

    def normal(x: np.ndarray) -> np.ndarray:
        x = x - x.max(axis=-1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))

    if not len(links):
        return np.exp(normal(scores))
    n = len(links)
    source = np.concatenate([links[:, 0], links[:, 1]])
    target = np.concatenate([links[:, 1], links[:, 0]])
    table = np.concatenate([pairs[links[:, 2]], pairs[links[:, 2]].transpose(0, 2, 1)])
    message = np.zeros((2 * n, scores.shape[1]))
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    belief = scores
    for _ in range(ROUNDS):
        sent = belief[source] - message[back]
        fresh = sent[:, :, None] + table
        top = fresh.max(axis=1, keepdims=True)
        fresh = normal((top + np.log(np.exp(fresh - top).sum(axis=1, keepdims=True)))[:, 0])
        message = DAMPING * message + (1 - DAMPING) * fresh
        total = np.zeros_like(scores)
        np.add.at(total, target, message)
        belief = scores + total
    return np.exp(normal(belief))


def find(texts: list[str | None], model: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and the spans that the field adds."""
    base = [base_spans(t) for t in texts]
    graphs = [graph(t) if t and _ANY.search(t) else None for t in texts]
    used = [k for k, g in enumerate(graphs) if g and g.spans]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if used:
        scores = _node_scores([f for k in used for f in graphs[k].features], model.weights)
        links, first, at = [], {}, 0
        for k in used:
            first[k] = at
            links += [(i + at, j + at, s) for i, j, s in graphs[k].links]
            at += len(graphs[k].spans)
        p = marginals(scores, np.array(links, dtype=np.int64).reshape(-1, 3), model.pairs)
        label = np.where(p.max(axis=1) >= CERTAIN, p.argmax(axis=1), 0)
        for k in used:
            g = graphs[k]
            mine = label[first[k] : first[k] + len(g.spans)]
            if mine.any():
                free = token_labels(g, base[k]) == 0
                joined = {j for i, j, s in g.links if not s}
                for i in np.flatnonzero((mine > 0) & free).tolist():
                    a, b = g.spans[i]
                    if a == b:
                        continue
                    kind = int(mine[i]) - 1
                    if added[k] and i in joined and free[i - 1] and mine[i - 1] == mine[i] and added[k][-1][2] == g.spans[i - 1][1]:
                        added[k][-1] = (kind, added[k][-1][1], b)
                    else:
                        added[k].append((kind, a, b))
    return list(zip(base, added, strict=True))


def train(docs: DataFrame, text_col: str = "text") -> Field:
    """The field, from counts over all documents; only the distinct feature sets, which are few, reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                seen.update(evidence(part.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(map(repr, seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["k", "n"])

    counts = docs.select(F.col(quoted(text_col)).alias("text")).mapInArrow(run, "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return train_field({literal_eval(r["k"]): r["n"] for r in counts.collect()})


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def label(docs: DataFrame, model: Field, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with base_spans and pii_spans (base and added), each (kind, start, end) in code points, end exclusive."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(x: dict[str, pa.Array]) -> dict[str, object]:
        found = find(x[text_col].to_pylist(), held.value)
        told = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]
        return {"base_spans": [told(b) for b, _ in found], "pii_spans": [told(b + a) for b, a in found]}

    return add_columns(docs, [text_col], [T.StructField("base_spans", T.ArrayType(_SPAN)), T.StructField("pii_spans", T.ArrayType(_SPAN))], kernel, keep)


def report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts of base spans by kind, their digest, all spans."""
    found = label(docs, train(docs), keep=[id_col])
    written = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *[count(k) for k in KINDS], F.sha2(written("base_spans"), 256).alias("base_sha256"), written("pii_spans").alias("spans"))


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span (kind, start, end), or run of overlapping spans, replaced by the kind of the first of them."""
    if not text or not spans:
        return text
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, model: Field | None = None, text_col: str = "text") -> DataFrame:
    """docs, in their own columns, with personal data in the texts replaced by its kind."""
    inner = docs.toDF(*[f"c{i}_" for i in range(len(docs.columns))])
    text = inner.columns[docs.columns.index(text_col)]
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col))

    def kernel(x: dict[str, pa.Array]) -> dict[str, object]:
        texts = x[text].to_pylist()
        return {text: [redacted(t, b + a) for t, (b, a) in zip(texts, find(texts, held.value), strict=True)]}

    done = add_columns(inner, [text], [T.StructField(text, T.StringType())], kernel, inner.columns)
    return done.select(*inner.columns).toDF(*docs.columns)
