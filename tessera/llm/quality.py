"""Quality classifier by co-training two views of a document.

The content view sees the text: shares of upper case, digits, symbols and
repeated words, word lengths, and the words that tell labelled classes apart.
The metadata view sees language, source and length. For each target (good
quality, toxic) both views are logistic regressions. In every round each view
looks at all documents without a label and labels those it is surest of for the
other view, and both are fitted again. Labelled documents that neither was fitted
on calibrate the views (a logistic regression over both views' log-odds), and the
combined score rates all documents.

Fitting uses a bounded sample of labelled rows: LABELLED of the labels, the least by
a hash of their ids, and from each view and round the TAUGHT documents of each class
that it is surest of. All else covers every document: the telling words are counted
in Spark, the numbers of all documents are written once, and the rounds choose from
all of them. The driver gets numbers, never texts.

Nulls and edges: a null text is rated like an empty one; null language, source
or length are values of their own; labels that are null are left out, repeated
labels of a document count as the worse one; without labels of both kinds for a
target its score is 1 (good) or 0 (toxic), so that nothing is rejected unseen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import add_columns, as_bytes, checkpointed, quoted, words

#: Labelled documents that fitting uses at most, and documents of a class that a view teaches the other in a round at most.
LABELLED, TAUGHT = 8_000, 1_000
#: Words that the content view looks for at most, and documents of the sample a word must be in.
WORDS, LEAST_DOCUMENTS = 240, 5
#: Least minus log of the chance that a word is spread so unevenly.
SURPRISE = 14.0
ROUNDS, CONFIDENT = 2, 0.98
#: Ridge of each view: rare words that only one class has must be able to decide alone.
RIDGE = {"content": 0.05, "meta": 1.0}
_SLOTS = 64

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_HIGH = np.arange(256) >= 128
_SYMBOLS = b"!*#$%&|@<>{}=_"


def surface(text: bytes | None, each: list[bytes]) -> list[float]:
    """Numbers about a text's look; zeros for an empty one."""
    if not text:
        return [0.0] * (9 + len(_SYMBOLS))
    n = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    size, count = len(text), max(1, len(each))
    letters = max(1, n[_UPPER].sum() + n[_LOWER].sum())
    again = sum(a == b for a, b in zip(each, each[1:])) / count
    out = [
        n[_UPPER].sum() / letters,
        n[_DIGIT].sum() / size,
        n[_HIGH].sum() / size,
        n[10] / count,
        n[32] / size,
        again,
        len(set(each)) / count**0.9,
        sum(map(len, each)) / count / 10,
        np.log1p(count) / 5,
    ]
    return out + [float(np.sqrt(n[b] / count)) for b in _SYMBOLS]


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> list[int | float]:
    """Slots of the hashed language and source, and the length."""
    slot = lambda kind, v: zlib.crc32(f"{kind}:{v}".encode()) % _SLOTS
    return [slot("lang", lang), slot("source", source), np.log1p(max(0, n_chars)) / 5 if n_chars is not None else -1.0]


def metadata_matrix(rows: list[list[int | float]]) -> np.ndarray:
    x = np.zeros((len(rows), _SLOTS + 3))
    for i, (a, b, size) in enumerate(rows):
        x[i, a] += 1
        x[i, b] += 1
        x[i, _SLOTS :] = (size, size * size, float(size < 0))
    return x


@dataclass
class Logistic:
    """Ridge logistic regression, fitted by Newton steps on standardised columns."""

    ridge: float = 1.0
    mean: np.ndarray = field(default=None)
    scale: np.ndarray = field(default=None)
    weights: np.ndarray = field(default=None)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 10) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        penalty = np.full(z.shape[1], self.ridge)
        penalty[0] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-5:
                break
        self.weights = w
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:], -30, 30)


def _joined(content: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Both views' log-odds, limited so that a few extreme ones don't set the slope."""
    return np.clip(np.column_stack([content, meta]), -5, 5)


@dataclass
class Target:
    content: Logistic
    meta: Logistic
    both: Logistic

    def probabilities(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.content.logits(text), self.meta.logits(meta)
        s = lambda v: 1 / (1 + np.exp(-v))
        return s(a), s(b), s(self.both.logits(_joined(a, b)))


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    good: Target | None
    toxic: Target | None


def terms(each: list[bytes]) -> set[bytes]:
    """The words of a text and their beginnings of five bytes, which inflected forms share."""
    there = set(each)
    return there | {w[:5] + b"-" for w in there}


def telling_words(rows: DataFrame) -> dict[bytes, int]:
    """The words and beginnings whose presence differs most between a target's classes, by how unlikely its split is by chance.

    rows: id, text, quality, toxic. Copies of one text would make its words look
    telling, so each set of terms counts once.
    """

    def kernel(x: dict[str, pa.Array]) -> dict[str, object]:
        there = [sorted(terms(words(t))) for t in as_bytes(x["text"])]
        return {"terms": there, "digest": [md5(b" ".join(t)).digest() for t in there]}

    fields = [T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("digest", T.BinaryType())]
    each = add_columns(rows, ["text"], fields, kernel, ["id", "quality", "toxic"])
    first = checkpointed(each.groupBy("digest").agg(F.min(F.struct("id", "quality", "toxic", "terms")).alias("d")).select("d.quality", "d.toxic", "d.terms"))
    kinds = [F.count_if(F.col(t) == k).alias(f"{t}{k}") for t in ("quality", "toxic") for k in (0, 1)]
    all_of = first.agg(*kinds).first()
    counts = first.select("quality", "toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), *kinds)

    def surprise(target: str) -> F.Column:
        """Bound of the chance of so uneven a split, were the word spread like the classes."""
        n0, n1 = all_of[f"{target}0"], all_of[f"{target}1"]
        if not n0 or not n1:
            return F.lit(0.0)
        share, p = F.col(f"{target}1") / (F.col(f"{target}0") + F.col(f"{target}1")), n1 / (n0 + n1)
        part = lambda q, r: F.when(q > 0, q * F.log(q / r)).otherwise(0.0)
        return F.coalesce((F.col(f"{target}0") + F.col(f"{target}1")) * (part(share, p) + part(1 - share, 1 - p)), F.lit(0.0))

    best = counts.filter(F.col("n") >= LEAST_DOCUMENTS).select("term", F.greatest(surprise("quality"), surprise("toxic")).alias("s")).filter(F.col("s") > SURPRISE)
    return {bytes(r["term"]): i for i, r in enumerate(best.orderBy(F.desc("s"), "term").limit(WORDS).collect())}


_NUMBERS = [T.StructField("dense", T.BinaryType()), T.StructField("there", T.ArrayType(T.ShortType())), T.StructField("meta", T.BinaryType())]
_INPUTS = ["text", "lang", "source", "n_chars"]


def _told(x: dict[str, pa.Array], known: dict[bytes, int]) -> tuple[list[bytes], list[list[int]], list[bytes]]:
    """dense, there and meta of the documents of a batch."""
    dense, there = [], []
    for t in as_bytes(x["text"]):
        w = words(t)
        dense.append(np.array(surface(t, w), dtype=np.float32).tobytes())
        there.append(sorted(known[v] for v in known.keys() & terms(w)))
    rows = zip(*(x[c].to_pylist() for c in _INPUTS[1:]), strict=True)
    return dense, there, [np.array(metadata(*r), dtype=np.float32).tobytes() for r in rows]


def numbers(docs: DataFrame, vocabulary: dict[bytes, int], keep: list[str]) -> DataFrame:
    """The kept columns with dense (surface numbers), there (telling words of the text) and meta (metadata numbers)."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return add_columns(docs, _INPUTS, _NUMBERS, lambda x: dict(zip(("dense", "there", "meta"), _told(x, held.value), strict=True)), keep)


def matrices(dense: list[bytes], there: list[list[int]], meta: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The content and metadata matrices of rows of numbers; width: telling words."""
    size = len(surface(None, []))
    text = np.zeros((len(dense), size + width))
    text[:, :size] = np.frombuffer(b"".join(dense), dtype=np.float32).reshape(-1, size)
    n = [len(t) for t in there]
    text[np.repeat(np.arange(len(n)), n), size + np.fromiter((i for t in there for i in t), np.int64, sum(n))] = 1
    told = np.frombuffer(b"".join(meta), dtype=np.float32).reshape(-1, 3)
    return text, metadata_matrix([[int(a), int(b), float(c)] for a, b, c in told])


def surest(pool: DataFrame, models: dict[tuple[str, str], Logistic], width: int) -> list:
    """target, view, label, dense, there, meta of the TAUGHT documents of each class that each model is surest of, of all the pool."""
    held = pool.sparkSession.sparkContext.broadcast(models)
    least = float(np.log(CONFIDENT / (1 - CONFIDENT)))
    kind = pool.schema["id"].dataType
    schema = T.StructType([T.StructField("target", T.StringType()), T.StructField("view", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("sure", T.DoubleType()), T.StructField("id", kind), *_NUMBERS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, str, int], pa.Table] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024).select(["id", "dense", "there", "meta"])
                x = matrices(*(part.column(c).to_pylist() for c in ("dense", "there", "meta")), width)
                for (target, view), m in held.value.items():
                    z = m.logits(x[view == "meta"])
                    for label in (0, 1):
                        sure = z if label else -z
                        on = np.flatnonzero(sure >= least)
                        more = pa.Table.from_batches([part.take(pa.array(on))]).add_column(0, "sure", pa.array(sure[on]))
                        key = (target, view, label)
                        best[key] = pa.concat_tables([best[key], more]) if key in best else more
                        if best[key].num_rows > 2 * TAUGHT:
                            best[key] = best[key].take(pa.array(np.argsort(-best[key]["sure"].to_numpy(), kind="stable")[:TAUGHT])).combine_chunks()
        for (target, view, label), t in best.items():
            same = lambda v, kind, n=t.num_rows: pa.array([v] * n, kind)
            columns = [same(target, pa.string()), same(view, pa.string()), same(label, pa.int32()), *t.columns]
            yield from pa.Table.from_arrays(columns, names=[f.name for f in schema]).to_batches()

    found = checkpointed(pool.mapInArrow(run, schema))
    out = []
    for target, view in models:
        for label in (0, 1):
            of = found.filter((F.col("target") == target) & (F.col("view") == view) & (F.col("label") == label))
            out += of.orderBy(F.desc("sure"), F.xxhash64("id"), "id").limit(TAUGHT).collect()
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", rounds: int = ROUNDS) -> Model:
    """A model from a bounded sample of the labelled documents and from all others, by rounds of co-training."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(quoted(id_col)).alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = checkpointed(known)
    own = docs.select(F.col(quoted(id_col)).alias("id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    # Bounded by LABELLED; of rows that repeat an id the least stands for all.
    some = own.join(F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(LABELLED)), "id")
    some = checkpointed(some.groupBy("id").agg(F.min(F.struct("text", "lang", "source", "n_chars", "quality", "toxic")).alias("d")).select("id", "d.*"))
    model = Model(telling_words(some), None, None)
    width = len(model.vocabulary)
    got = numbers(some, model.vocabulary, ["id", "quality", "toxic"]).orderBy("id").collect()
    if not got:
        return model
    x = matrices([r["dense"] for r in got], [r["there"] for r in got], [r["meta"] for r in got], width)
    pool = checkpointed(numbers(own, model.vocabulary, ["id"]).join(known.select("id"), "id", "left_anti"))
    parts = {}
    for target in ("quality", "toxic"):
        y = np.array([np.nan if r[target] is None else float(r[target]) for r in got])
        ok = np.flatnonzero(~np.isnan(y))
        # A fixed shuffle, so that no order of the rows decides what calibrates.
        mixed = np.random.default_rng(7).permutation(ok)
        held, fit = np.sort(mixed[: len(ok) // 4]), np.sort(mixed[len(ok) // 4 :])
        if all(len(set(y[part])) == 2 for part in (held, fit)):
            parts[target] = (y, held, fit)
    views = ("content", "meta")
    taught = {(t, v): [(x[k][fit], y[fit])] for t, (y, _, fit) in parts.items() for k, v in enumerate(views)}
    for k in range(rounds + 1):
        models = {(t, v): Logistic(RIDGE[v]).fit(np.vstack([a for a, _ in rows]), np.concatenate([b for _, b in rows])) for (t, v), rows in taught.items()}
        if k == rounds or not parts:
            break
        sure = surest(pool, models, width)
        taught = {key: rows[:1] for key, rows in taught.items()}
        for t, v in models:
            of = [r for r in sure if (r["target"], r["view"]) == (t, v)]
            if of:
                more = matrices([r["dense"] for r in of], [r["there"] for r in of], [r["meta"] for r in of], width)
                other = 1 - views.index(v)
                taught[t, views[other]].append((more[other], np.array([float(r["label"]) for r in of])))
    made = {}
    for t, (y, held, _) in parts.items():
        content, meta = models[t, "content"], models[t, "meta"]
        both = _joined(content.logits(x[0][held]), meta.logits(x[1][held]))
        made[t] = Target(content, meta, Logistic(ridge=0.1).fit(both, y[held]))
    return Model(model.vocabulary, made.get("quality"), made.get("toxic"))


_SCORES = ("p_good_content", "p_good_meta", "p_good", "p_toxic_content", "p_toxic_meta", "p_toxic")


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs with each view's and the combined probabilities of good quality and toxicity."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(x: dict[str, pa.Array]) -> dict[str, object]:
        m = held.value
        text, meta = matrices(*_told(x, m.vocabulary), len(m.vocabulary))
        n = len(text)
        good = m.good.probabilities(text, meta) if m.good else [np.ones(n)] * 3
        toxic = m.toxic.probabilities(text, meta) if m.toxic else [np.zeros(n)] * 3
        return dict(zip(_SCORES, map(pa.array, (*good, *toxic)), strict=True))

    return add_columns(docs, _INPUTS, [T.StructField(c, T.DoubleType()) for c in _SCORES], kernel, keep)


def kept_rows() -> F.Column:
    return (F.col("p_good") >= 0.5) & (F.col("p_toxic") < 0.5)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, the probabilities, score (good and not toxic) and kept."""
    scored = score(docs, train(docs, labels, id_col), [id_col])
    return scored.select("*", (F.col("p_good") * (1 - F.col("p_toxic"))).alias("score"), kept_rows().alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs, in their own columns, without those that the classifier rejects."""
    inner = docs.select("*", *[F.col(quoted(c)).alias(f"_kept_{i}_") for i, c in enumerate(docs.columns)])
    saved = inner.columns[len(docs.columns) :]
    scored = score(inner, train(docs, labels, id_col), saved)
    return scored.filter(kept_rows()).select(*saved).toDF(*docs.columns)
