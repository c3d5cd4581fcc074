"""Co-training and the pipeline against plain Python without Spark, and whitening of the given table against a dense decomposition."""

import random
import re
import zlib
from collections import Counter
from math import log, log1p

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import quality
from tests_prose import prose  # noqa: I001

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_numbers(text, lang, source, n_chars):
    """The content view's numbers and the metadata view's row, from strings and loops."""
    w, raw = plain_words(text), (text or "").encode()
    if not raw:
        content = [0.0] * (9 + 14)
    else:
        among = lambda low, high: sum(low <= b <= high for b in raw)
        count, upper = max(1, len(w)), among(65, 90)
        content = [upper / max(1, upper + among(97, 122)), among(48, 57) / len(raw), among(128, 255) / len(raw), among(10, 10) / count, among(32, 32) / len(raw)]
        content += [sum(a == b for a, b in zip(w, w[1:], strict=False)) / count, len(set(w)) / count**0.9, sum(len(x.encode()) for x in w) / count / 10, log1p(count) / 5]
        content += [(raw.count(c.encode()) / count) ** 0.5 for c in "!*#$%&|@<>{}=_"]
    size = -1.0 if n_chars is None else float(np.float32(log1p(max(0, n_chars)) / 5))
    meta = [0.0] * 64 + [size, size * size, float(size < 0)]
    for kind, value in (("lang", lang), ("source", source)):
        meta[zlib.crc32(f"{kind}:{value}".encode()) % 64] += 1
    return [float(np.float32(x)) for x in content], meta


def plain_terms(text):
    w = {x.encode() for x in plain_words(text)}
    return frozenset(w | {x[:5] + b"-" for x in w})


def plain_telling(labelled):
    """labelled: id, terms, quality, toxic. Words by how unlikely their split between classes is; equal sets of terms count once."""
    first = {}
    for i, t, q, x in sorted(labelled, key=lambda r: r[0]):
        first.setdefault(t, (q, x))
    totals = [Counter(v[k] for v in first.values()) for k in (0, 1)]
    counts = {}
    for t, v in first.items():
        for term in t:
            for k in (0, 1):
                counts.setdefault(term, (Counter(), Counter()))[k][v[k]] += 1
    found = []
    for term, by in counts.items():
        best = 0.0
        for k in (0, 1):
            n0, n1, a, b = totals[k][0], totals[k][1], by[k][0], by[k][1]
            if n0 and n1:
                p, q = n1 / (n0 + n1), b / (a + b)
                best = max(best, (a + b) * sum(x * log(x / y) for x, y in ((q, p), (1 - q, 1 - p)) if x > 0))
        if sum(by[0].values()) >= 5 and best > 14.0:
            found.append((-best, term))
    return [t for _, t in sorted(found)[:240]]


class PlainLogistic:
    def __init__(self, rows, y, ridge):
        x, y = np.array(rows, dtype=float), np.array(y, dtype=float)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.array([[1.0, *((r - self.mean) / self.scale)] for r in x])
        penalty = np.array([1e-6] + [ridge] * x.shape[1])
        self.w = np.zeros(z.shape[1])
        for _ in range(10):
            p = np.array([1 / (1 + np.exp(-min(max(v, -30), 30))) for v in z @ self.w])
            step = np.linalg.solve(sum((a * (1 - a) + 1e-6) * np.outer(r, r) for a, r in zip(p, z, strict=True)) + np.diag(penalty), z.T @ (y - p) - penalty * self.w)
            self.w = self.w + step
            if max(abs(step)) < 1e-5:
                break

    def logit(self, row):
        return min(max(self.w[0] + ((np.array(row) - self.mean) / self.scale) @ self.w[1:], -30), 30)


def plain_quality(docs, labels):
    """doc_id to (p_good, p_toxic), and how many pseudo-labels each view got in the last round."""
    known = {i: (q, t) for i, q, t in labels}
    numbers = {d[0]: plain_numbers(*d[1:]) for d in docs}
    terms = {d[0]: plain_terms(d[1]) for d in docs}
    telling = plain_telling([(i, terms[i], *known[i]) for i in known])
    row = {i: (c + [float(t in terms[i]) for t in telling], m) for i, (c, m) in numbers.items()}
    got, pool = sorted(known), [i for i in row if i not in known]
    out, taught_counts = {}, {}
    for k, target in enumerate(("quality", "toxic")):
        mixed = np.random.default_rng(7).permutation(np.arange(len(got)))
        held, fit = [[got[j] for j in sorted(part)] for part in (mixed[: len(got) // 4], mixed[len(got) // 4 :])]
        own = [([row[i][v] for i in fit], [known[i][k] for i in fit]) for v in (0, 1)]
        taught = [own[0], own[1]]
        for turn in range(3):
            models = [PlainLogistic(*taught[v], ridge) for v, ridge in ((0, 0.05), (1, 1.0))]
            if turn == 2:
                break
            taught = [([*x], [*y]) for x, y in own]
            for v in (0, 1):
                for i in pool:
                    z = models[v].logit(row[i][v])
                    if abs(z) >= log(0.98 / 0.02):
                        taught[1 - v][0].append(row[i][1 - v])
                        taught[1 - v][1].append(float(z > 0))
        both = lambda i: [min(max(models[v].logit(row[i][v]), -5), 5) for v in (0, 1)]  # noqa: B023, E731
        last = PlainLogistic([both(i) for i in held], [known[i][k] for i in held], 0.1)
        taught_counts[target] = [len(taught[v][1]) - len(fit) for v in (0, 1)]
        for i in row:
            out.setdefault(i, []).append(1 / (1 + np.exp(-last.logit(both(i)))))
    return out, taught_counts


def corpus(n, item):
    """Clean, shouted and toxic prose with some copies, near copies, passages of the item and addresses; labels of two thirds."""
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        text, good, toxic = prose(45 + i % 20, 1000 + i), 1, 0
        if i % 5 == 1:
            text, good = text.upper().replace(" ", "!! "), 0
        elif i % 5 == 2:
            w = text.split()
            w[r.randrange(len(w))] = r.choice(["wretch", "wretched"])
            text, toxic = " ".join(w), 1
        elif i % 20 == 10:
            text = rows[-5][1] if i % 40 == 10 else rows[-5][1] + " tail"
        elif i % 20 == 13:
            text += " " + item
        elif i % 20 == 15:
            text += " mail bob.12@mail8.example.com now"
        rows.append((i, text, "en" if i % 3 else "de", f"s{i % 4}", len(text)))
        if i % 3:
            labels.append((i, good, toxic))
    return [*rows, (900, None, None, None, None), (901, "", "x", "y", 0)], labels


def test_co_training_does_what_plain_loops_do(spark):
    rows, labels = corpus(200, prose(15, 77))
    want, taught = plain_quality(rows, labels)
    assert min(map(max, taught.values())) > 0  # pseudo-labels were exchanged
    got = quality.report(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for r in got.collect():
        good, toxic = want[r["doc_id"]]
        assert abs(r["p_good"] - good) < 1e-5 and abs(r["p_toxic"] - toxic) < 1e-5 and abs(r["score"] - good * (1 - toxic)) < 1e-5


def shingles(text):
    w = plain_words(text)
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def alike(a, b):
    """0.8 or more of the plain Jaccard, or of the probability Jaccard of weights 1 + log(count)."""
    if not a or not b:
        return False
    wa, wb = ({s: 1 + log(n) for s, n in x.items()} for x in (a, b))
    both = wa.keys() & wb.keys()
    p = sum(1 / sum(max(wa.get(t, 0) / wa[s], wb.get(t, 0) / wb[s]) for t in wa.keys() | wb.keys()) for s in both)
    return max(p, len(both) / len(wa.keys() | wb.keys())) >= 0.8


def test_the_pipeline_keeps_what_a_plain_one_keeps(spark, tmp_path):
    import base64

    import public_tokenizers
    import tiktoken

    item = prose(15, 77)
    rows, labels = corpus(160, item)
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    scores, _ = plain_quality(rows, labels)
    left = [x for x in rows if scores[x[0]][0] >= 0.5 and scores[x[0]][1] < 0.5]
    told = {x[0]: shingles(x[1]) for x in left}
    least = {i: i for i in told}
    for i in told:  # groups by links between all pairs
        for j in told:
            if j < i and alike(told[i], told[j]):
                a, b = least[i], least[j]
                least = {k: min(a, b) if v in (a, b) else v for k, v in least.items()}
    left = [x for x in left if least[x[0]] == x[0]]
    windows = {tuple(plain_words(item)[k : k + 10]) for k in range(len(plain_words(item)) - 9)}
    clean = lambda t: not any(tuple(plain_words(t)[k : k + 10]) in windows for k in range(len(plain_words(t))))
    gone = [x[0] for x in left if not clean(x[1])]
    left = {x[0]: x[1] for x in left if clean(x[1])}
    assert len(rows) - len(told) > 40 and any(least[i] != i for i in least) and gone
    got = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == set(left)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in left.items():
        ids = encoder.encode_ordinary((text or "").replace("bob.12@mail8.example.com", "[EMAIL]"))
        assert got[i] == (len(ids), ids)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whitening_of_the_given_table(spark, sf):
    import os

    from tessera.llm.queries import op12_whitening

    d = f"/root/testdata/{sf}"
    if not os.path.isdir(d):
        pytest.skip("the given tables are not here")
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect())
    x = np.floor(64 * np.array([v for _, v in rows], dtype=float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    z = (n * x - sums) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    got = np.zeros((n, 32))
    deviation, place = ((n * x - sums) ** 2).sum(axis=1), {i: k for k, (i, _) in enumerate(rows)}
    for r in op12_whitening(spark, d).collect():
        k = place[r["vec_id"]]
        got[k, r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[k] and abs(r["explained"] - e[r["component"] - 1] / np.trace(z.T @ z / n)) < 1e-12 and r["identity_error"] < 1e-12
    want = z @ u / np.sqrt(e)
    want *= np.sign((want * got).sum(axis=0))
    assert np.abs(got - want).max() < 1e-9
