"""The corpus operators against brute force on small tables with nulls, empty texts, ties and clashing columns."""

import base64
import itertools
import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from tessera.llm import bpe, chat, decontaminate, language_model, licenses, minhash, neardup_vectors, pii, quality, url_filter
from tessera.llm.text import words
from tests_prose import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)



def test_words_match_the_pattern():
    for t in ("Ab-c déF 12_3", "", "中文 x\x7fy", "a b"):
        assert [w.decode() for w in words(t.encode())] == WORD.findall(lower(t))


def test_decontamination(spark):
    item = prose(14, 1)
    short = "three little words"
    texts = [None, "", "xx " + item + " yy", prose(40, 2), "say THREE, little; words!", item, item]
    docs = documents(spark, texts).withColumnRenamed("lang", "N_WORDS").withColumnRenamed("source", "items")
    bench = spark.createDataFrame([(1, item), (2, short), (3, None), (None, short), (2, short), (4, "")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(docs, bench).collect()}
    assert [got[i]["contaminated"] for i in range(7)] == [False, False, True, False, True, True, True]
    assert (got[2]["n_words"], got[2]["n_hit"], got[2]["n_items"]) == (16, 14, 1)
    assert got[4]["n_hit"] == 3 and got[4]["items_sha256"] == sha256(b"2").hexdigest()
    assert got[0]["items_sha256"] == sha256(b"").hexdigest()
    plain = documents(spark, texts)
    assert sorted(r["doc_id"] for r in decontaminate.remove_documents(plain, bench).collect()) == [0, 1, 3]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(plain, bench).collect()}
    assert cut[2] == "xx  yy" and cut[4] == "say !" and cut[3] == texts[3]
    blocks = decontaminate.flag(plain, bench, block_pairs=3)
    assert {r["doc_id"]: (len(r["hit_spans"]) > 0, list(r["items"])) for r in blocks.collect()} == {
        i: (got[i]["contaminated"], {2: ["1"], 4: ["2"], 5: ["1"], 6: ["1"]}.get(i, [])) for i in range(7)
    }
    assert decontaminate.report(plain.limit(0), bench).count() == 0
    assert decontaminate.report(plain, bench.limit(0)).filter("contaminated").count() == 0


def test_language_model(spark):
    texts = [None, "", "A b a", "a B cé a b", *(prose(60, k) for k in range(12))]
    docs = documents(spark, texts)
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) + [""] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    for r in language_model.score(docs).collect():
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(count[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_language_model_is_a_distribution():
    slots = np.bincount(np.random.default_rng(0).integers(0, 256, 5000), minlength=256)
    w = language_model.Weights(slots)
    w.tables += np.random.default_rng(1).normal(size=w.tables.shape).astype(np.float32) * 0.1
    rows = np.random.default_rng(2).integers(0, 1 << language_model.BITS, (language_model.FEATURES, 16))
    zeros = np.zeros(16, dtype=int)
    for level in (0, 1):
        p = sum(np.exp(w.log_p(level, rows, zeros, zeros + k)) for k in range(language_model.CLASSES))
        assert p == pytest.approx(np.ones(16), abs=1e-4)


def test_language_model_scores_as_plain_loops_do(spark, monkeypatch):
    """Scores recomputed token by token from the trained weights; the model beats the base on documents held out."""
    kept = {}
    trained = language_model.train
    monkeypatch.setattr(language_model, "train", lambda *a, **b: kept.setdefault("w", trained(*a, **b)))
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 150)
    r, texts = random.Random(9), []
    nouns, verbs = [f"noun{i}" for i in range(30)], [f"verb{i}" for i in range(30)]
    for _ in range(400):
        texts.append(" ".join(f"the {r.choice(nouns)} then {r.choice(verbs)}" for _ in range(12)))
    texts += [None, "", "unseen words only"]
    got = {x["doc_id"]: x for x in language_model.score(documents(spark, texts)).collect()}
    w, tokens = kept["w"], [re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) + [""] for t in texts]
    count = Counter(t for i, d in enumerate(tokens) if zlib.crc32(str(i).encode()) % 7 != 2 for t in d)
    head = {t.encode(): k for k, (t, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0].encode()))[: language_model.HEAD])}
    slot = lambda t: int(language_model.slots_of([t.encode()], head)[0])
    inside = Counter()
    for t, n in count.items():
        inside[slot(t)] += n + 1
    for i in (0, 1, 2, 400, 401, 402):
        total, slots = 0.0, [slot(t) for t in tokens[i]]
        for k, t in enumerate(tokens[i]):
            back = [slots[k - b] if k >= b else language_model.SLOTS for b in (1, 2, 3)]
            word = zlib.crc32(tokens[i][k - 1].encode()) if k else 1
            own = slots[k] // language_model.CLASSES
            for level, salt, lead in ((0, 0, []), (1, 8, [own])):
                z = (w.class_bias if level == 0 else w.slot_bias[own]).astype(float)
                for f, part in enumerate(([back[0], back[1]], [back[0], word], [back[1]], [back[2]])):
                    z = z + w.tables[level][int(language_model._row(salt + f, *[np.array([x], dtype=np.uint64) for x in lead + part])[0])]
                want = own if level == 0 else slots[k] % language_model.CLASSES
                total += z[want] - math.log(np.exp(z).sum())
            total += math.log((count[t] + 1) / (inside[slots[k]] + 1))
        assert got[i]["score"] == pytest.approx(total / math.log(10), rel=1e-4)
    held = [x for x in got.values() if x["held_out"]]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held) + 0.1 * sum(x["n_tokens"] for x in held)


def test_licenses(spark):
    texts = [None, "", "Licensed under CC BY-NC 4.0.", "All rights reserved, all RIGHTS reserved", "under the MIT license.", "licensed under the GNU General Public License, version 3", "general public, license", "under the MIT permit"]
    got = {r["doc_id"]: r for r in licenses.report(documents(spark, texts)).collect()}
    assert [got[i]["labels"] for i in range(8)] == ["", "", "cc-by,cc-by-nc", "all-rights-reserved,reserved", "mit", "gpl,gpl-3.0", "gpl", ""]
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"], got[0]["first_word"]) == (2, 0, 3, None)
    assert got[5]["base_labels"] == "gpl" and got[6]["score"] == 0.5
    a = licenses.Automaton("one <<optional>>two<</optional>> <<var 2>> end")
    assert [a.accepts_at(t.split(), 0) for t in (b"one end", b"one two x y end", b"one x y z end", b"one two")] == [True, True, False, False]


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a\\[+]b <\\s> [\\\\INST]"), (1, 2, "assistant", None), (1, 3, "tool [x]", "t"),
        (2, 0, None, "first"), (2, 0, "user", "tie"), (2, None, "user", "early"), (None, 1, "assistant", ""), (3, 5, "user", "same"), (3, 5, "user", "same"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.report(df).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=order)
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(turns), sha256(told.encode()).hexdigest())
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), sha256(loss.encode()).hexdigest())
    assert chat.report(df.limit(0)).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:25] + 0.05 * rng.normal(size=(25, 16)), base[:5] + 0.08 * rng.normal(size=(5, 16)), base[:3], base[:2]])
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [1.0, None] * 8, 0), (204, [3.0, 4.0], 0), (205, [6.0, 8.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {r["vec_id"]: r for r in neardup_vectors.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[near[i]].min() for i in range(len(x))])
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (near[i].sum() - 1, label[i])
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(200, 206)] == [(0, 200), (0, 201), (0, 202), (0, 203), (1, 204), (1, 204)]


def test_base_spans_match_the_patterns():
    r = random.Random(5)
    for _ in range(4000):
        t = "".join(r.choice("ab@..-+ 0123459() \n%é") for _ in range(r.randrange(50)))
        want = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for kind, pattern, least, most in ((2, r"[0-9]([\x20-]?[0-9])+", 16, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
            for m in re.finditer(pattern, t):
                d = re.sub("[^0-9]", "", m[0])
                if least <= len(d) <= most and (kind == 3 or pii.luhn(d)):
                    want.append((kind, *m.span()))
        assert pii.base_spans(t) == want


def test_personal_data(spark):
    texts = [None, "", "mail bob.12@mail8.example.com now", "card 4111 1111 1111 1111, ip 10.0.0.1 or 300.1.1.1", "call +1 (733) 555-4559 x", prose(20, 1)]
    got = {r["doc_id"]: r for r in pii.report(documents(spark, texts)).collect()}
    assert [(got[i]["n_email"], got[i]["n_ip"], got[i]["n_card"], got[i]["n_phone"]) for i in range(6)] == [(0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 1, 0), (0, 0, 0, 1), (0, 0, 0, 0)]
    assert got[3]["base_sha256"] == sha256(b"ip:29:37,card:5:24").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, texts)).collect()}
    assert clean[0] is None and clean[2] == "mail [EMAIL] now" and clean[4].startswith("call [PHONE]")


def test_added_spans_follow_the_field(spark):
    """The spans beyond the base, from exact marginals: all labellings of a document's few tokens are summed up."""
    known = [f"call +1 (733) 555-4{i}59 or mail bob.{i}2@mail8.example.com from 10.0.0.{i}, card 4111 1111 1111 1111 item {i}" for i in range(10)]
    odd = ["reach 733-555-4559 or 733-555-4559 ok", "ask bob.12@localhost then bob.12@mail8.example.com", "order 77 of 1999", "at 10.0.0.1.5 x"]
    texts = known * 4 + odd
    field = pii.train_field(pii.evidence(texts))
    got = {r["doc_id"]: r["spans"] for r in pii.report(documents(spark, texts)).collect()}
    added = 0
    for i in range(40, len(texts)):
        base, g = pii.base_spans(texts[i]), pii.graph(texts[i])
        score = pii._node_scores(g.features, field.weights)
        every = list(itertools.product(range(5), repeat=len(g.spans)))
        weight = np.exp([sum(score[k, y] for k, y in enumerate(ys)) + sum(field.pairs[s, ys[a], ys[b]] for a, b, s in g.links) for ys in every])
        want = list(base)
        for k, (a, b) in enumerate(g.spans):
            p = np.bincount([ys[k] for ys in every], weights=weight, minlength=5) / weight.sum()
            assert abs(p.max() - pii.CERTAIN) > 0.01  # clear cases, which message passing must decide alike
            if p.argmax() and p.max() >= pii.CERTAIN and not any(x < b and y > a for _, x, y in base):
                want.append((int(p.argmax()) - 1, a, b))
                added += 1
        assert got[i] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(want))
    assert added


def test_skip_links_carry_labels():
    pairs = np.zeros((2, 5, 5))
    pairs[1] = 3 * np.eye(5)
    scores = np.zeros((3, 5))
    scores[0, 2] = 6.0
    linked = pii.marginals(scores, np.array([[0, 1, 1]]), pairs)
    assert linked[1, 2] > 0.8 and linked[2, 2] == pytest.approx(0.2)
    # A tree: message passing gives the exact marginals.
    joint = np.exp(scores[0][:, None] + scores[1][None] + pairs[1])
    assert linked[1] == pytest.approx(joint.sum(axis=0) / joint.sum(), abs=0.02)


def test_quality_held_out(spark):
    r = random.Random(0)
    rows, labels = [], []
    for i in range(240):
        text, good, toxic = prose(60, i), 1, 0
        if i % 4 == 1:
            text, good = text.upper().replace(" ", "!! "), 0
        elif i % 4 == 2:
            w = text.split()
            w[r.randrange(60)] = r.choice(["moronic", "moron"])
            text, toxic = " ".join(w), 1
        rows.append((i, text, "en", "s", len(text)))
        if i % 3:
            labels.append((i, good, toxic))
    docs = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", "x", "y", 0)], DOCS)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    kept = {x["doc_id"]: x["kept"] for x in quality.report(docs, marks).collect()}
    unseen = [i for i in range(240) if i % 3 == 0]
    assert sum(kept[i] == (i % 4 not in (1, 2)) for i in unseen) >= 0.95 * len(unseen)
    assert set(kept) == {*range(240), 900, 901}
    assert quality.keep_good(docs, marks.limit(0)).count() == docs.count()


@pytest.mark.parametrize("rounds", [3, 0])
def test_near_duplicates(spark, monkeypatch, rounds):
    monkeypatch.setattr(minhash, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(minhash, "TILE", 150 if rounds == 0 else minhash.TILE)
    texts = []
    for k in range(12):
        base = prose(80, 100 + k).split()
        for edits in range(4):
            w = list(base)
            for e in range(edits):
                w[(7 + 31 * e) % 80] = f"edit{k}x{e}"
            texts.append(" ".join(w))
    texts += [texts[0], "A b!", "a B", "", None, "!!", "one two three four five"]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    label = list(range(len(texts)))
    for _ in range(4):
        for i in range(len(texts)):
            for j in range(i):
                a, b = (None if t is None else t.encode() for t in (texts[i], texts[j]))
                if minhash.similarity(a, b) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    assert [got[i] for i in range(len(texts))] == label
    kept = minhash.deduplicate(documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label)) and kept.columns == documents(spark, []).columns


def test_near_duplicates_with_repeated_lines(spark):
    texts = []
    for k in range(16):
        body, line = prose(130, 300 + k), prose(10, 400 + k)
        edited = line.split()
        edited[2], edited[7] = f"edit{k}a", f"edit{k}b"
        texts += [" ".join([body] + [line] * 50), " ".join([body] + edited * 50)]
    other = prose(100, 500).split()
    texts += [" ".join(other), " ".join(other[:80] + other[80:] * 300)]
    for a, b in zip(texts[::2], texts[1::2]):
        _, e, n = minhash.shingles([words(a.encode())])
        _, f, m = minhash.shingles([words(b.encode())])
        sigs = [minhash.sketch(1, np.zeros(len(x), dtype=np.int64), x, minhash.weights(c)) for x, c in ((e, n), (f, m))]
        assert len(np.intersect1d(e, f)) / len(np.union1d(e, f)) >= 0.8 and (sigs[0] == sigs[1]).mean() < minhash.LIKELY
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))]


def test_tiles_decide_every_pair():
    r = np.random.default_rng(4)
    known = []
    for k in range(60):
        if k % 3 == 0 or r.random() < 0.2:
            e = np.unique(r.integers(0, 400, 40)).astype(np.uint64)
            c = r.choice([1, 1, 1, 5, 200], len(e))
        else:  # a copy with some elements gone and some counts changed
            e, c = known[-1][0][2:], r.choice([1, 3, 50], len(known[-1][0]) - 2)
        known.append((e, minhash.weights(c)))
    label = np.minimum(np.arange(60), 50)
    for side in (np.full(60, 3), np.where(np.arange(60) % 2, 1, 2)):
        groups = []
        for pairs in (
            [(label[i], label[j]) for i in range(60) for j in range(i) if (side[i] | side[j]) == 3 and minhash._similar(known[i], known[j]) >= 0.8 - 1e-12],
            minhash.tile_links(known, label, side, 0.8),
        ):
            of = list(range(51))
            for a, b in pairs:
                of = [min(of[a], of[b]) if x in (of[a], of[b]) else x for x in of]
            groups.append(of)
        assert groups[0] == groups[1] and len(set(groups[0])) < 45


def test_probability_jaccard():
    def slow(a, b):
        keys = set(a) | set(b)
        return sum(1 / sum(max(a.get(x, 0) / a[d], b.get(x, 0) / b[d]) for x in keys) for d in set(a) & set(b))

    r = np.random.default_rng(1)
    for _ in range(50):
        a = {int(k): float(w) for k, w in zip(r.choice(30, 12, replace=False), r.random(12) + 1.5)}
        b = {int(k): float(w) for k, w in zip(r.choice(30, 12, replace=False), r.random(12) + 1.5)}
        arrays = [(np.array(sorted(m), dtype=np.uint64), np.array([m[k] for k in sorted(m)])) for m in (a, b)]
        both = set(a) & set(b)
        assert minhash._similar(*arrays) == pytest.approx(max(slow(a, b), len(both) / len(set(a) | set(b))))


def test_bpe_matches_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    tokens = pytest.importorskip("public_tokenizers")
    path = tokens.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    pieces = ["a", "s", "t", "'", "'s", "'re", " ", "  ", "\n", "\t", " ", "9", "é", "!", "'ll", "v", "　", "中", ' "', "́", "\U0001f600"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(30))) for _ in range(3000)] + ["x" * 3000, "ab" * 5000, ""]
    assert bpe.encode_texts(path, texts) == [own.encode_ordinary(t) for t in texts]
    docs = documents(spark, [None, "", "L'été won't  end\n", texts[5]])
    for x in bpe.report(docs, path).collect():
        t = (None, "", "L'été won't  end\n", texts[5])[x["doc_id"]] or ""
        ids = own.encode_ordinary(t)
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(t.encode()).hexdigest())
    encoded = bpe.encode(docs, path)
    back = bpe.decode(encoded, path).collect()
    assert all(bytes(x["decoded"]) == (x["text"] or "").encode() for x in back)
    x = next(x for x in back if x["doc_id"] == 2)
    assert bpe.decode_range(x["text"], x["offsets"], 1, 3) == b"".join(own.decode_single_token_bytes(i) for i in x["ids"][1:3])


def test_url_filter(spark):
    urls = [None, "no scheme", "http://A.Example.ORG/en/12", "http://a.example.org/x", "https://b.com/fr/1", "https://b.com/de/1?q=/fr/", "http://good.net", "http://bad.net/#f", "http://far.net/?a"]
    html = ["", None, "", "", '<a href="http://good.net/x">', '<a href=\'https://b.com/\'>', None, '<a href="http://a.example.org/">', ""]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, html))], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(6)] == [
        ("", "", None), ("", "", None), ("a.example.org", "/en/12", "example.org/en/1"), ("a.example.org", "/x", "org/"), ("b.com", "/fr/1", "com/fr/"), ("b.com", "/de/1", "com/de/"),
    ]
    assert got[2]["verdict"] == "block" and got[3]["verdict"] == "allow"
    assert got[6]["verdict"] == "allow" and got[7]["verdict"] == "block" and got[8]["verdict"] == "allow"


def test_url_filter_hosts_of_one_domain(spark):
    rows = [("http://www.one.example.com/de/1", None), ("http://blog.one.example.com/x", ""), ("http://a.two.org/1", ""), ("http://b.two.org/2", ""), ("http://c.far.net/", '<a href="http://x.lost.net/">'), ("http://y.lost.net/", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    edges = {(r["src"], r["dst"]): r["weight"] for r in url_filter.host_edges(df).collect()}
    up = [(h, ".".join(h.split(".")[i:])) for h in ("www.one.example.com", "blog.one.example.com", "a.two.org", "b.two.org", "c.far.net", "x.lost.net", "y.lost.net") for i in range(1, h.count("."))]
    assert edges == {("c.far.net", "x.lost.net"): 1.0, **{p: 1.0 for p in up}, **{p[::-1]: 1.0 for p in up}}
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    # Dense linear algebra: rank = (1 - d) * seed + d * transposed steps * rank.
    names = sorted({h for e in edges for h in e})
    w = np.array([[edges.get((a, b), 0.0) for b in names] for a in names])
    seeds = {"trust": {"a.two.org": 0.5, "b.two.org": 0.5}, "distrust": {"www.one.example.com": 1.0}}
    for name, m in (("trust", w), ("distrust", w.T)):
        step = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
        rank = np.linalg.solve(np.eye(len(names)) - 0.85 * step.T, 0.15 * np.array([seeds[name].get(h, 0.0) for h in names]))
        for i in range(6):
            assert got[i][name] == pytest.approx(rank[names.index(got[i]["host"])], abs=2e-6)
    assert [got[i]["verdict"] for i in range(6)] == ["block", "block", "allow", "allow", "allow", "allow"]
    assert url_filter.judge(df.limit(0)).count() == 0
