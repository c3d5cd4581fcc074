"""Words below the most frequent ones are told apart by what comes before them, and counted by buckets."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import language_model


def held_out(k):
    return zlib.crc32(str(k).encode()) % 7 == 2


def test_words_that_share_a_slot_follow_their_history(spark):
    fillers = " ".join(f"f{i}" for i in range(language_model.HEAD + 8))
    pairs = " ".join(f"left{k}qq right{k}zz" for k in range(20))
    ids = iter(range(10_000))
    train = [(next(i for i in ids if not held_out(i)), t) for t in [fillers] * 50 + [pairs] * 30]
    tried = [(next(i for i in ids if held_out(i)), f"left3qq right{k}zz") for k in (3, 4)]
    got = {r["doc_id"]: r for r in language_model.score(spark.createDataFrame(train + tried, "doc_id long, text string")).collect()}
    right, wrong = (got[i] for i, _ in tried)
    assert right["held_out"] and right["base_score"] == pytest.approx(wrong["base_score"])
    assert right["score"] > wrong["score"] + 0.3


def test_leaves_are_a_distribution():
    rng = np.random.default_rng(4)
    leaves = rng.integers(0, 50, (language_model.SLOTS, language_model.LEAVES))
    w = language_model.Weights(leaves.sum(axis=1), leaves)
    w.tables += rng.normal(0, 0.2, w.tables.shape).astype(np.float32)
    every = np.arange(language_model.LEAVES)
    slot, s2, w1 = np.full(256, language_model.HEAD + 5), np.full(256, 7), np.full(256, 99, dtype=np.uint64)
    before = (s2, s2, s2, w1)
    p = np.zeros(256)
    for level, here, rows, own, want in language_model._steps(slot, before, every):
        if level > 1:
            p[here] += w.log_p(level, rows, own, want)
            assert (rows // (language_model.ROWS // language_model.NODES[level]) == own).all()
    assert np.exp(p).sum() == pytest.approx(1, abs=1e-4)


def test_buckets_count_tokens(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 20)
    rows = [(k, held_out(k), f"a b a w{k} w{k % 5} é") for k in range(40)] + [(40, False, None), (41, False, "")]
    blocks = language_model.packed(spark.createDataFrame(rows, "id long, held_out boolean, text string")).localCheckpoint()
    want = Counter(t for _, h, text in rows if not h for t in [*(text or "").encode().split(), b""])
    counts = language_model.token_counts(blocks).collect()
    got = [x for r in counts if r["tokens"] is not None for x in zip(*language_model._split(bytes(r["tokens"]), bytes(r["n"])), strict=True)]
    assert dict(got) == want and len(got) == len(want)
    vocab = {r["block"]: bytes(r["vocab"]).split(b" ") for r in blocks.collect()}
    back = Counter()
    for r in counts:
        if r["block"] is not None:
            for at, n in zip(np.frombuffer(r["at"], dtype=np.uint32), np.frombuffer(r["n"], dtype=np.uint32), strict=True):
                assert n == want[vocab[r["block"]][at]]
                back[r["block"]] += 1
    assert len(vocab) > 1 and back == {b: len(v) for b, v in vocab.items()}
    top = language_model.most_frequent(spark.createDataFrame(counts, "block long, tokens binary, at binary, n binary"))
    assert top == [w for w, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))]
