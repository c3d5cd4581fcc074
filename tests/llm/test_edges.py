"""Empty tables, and one table of nulls, empty and very long texts, repeated rows and ids, and clashing extra columns."""

import math
import re
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, chat, decontaminate, language_model, licenses, minhash, neardup_vectors, pii, quality, url_filter
from tests_prose import prose  # noqa: I001

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("id", "key", "score", "KEPT", "Labels", "n_words", "ids", "Class_ID", "base_spans", "k0", "i0", "n", "block", "hit_spans")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = prose(60_000, 1) + " bob.12@mail8.example.com all rights reserved"
ROWS = [(1, LONG), (2, LONG), (3, None), (4, ""), (5, "a b c d e f g"), (5, "a b c d e f g"), (5, "other words are in these ones"), (None, "no id at all"), (6, "mail x1@a.bc")]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in ROWS], DOCS)
    return made.select("*", *[F.lit("extra").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 7)], "doc_id long, quality int, toxic int")


def told(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def wanted(*values):
    return Counter((i, *(v(t or "") for v in values)) for i, t in ROWS)


def test_decontamination(spark, docs):
    item = " ".join(LONG.split()[-12:])
    bench = spark.createDataFrame([(1, item, 0), (1, item, 0)], "item_id long, text string, doc_id int")
    got = decontaminate.report(docs, bench)
    assert told(got, "doc_id", "n_words", "contaminated") == wanted(lambda t: len(WORD.findall(t)), lambda t: t == LONG)
    assert decontaminate.remove_documents(docs, bench).columns == docs.columns


def test_language_model(docs):
    got = language_model.score(docs)
    assert told(got, "doc_id", "n_tokens") == wanted(lambda t: len(t.split()) + 1)
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got.collect())


def test_licenses(docs):
    got = licenses.report(docs)
    n = len(WORD.findall(LONG))
    assert told(got, "doc_id", "n_words", "n_base", "last_word") == wanted(lambda t: len(WORD.findall(t)), lambda t: int(t == LONG), lambda t: n - 3 if t == LONG else None)


def test_chat(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", "ok [x]") for k in range(2000)] + [(2, 0, "assistant", LONG), (2, 0, "assistant", LONG), (3, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    df = df.select("*", *[F.lit("extra").alias(c) for c in ("turns", "N_Turns", "formatted", "id", "loss_chars")])
    assert told(chat.report(df), "conv_id", "n_turns", "loss_chars") == Counter({(1, 2000, 6000): 1, (2, 2, 2 * len(LONG)): 1, (3, 1, 0): 1})


def test_personal_data(docs):
    mail = lambda t: [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9.]+@[a-z0-9.]+", t)]
    got = pii.report(docs)
    assert told(got, "doc_id", "n_email", "base_sha256") == wanted(lambda t: len(mail(t)), lambda t: sha256(",".join(mail(t)).encode()).hexdigest())
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.filter("text LIKE '%@%'").count() == 0 and clean.filter("text IS NULL").count() == 1


def test_quality(docs, labels):
    got = quality.report(docs, labels)
    assert told(got, "doc_id") == wanted()
    p = {r["doc_id"]: r["score"] for r in got.collect()}
    assert p[1] == p[2]
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_near_duplicates(docs):
    got = minhash.near_duplicates(docs)
    assert told(got, "doc_id", "class_id") == Counter((i, 1 if i == 2 else i) for i, _ in ROWS)
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert told(kept, "doc_id", "text") == Counter({r: 1 for r in ROWS if r[0] != 2})


def test_bpe(docs):
    tokens = pytest.importorskip("public_tokenizers")
    got = bpe.report(docs, tokens.path("byte_bpe_multi_50k.tiktoken"))
    assert told(got, "doc_id", "decoded_sha256") == wanted(lambda t: sha256(t.encode()).hexdigest())


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 0.01]), (None, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(0).alias(c) for c in ("v", "cell", "Kept", "component_id", "label")])
    got = neardup_vectors.near_duplicates(df)
    assert {(r["vec_id"], r["component_id"]) for r in got.collect() if r["vec_id"] in (1, 3)} == {(1, 1), (3, 1)}
    assert got.count() == len(rows)


def test_url_filter(spark):
    rows = [(1, "http://a.org/" + "x" * 100_000, LONG), (1, "http://a.org/1", None), (1, "http://a.org/1", None), (None, "https://b.com/de/1", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("extra").alias(c) for c in ("Host", "path", "rule", "trust", "src")])
    assert told(url_filter.judge(df), "page_id", "rule", "verdict") == Counter({(1, "org/", "allow"): 3, (None, "com/de/", "block"): 1})


def test_empty_tables(spark, docs, labels):
    none = docs.limit(0)
    tokens = pytest.importorskip("public_tokenizers")
    for made in (
        language_model.score(none),
        licenses.report(none),
        pii.report(none),
        quality.report(none, labels),
        minhash.near_duplicates(none),
        bpe.report(none, tokens.path("byte_bpe_multi_50k.tiktoken")),
        neardup_vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")),
    ):
        assert made.count() == 0


def test_stages_of_empty_tables(spark, docs, tmp_path):
    none = docs.select(*corpus_pipeline.COLUMNS).limit(0)
    none.select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    none.select(F.col("doc_id").alias("item_id"), "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, none, str(tmp_path))
        assert made.count() == 0 and (name == "tokens" or made.columns == none.columns)
