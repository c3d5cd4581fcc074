"""The opN_ queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontaminate, fill_middle, language_model, licenses, minhash, neardup_vectors, pii, quality, top_k, url_filter, whitening
from tessera.llm.text import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hit by benchmark windows in every document; a null text has no words, repeated rows are judged each."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document; a null text is only its end token, repeated rows are scored each."""
    return language_model.score(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document; null and empty texts have no words and score 0."""
    return licenses.report(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation read back from its formatted string; null texts are empty, rows without a conversation are one, null."""
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(*[F.col(c).cast(t) for c, t in more.dtypes])
    return chat.report(turns.unionByName(more))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; null, zero and non-finite vectors stand alone, copies link with each other."""
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; a null text has no spans, repeated rows are read each."""
    return pii.report(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by both views; null texts and metadata are values of their own, without labels all are kept."""
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (least doc_id of its group), kept: whether it stands for the group; texts without words are groups of their own."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the tokens and of the decoded bytes of every document; null and empty texts have no tokens."""
    import public_tokenizers

    return bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page; a null url, or one without a scheme, has an empty host and path and is allowed."""
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for every 50th id; null and non-finite vectors take no part, ties go to the smaller id."""
    return top_k.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first 32 principal components; null and non-finite vectors are dropped, repeated rows count each."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and its parts exchanged, and rebuilt; a null text is like an empty one, plain."""
    return fill_middle.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_model": op2_language_model,
    "op3_licenses": op3_licenses,
    "op4_chat": op4_chat,
    "op5_vectors": op5_vectors,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_minhash": op8_minhash,
    "op9_bpe": op9_bpe,
    "op10_url_filter": op10_url_filter,
    "op11_top_k": op11_top_k,
    "op12_whitening": op12_whitening,
    "op13_fill_middle": op13_fill_middle,
}
