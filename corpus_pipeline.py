"""Corpus pipeline: quality, near duplicates, benchmark contamination, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept; all but the last return the columns of documents. Whoever runs
the stages writes each result as Parquet and hands it, read again, to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, minhash, pii, quality
from tessera.llm.text import checkpointed, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds good and not toxic.

    A null text is rated like an empty one; without labels of both kinds nothing goes; repeated rows share their fate.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of copies and near copies.

    Documents without words, or without an id, stay; rows that repeat an id and its words become one.
    """
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark text.

    Null and empty texts, of documents or benchmark items, have no words and no windows; such documents stay.
    """
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind, n_chars counted anew.

    A null text stays null with its n_chars; an empty one stays empty; repeated rows stay.
    """
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, offsets (first byte of each token) of every document.

    Null and empty texts have no tokens; repeated rows stay.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, path, keep=["doc_id"])
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "offsets")


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("tokens", encode_tokens),
]

#: No SQL: training and message passing can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written to the checkpoint folder before the next reads it."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
