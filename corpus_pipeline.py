"""The corpus pipeline: documents in, encoded training documents out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last
return the columns of documents, with any others that docs has, whatever their
names.  No stage fails on nulls, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pdcspark.llm import bpe, mixing, pii, quality_knn, simhash
from pdcspark.llm.common import cut, small_batches, table
from pdcspark.llm.queries import PII_KEY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null, empty and blank texts score the share of label 1 among the learned
    rows, so they stay where most of those are good.  Repeated rows stay or go together.
    """
    small_batches(spark)
    return quality_knn.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays.

    Texts without words share the fingerprint zero and so are one group.  Of
    repeated rows one stays.
    """
    small_batches(spark)
    return simhash.keep_one(docs, shingle_words=3, max_bits=2)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become format-preserving pseudonyms; null texts and all rows stay."""
    small_batches(spark)
    return pii.replaced_text(docs, PII_KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources come to their target weights; a document taken twice comes twice.

    A null source is a source of its own, the last.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, its token ids, their number and digest, and the digest of the text decoded from them.

    A null text is encoded as an empty one; each row of docs gives a row.
    """
    small_batches(spark)
    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        F.col("id").alias("doc_id"), "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("mix", mix), ("encode", encode)]

#: SQL has neither the classifier, nor XXH64, nor the permutation; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: a row for each copy of a document that the stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
