"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from pdcspark.llm import (
    ann, bpe, chat, filter_audit, mixing, perplexity, pii, prefix_tokens, quality_knn, simhash, substrings, toxicity_fm, whitening,
)
from pdcspark.llm.common import small_batches, table

#: For the queries alone; whoever publishes pseudonyms has a secret key.
PII_KEY = b"pdcspark example key"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema)
    return chat.digests(chat.conversations(rows.unionByName(more)))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0, k=5)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_knn.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    return prefix_tokens.budgeted(prefix_tokens.prefix_counts(table(spark, sf_dir, "documents"), model), limit=4096)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity_fm.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return perplexity.rules(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii.pseudonymised(table(spark, sf_dir, "documents"), PII_KEY)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.long_form(whitening.whitened(table(spark, sf_dir, "embeddings"), components=32))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    done = substrings.without_repeats(table(spark, sf_dir, "documents"), window=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = filter_audit.marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(marked, filter_audit.FILTERS, ("good", "toxic"))


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_byte_bpe, op3_nearest_neighbours, op4_quality_classifier, op5_token_counts, op6_toxicity,
    op7_perplexity_rules, op8_simhash_dedup, op9_mixing, op10_pii_pseudonyms,
    op11_whitening, op12_substring_dedup, op13_filter_audit,
)}
