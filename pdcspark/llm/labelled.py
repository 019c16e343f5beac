"""The labelled rows that the classifiers may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A row is held out of learning if the CRC-32 of its id's text leaves 0 divided by this.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a row is held out; one without an id has no label and isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, y) of at most ``most`` labelled ids that are not held out.

    The ids with the least hashes are taken, so the sample is the same on every
    run and bounded at any size, which also bounds its broadcast.  Null labels
    and ids are passed over; a doc_id labelled more than once has its least label,
and one with several rows gives one of them, a text of the least hash.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~held_out(F.col("doc_id")))
    one_each = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    sample = one_each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    least = F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text"), "text"))
    return rows.groupBy("doc_id").agg(least.alias("text"), F.min("y").alias("y")).select("text", "y")
