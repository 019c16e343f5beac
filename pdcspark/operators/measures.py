"""Gap counts by measure: distribution (donut data) with shares and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdcspark.functions.labels import measure_label
from pdcspark.functions.numeric import share_percent
from pdcspark.schema import LABEL, MEASURE, STANDARD_MEASURES


def measure_counts(df: DataFrame) -> DataFrame:
    """Rows per non-NULL measure code."""
    return df.where(F.col(MEASURE).isNotNull()).groupBy(MEASURE).agg(
        F.count(F.lit(1)).alias("Count")
    )


def _with_share(counts: DataFrame) -> DataFrame:
    # Share of total over the aggregated rows (one row per measure code).
    total = F.sum("Count").over(Window.partitionBy())
    return counts.select(
        MEASURE,
        measure_label(MEASURE).alias(LABEL),
        "Count",
        share_percent(F.col("Count"), total).alias("Percent"),
    )


def measure_distribution(df: DataFrame, fallback: bool = True,
                         standard=STANDARD_MEASURES) -> DataFrame:
    """Measure, label, count, percent of all gaps with a measure.

    With ``fallback`` (the page's rule) rows without any measure code give the
    standard measures with count 0 (percent NULL) instead of an empty table.
    """
    return distribution_of_weights(df.select(MEASURE, F.lit(1).alias("_w")), fallback, standard)


def distribution_of_weights(rows: DataFrame, fallback: bool = True,
                            standard=STANDARD_MEASURES) -> DataFrame:
    """The distribution of (measure, ``_w``) rows that stand for ``_w`` gaps each."""
    rows = rows.where(F.col(MEASURE).isNotNull())
    if fallback:
        rows = rows.unionByName(_seed(rows.sparkSession, standard).select(MEASURE, F.lit(0).alias("_w")))
    counts = rows.groupBy(MEASURE).agg(F.sum("_w").cast("long").alias("Count"))
    if fallback:
        # Seed-only codes stay only when nothing was observed (window over <= codes rows).
        counts = counts.withColumn("_any", F.max("Count").over(Window.partitionBy()))
        counts = counts.where((F.col("Count") > 0) | (F.col("_any") == 0)).drop("_any")
    return _with_share(counts)


def _seed(spark: SparkSession, codes) -> DataFrame:
    schema = T.StructType([T.StructField(MEASURE, T.StringType(), False)])
    return spark.createDataFrame([(c,) for c in codes], schema)


def measure_distribution_complete(df: DataFrame, standard=STANDARD_MEASURES) -> DataFrame:
    """Like ``measure_distribution`` but the standard measures are always present.

    Standard codes are unioned into the aggregate input as rows that count 0,
    so completion costs no join and no extra pass.
    """
    seed = _seed(df.sparkSession, standard).select(MEASURE, F.lit(0).alias("_w"))
    rows = df.where(F.col(MEASURE).isNotNull()).select(MEASURE, F.lit(1).alias("_w"))
    counts = rows.unionByName(seed).groupBy(MEASURE).agg(F.sum("_w").cast("long").alias("Count"))
    return _with_share(counts)
