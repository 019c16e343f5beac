"""PDC (proportion of days covered) statistics on eligible rows.

Eligible = one-fill code NULL and PDC present.  Sample standard deviation is
NULL for a single row; a standard measure with no eligible rows reports zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdcspark.functions.labels import measure_label
from pdcspark.functions.numeric import share_percent
from pdcspark.functions.predicates import is_compliant, is_eligible, is_non_compliant
from pdcspark.schema import (
    ONE_FILL,
    COMPLIANCE_CUTOFF,
    COMPLIANT_STATUS,
    HISTOGRAM_BINS,
    LABEL,
    MEASURE,
    NON_COMPLIANT_STATUS,
    PDC,
    STANDARD_MEASURES,
)


def pdc_stats(df: DataFrame, threshold: float = COMPLIANCE_CUTOFF,
              standard=STANDARD_MEASURES) -> DataFrame:
    """Count, mean, sample std and compliance rate of PDC per measure.

    Rows: the standard measures plus every measure with eligible rows.  The
    standard codes enter the aggregate as PDC-less seed rows, which no
    statistic counts, so completion needs no join.
    """
    schema = T.StructType(
        [T.StructField(MEASURE, T.StringType(), False), T.StructField(PDC, T.DoubleType(), True)]
    )
    seed = df.sparkSession.createDataFrame([(c, None) for c in standard], schema)
    rows = df.where(is_eligible() & F.col(MEASURE).isNotNull()).select(MEASURE, PDC)
    pdc = F.col(PDC)
    g = rows.unionByName(seed).groupBy(MEASURE).agg(
        F.count(pdc).alias("Count"),
        F.avg(pdc).alias("_avg"),
        F.stddev_samp(pdc).alias("_std"),
        F.avg(F.when(pdc.isNotNull(), F.when(is_compliant(threshold), 1.0).otherwise(0.0))).alias(
            "_rate"
        ),
    )
    return stats_columns(g, F.col("Count"), F.col("_avg"), F.col("_std"), F.col("_rate"))


def stats_columns(g: DataFrame, count, avg, std, rate) -> DataFrame:
    """The statistics table of one row per measure: zeros where a code has no eligible rows."""
    absent = count == 0
    return g.select(
        MEASURE,
        measure_label(MEASURE).alias(LABEL),
        count.alias("Count"),
        F.when(absent, F.lit(0.0)).otherwise(avg).alias("AvgPDC"),
        F.when(absent, F.lit(0.0)).otherwise(std).alias("StdPDC"),
        F.when(absent, F.lit(0.0)).otherwise(rate).alias("ComplianceRate"),
    )


def observed_or_standard(g: DataFrame) -> DataFrame:
    """The rows observed (``_obs`` = 1), or all of them, the seeds, if none is."""
    g = g.withColumn("_any", F.max("_obs").over(Window.partitionBy()))
    return g.where((F.col("_obs") == 1) | (F.col("_any") == 0))


def pdc_stats_table(df: DataFrame, threshold: float = COMPLIANCE_CUTOFF,
                    standard=STANDARD_MEASURES) -> DataFrame:
    """The page's PDC statistics table: one row per measure *observed* in the
    rows (any row, eligible or not), zeros where a code has no eligible rows;
    the standard measures, all zero, only when no code is observed at all.

    Standard codes enter the aggregate as unobserved seed rows; a window over
    the aggregated rows (one per code) drops them once anything is observed.
    """
    spark = df.sparkSession
    schema = T.StructType([
        T.StructField(MEASURE, T.StringType(), False),
        T.StructField(PDC, T.DoubleType(), True),
        T.StructField(ONE_FILL, T.StringType(), True),
        T.StructField("_obs", T.IntegerType(), False),
    ])
    seed = spark.createDataFrame([(c, None, None, 0) for c in standard], schema)
    rows = df.where(F.col(MEASURE).isNotNull()).select(
        MEASURE, PDC, ONE_FILL, F.lit(1).alias("_obs"))
    pdc = F.when(is_eligible(), F.col(PDC))
    g = rows.unionByName(seed).groupBy(MEASURE).agg(
        F.max("_obs").alias("_obs"),
        F.count(pdc).alias("Count"),
        F.avg(pdc).alias("_avg"),
        F.stddev_samp(pdc).alias("_std"),
        F.avg(F.when(pdc.isNotNull(), F.when(is_compliant(threshold), 1.0).otherwise(0.0))).alias(
            "_rate"),
    )
    return stats_columns(observed_or_standard(g), F.col("Count"), F.col("_avg"), F.col("_std"), F.col("_rate"))


def compliance_split(df: DataFrame, threshold: float = COMPLIANCE_CUTOFF) -> DataFrame:
    """Compliant / non-compliant counts and percents over all eligible rows.

    One global aggregate (NULL measures included), unpivoted to two rows.
    """
    t = df.where(is_eligible()).agg(
        F.count_if(is_compliant(threshold)).alias("c"),
        F.count_if(is_non_compliant(threshold)).alias("n"),
        F.count(F.lit(1)).alias("total"),
    )
    return split_rows(t)


def split_rows(t: DataFrame) -> DataFrame:
    """The one row (c, n, total) as a row for each status."""
    long = t.select(
        F.expr(f"stack(2, '{COMPLIANT_STATUS}', c, '{NON_COMPLIANT_STATUS}', n) AS (Status, Count)"),
        "total",
    )
    return long.select(
        "Status", "Count", share_percent(F.col("Count"), F.col("total")).alias("Percent")
    )


def compliance_rate(df: DataFrame, threshold: float = COMPLIANCE_CUTOFF) -> DataFrame:
    """Share of eligible rows at or above the cut-off (NULL when none)."""
    return df.where(is_eligible()).agg(
        F.try_divide(F.count_if(is_compliant(threshold)), F.count(F.lit(1))).alias(
            "ComplianceRate"
        )
    )


def histogram_bin(bins: int = HISTOGRAM_BINS):
    """Bin index of ``bins`` equal bins over [0, 1]; 1.0 falls in the last bin.

    Values below 0 are in bin -1 and values above 1 in bin ``bins``.
    """
    pdc = F.col(PDC)
    inside = F.least(F.floor(pdc * F.lit(bins)), F.lit(bins - 1))
    return F.when(pdc < 0, F.lit(-1)).when(pdc > 1, F.lit(bins)).otherwise(inside).cast("int")


def pdc_histogram(df: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Eligible-row PDC histogram per measure, with percent within the measure.

    The bin below 0 has no start and the one above 1 no end.  The window
    partitions the aggregated (measure x bin) rows by measure: at most
    ``bins + 2`` rows per partition whatever the data size.
    """
    counts = (
        df.where(is_eligible() & F.col(MEASURE).isNotNull())
        .select(MEASURE, histogram_bin(bins).alias("Bin"))
        .groupBy(MEASURE, "Bin")
        .agg(F.count(F.lit(1)).alias("Count"))
    )
    return bin_shares(counts, bins)


def bin_shares(counts: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(measure, Bin, Count) rows with the bins' edges and their percent within the measure."""
    per_measure = F.sum("Count").over(Window.partitionBy(MEASURE))
    return counts.select(
        MEASURE,
        "Bin",
        F.when(F.col("Bin") >= 0, F.col("Bin") / F.lit(float(bins))).alias("BinStart"),
        F.when(F.col("Bin") < bins, (F.col("Bin") + 1) / F.lit(float(bins))).alias("BinEnd"),
        "Count",
        share_percent(F.col("Count"), per_measure).alias("Percent"),
    )


def eligible_detail(df: DataFrame) -> DataFrame:
    """The eligible rows themselves (the histogram's and split's input)."""
    return df.where(is_eligible())
