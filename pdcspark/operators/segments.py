"""Market and payer summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdcspark.functions.numeric import distinct_count
from pdcspark.functions.predicates import is_one_fill
from pdcspark.schema import GAP_ID, MARKET, PATIENT_ID, PAYER, PDC


def segment_aggregates(exact: bool = True) -> list:
    """Gaps = non-NULL gap ids; mean PDC over *all* rows (one-fills included), 0 if none."""
    return [
        F.count(F.col(GAP_ID)).alias("TotalGaps"),
        distinct_count(PATIENT_ID, exact).alias("UniquePatients"),
        F.count_if(is_one_fill()).alias("OneFillCount"),
        F.coalesce(F.avg(F.col(PDC)), F.lit(0.0)).alias("AvgPDC"),
    ]


def segment_summary(df: DataFrame, key: str, exact: bool = True) -> DataFrame:
    """One row per non-NULL value of ``key`` (MarketCode or PayerCode)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*segment_aggregates(exact))


def market_summary(df: DataFrame) -> DataFrame:
    return segment_summary(df, MARKET)


def payer_summary(df: DataFrame) -> DataFrame:
    return segment_summary(df, PAYER)


def segment_summaries(df: DataFrame, exact: bool = True) -> DataFrame:
    """The market and payer summaries under each other: (Segment, Code, ...) from one scan.

    Grouping sets double the rows in front of the aggregate; the distinct
    patients of both segmentations then run as one two-level aggregate, whose
    first shuffle is keyed by (segment, code, patient).
    """
    g = df.groupingSets([[MARKET], [PAYER]], MARKET, PAYER).agg(*segment_aggregates(exact), F.grouping_id().alias("_gid"))
    of_market = F.col("_gid") == 1  # the payer is grouped away
    return g.select(
        F.when(of_market, F.lit(MARKET)).otherwise(F.lit(PAYER)).alias("Segment"),
        F.when(of_market, F.col(MARKET)).otherwise(F.col(PAYER)).alias("Code"),
        "TotalGaps", "UniquePatients", "OneFillCount", "AvgPDC",
    ).where(F.col("Code").isNotNull())


def series_of_summaries(summaries: DataFrame) -> DataFrame:
    """The chart series of ``segment_summaries``: gaps by market, mean PDC by market, gaps by payer."""
    of_market = F.col("Segment") == MARKET
    series = F.expr(
        "stack(2,"
        f" IF(Segment = '{MARKET}', 'market_gaps', 'payer_gaps'), CAST(TotalGaps AS DOUBLE),"
        " 'market_pdc', AvgPDC) AS (Series, Value)"
    )
    rows = summaries.select("Segment", F.col("Code").alias("Key"), series)
    return rows.where(of_market | (F.col("Series") == "payer_gaps")).select("Series", "Key", "Value")


def segment_series(df: DataFrame) -> DataFrame:
    """Chart series in long form: gaps by market, mean PDC by market, gaps by payer.

    Both segmentations come from one scan: a grouping-sets aggregate over
    (market) and (payer) instead of two separate group-bys.
    """
    g = df.groupingSets([[MARKET], [PAYER]], MARKET, PAYER).agg(
        F.count(F.col(GAP_ID)).alias("TotalGaps"),
        F.coalesce(F.avg(F.col(PDC)), F.lit(0.0)).alias("AvgPDC"),
        F.grouping_id().alias("_gid"),
    )
    key = F.expr(
        "stack(3,"
        f" 'market_gaps', IF(_gid = 1, `{MARKET}`, NULL), CAST(TotalGaps AS DOUBLE),"
        f" 'market_pdc', IF(_gid = 1, `{MARKET}`, NULL), AvgPDC,"
        f" 'payer_gaps', IF(_gid = 2, `{PAYER}`, NULL), CAST(TotalGaps AS DOUBLE))"
        " AS (Series, Key, Value)"
    )
    return g.select(key).where(F.col("Key").isNotNull())
