"""The printed forms of report tables: numbers as the page writes them.

Computed doubles are rounded to ``PRINTED_PLACES`` before they are printed, here
and nowhere else: the last bits of a mean depend on the order of its sum, and
would decide the text of a value that is a tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdcspark.functions.text import fixed_text, percent_text, thousands
from pdcspark.schema import LABEL, MEASURE

PRINTED_PLACES = 10


def printed(rows: DataFrame, **scales: float) -> DataFrame:
    """``rows`` with the named computed doubles as they are printed from, each times its scale.

    They are columns of their own before a text helper, which names its
    argument many times, sees them.
    """
    places = {c: F.round(F.col(c), PRINTED_PLACES) for c in scales}
    return rows.withColumns({c: places[c] * F.lit(float(k)) if k != 1 else places[c] for c, k in scales.items()})


def percent(column: str, decimals: int = 1) -> Column:
    """The text of a column that is in percent already."""
    return percent_text(column, decimals, scale=1).alias(column)


def segment_text(summary: DataFrame, key: str) -> DataFrame:
    """Market or payer table: counts with separators, mean PDC with two decimals."""
    counts = [thousands(c).alias(c) for c in ("TotalGaps", "UniquePatients", "OneFillCount")]
    return printed(summary, AvgPDC=1).select(key, *counts, fixed_text("AvgPDC", 2).alias("AvgPDC"))


def measure_counts_text(distribution: DataFrame) -> DataFrame:
    """Label and count of each measure; no rows when there is nothing to count."""
    return distribution.where(F.col("Percent").isNotNull()).select(LABEL, thousands("Count").alias("Count"))


def share_text(rows: DataFrame, name: str) -> DataFrame:
    """A pie's labels: each row's name and its percent; no rows when there is nothing to share."""
    return printed(rows.where(F.col("Percent").isNotNull()), Percent=1).select(name, percent("Percent"))


def record_count_text(counts: DataFrame) -> DataFrame:
    """The number of selected records with separators; no row when there are none."""
    return counts.where(F.col("TotalGaps") > 0).select(thousands("TotalGaps").alias("Records"))


def kpi_cards_text(cards: DataFrame) -> DataFrame:
    """The KPI cards: current value with separators, change in percent."""
    return printed(cards, PercentChange=1).select(
        "Card", "Metric", thousands("Current").alias("CurrentText"), percent("PercentChange").alias("ChangeText"))


def pdc_stats_text(stats: DataFrame) -> DataFrame:
    """The PDC statistics table: count, mean, deviation and compliance of each measure."""
    return printed(stats, AvgPDC=1, StdPDC=1, ComplianceRate=100).select(
        MEASURE, LABEL,
        thousands("Count").alias("CountText"),
        fixed_text("AvgPDC", 2).alias("AvgText"),
        fixed_text("StdPDC", 3).alias("StdText"),
        percent("ComplianceRate").alias("ComplianceText"),
    )


def compliance_rate_text(rate: DataFrame) -> DataFrame:
    """The share of compliant rows as a percent; no row when there are none."""
    return printed(rate.where(F.col("ComplianceRate").isNotNull()), ComplianceRate=100).select(percent("ComplianceRate"))


def star_labels_text(comparison: DataFrame) -> DataFrame:
    """The texts of the star chart: the bar's value, and each level's name and line labels."""
    level = F.col("Stars").cast("string")
    rows = printed(comparison, Current=100, Threshold=100)
    rows = rows.select(MEASURE, LABEL, "Stars", percent("Current").alias("ValueText"), percent("Threshold", 0))
    return rows.select(
        MEASURE,
        "Stars",
        "ValueText",
        F.concat(level, F.lit("\u2605: "), "Threshold").alias("LevelText"),
        F.concat(F.col(LABEL), F.lit(" "), level, F.lit("\u2605 ("), "Threshold", F.lit(")")).alias("LineText"),
    )
