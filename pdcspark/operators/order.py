"""Report order, for the edge of a report: no operator sorts its own output.

An order is declared once, as a list of keys.  ``ordered`` sorts by it, and
``ranked`` gives each row's place in it, for readers that keep no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pdcspark.schema import MARKET, MEASURE, MONTH, MONTH_DATE, PAYER, WEEK, YEAR

#: (column, descending); NULLs come first going up and last going down.
ORDERS: dict[str, tuple[tuple[str, bool], ...]] = {
    "detail": ((WEEK, True),),  # newest week first
    "trend": ((YEAR, False), (MONTH, False), (MEASURE, False)),
    "series": ((MEASURE, False), ("Metric", False), (MONTH_DATE, False)),
    "counts": (("Count", True), (MEASURE, False)),  # largest first
    "measures": ((MEASURE, False),),
    "markets": ((MARKET, False),),
    "payers": ((PAYER, False),),
    "options": (("Kind", False), ("Value", False)),
}


def order_keys(order: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in ORDERS[order]]


def ordered(rows: DataFrame, order: str) -> DataFrame:
    """The rows in a declared order."""
    return rows.orderBy(*order_keys(order))


def ranked(rows: DataFrame, order: str) -> DataFrame:
    """A small report table with each row's place in a declared order, from 1; equal keys share one."""
    return rows.withColumn("Place", F.rank().over(Window.orderBy(*order_keys(order))))


def order_detail(rows: DataFrame) -> DataFrame:
    """Detail rows, newest week first."""
    return ordered(rows, "detail")


def order_trend(trend: DataFrame) -> DataFrame:
    """The trend by year, month and measure (a NULL measure first)."""
    return ordered(trend, "trend")


def order_counts(counts: DataFrame) -> DataFrame:
    """Largest count first, ties by measure."""
    return ordered(counts, "counts")


def order_measures(rows: DataFrame) -> DataFrame:
    return ordered(rows, "measures")


def segment_order(summary: DataFrame) -> str:
    return "markets" if MARKET in summary.columns else "payers"


def order_segments(summary: DataFrame) -> DataFrame:
    return ordered(summary, segment_order(summary))


def order_series(series: DataFrame) -> DataFrame:
    """Trend lines by measure and metric, each in month order."""
    return ordered(series, "series")


def order_options(options: DataFrame) -> DataFrame:
    """Options by kind, then value."""
    return ordered(options, "options")
