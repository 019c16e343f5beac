"""Weekly KPI cards: gaps, patients, per-measure counts, one-fill and denominator gaps.

"Total gaps" here is the *row count* of the week, as on the dashboard cards
(the trend counts distinct gap ids, the segment tables non-NULL gap ids).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pdcspark.functions.numeric import distinct_count, percent_change
from pdcspark.functions.predicates import is_denominator_gap, is_one_fill
from pdcspark.operators.filters import by_weeks, date_lit
from pdcspark.schema import KPI_TITLES, MEASURE, PATIENT_ID, STANDARD_MEASURES, WEEK

CARD_COLUMNS = ("TotalGaps", "UniquePatients", "OneFillCount", "DenominatorGapCount")


def kpi_aggregates(with_measures: bool = True, exact: bool = True) -> list:
    """The KPI aggregate expressions (one pass, partial aggregation friendly).

    ``exact=False`` counts patients with HyperLogLog++ (opt-in).
    """
    aggs = [
        F.count(F.lit(1)).alias("TotalGaps"),
        distinct_count(PATIENT_ID, exact).alias("UniquePatients"),
    ]
    if with_measures:
        aggs += [
            F.count_if(F.col(MEASURE) == F.lit(code)).alias(f"{code}Count")
            for code in STANDARD_MEASURES
        ]
    aggs += [
        F.count_if(is_one_fill()).alias("OneFillCount"),
        F.count_if(is_denominator_gap()).alias("DenominatorGapCount"),
    ]
    return aggs


def weekly_kpis(df: DataFrame, exact: bool = True) -> DataFrame:
    """One KPI row for the (already filtered) rows; zeros when there are none."""
    return df.agg(*kpi_aggregates(exact=exact))


def kpis_by_week(df: DataFrame, exact: bool = True) -> DataFrame:
    """One KPI row per week (distinct patients are per week, never summed)."""
    return df.where(F.col(WEEK).isNotNull()).groupBy(WEEK).agg(*kpi_aggregates(exact=exact))


def _cards(wide: DataFrame, keys=()) -> DataFrame:
    """Unpivot cur_*/prev_* columns into one row per KPI card."""
    parts = []
    for i, (title, c) in enumerate(zip(KPI_TITLES, CARD_COLUMNS)):
        parts.append(f"{i}, '{title}', `cur_{c}`, `prev_{c}`")
    stack = F.expr(
        f"stack({len(CARD_COLUMNS)}, {', '.join(parts)}) AS (Card, Metric, Current, Previous)"
    )
    out = wide.select(*keys, stack)
    return out.withColumn("PercentChange", percent_change(F.col("Current"), F.col("Previous")))


def kpi_change(df: DataFrame, week, previous_week) -> DataFrame:
    """KPI cards: current week, previous available week, percent change.

    One scan reads both weeks and aggregates them per week; a second, one-row
    aggregate lines the two weeks up.  A week without rows counts as zeros.
    """
    per_week = by_weeks(df, [week, previous_week]).groupBy(WEEK).agg(
        *kpi_aggregates(with_measures=False)
    )
    return kpi_cards_of(per_week, week, previous_week)


def kpi_cards_of(per_week: DataFrame, week, previous_week) -> DataFrame:
    """The cards from KPI rows, one per week (stored ones, say)."""
    cur, prev = date_lit(week), date_lit(previous_week)
    wide = per_week.agg(
        *[
            F.coalesce(F.max(F.when(F.col(WEEK) == cur, F.col(c))), F.lit(0)).alias(f"cur_{c}")
            for c in CARD_COLUMNS
        ],
        *[
            F.coalesce(F.max(F.when(F.col(WEEK) == prev, F.col(c))), F.lit(0)).alias(f"prev_{c}")
            for c in CARD_COLUMNS
        ],
    )
    return _cards(wide)


def kpi_change_all_weeks(df: DataFrame) -> DataFrame:
    """Week-over-week change of the four cards for every week with rows.

    The window runs after aggregation, over one row per week (a calendar-bounded
    handful of rows), so its single partition is small at any data size.
    The oldest week has no previous week: Previous and PercentChange are NULL.
    """
    return kpi_changes_of(kpis_by_week(df))


def kpi_changes_of(per_week: DataFrame) -> DataFrame:
    """The change of every week from KPI rows, one per week (stored ones, say)."""
    w = Window.orderBy(WEEK)
    wide = per_week.select(
        WEEK,
        *[F.col(c).alias(f"cur_{c}") for c in CARD_COLUMNS],
        *[F.lag(c).over(w).alias(f"prev_{c}") for c in CARD_COLUMNS],
    )
    return _cards(wide, keys=(WEEK,))
