"""Week selection: latest available weeks, the k-th week, its previous week, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pdcspark.functions.calendar import date_text, week_label, week_number
from pdcspark.schema import DEFAULT_NUM_WEEKS, WEEK, WEEK_NUMBER, YEAR


def available_weeks(df: DataFrame, num_weeks: int = DEFAULT_NUM_WEEKS) -> DataFrame:
    """The latest ``num_weeks`` distinct non-NULL weeks, newest first.

    Distinct runs as a partial aggregate before the shuffle, so each task sends
    at most one row per week; the limit is a top-k (TakeOrderedAndProject).
    """
    return (
        df.where(F.col(WEEK).isNotNull())
        .select(WEEK)
        .distinct()
        .orderBy(F.col(WEEK).desc())
        .limit(int(num_weeks))
        .select(WEEK, week_number(WEEK).alias(WEEK_NUMBER), F.year(WEEK).alias(YEAR))
    )


def week_positions(weeks: DataFrame) -> DataFrame:
    """Add the picker position (0 = newest) and the previous *available* week.

    The previous week of the oldest listed week is the week itself.  ``weeks``
    holds at most ``num_weeks`` rows, so the unpartitioned window is bounded.
    """
    w = Window.orderBy(F.col(WEEK).desc())
    return weeks.select(
        (F.row_number().over(w) - 1).alias("Position"),
        WEEK,
        F.coalesce(F.lead(WEEK).over(w), F.col(WEEK)).alias("PreviousWeekOf"),
    )


def week_labels(weeks: DataFrame) -> DataFrame:
    """Picker label and header date text for each available week."""
    return weeks.select(
        WEEK,
        week_label(WEEK).alias("WeekLabel"),
        date_text(WEEK, "iso").alias("WeekText"),
    )


def select_week(df: DataFrame, position: int = 0, num_weeks: int = DEFAULT_NUM_WEEKS):
    """(week, previous week) at a picker position, as Python dates.

    Collects the <= num_weeks-row weeks frame, which is the picker's own size.
    """
    rows = (
        week_positions(available_weeks(df, num_weeks))
        .where(F.col("Position") == int(position))
        .collect()
    )
    if not rows:
        raise ValueError(f"the table has no week at picker position {position}")
    return rows[0][WEEK], rows[0]["PreviousWeekOf"]
