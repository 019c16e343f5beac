"""Row filters: week equality, optional code lists, lookback, eligibility.

Every filter is a plain ``where``; Catalyst merges them and pushes what it can
to the scan (partition filters when the table is partitioned by WeekOf).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdcspark.functions.predicates import is_eligible
from pdcspark.schema import DEFAULT_LOOKBACK_MONTHS, MARKET, MEASURE, PAYER, WEEK


def date_lit(d) -> Column:
    """A DATE literal from a date, datetime or ISO string."""
    if isinstance(d, Column):
        return d.cast("date")
    if isinstance(d, _dt.datetime):
        d = d.date()
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d).cast("date")


def by_week(df: DataFrame, week) -> DataFrame:
    """Rows of one week (equality on WeekOf; NULL weeks never match)."""
    return df.where(F.col(WEEK) == date_lit(week))


def by_weeks(df: DataFrame, weeks) -> DataFrame:
    """Rows of any of the given weeks (one scan for current + previous week)."""
    return df.where(F.col(WEEK).isin([date_lit(w) for w in weeks]))


def by_codes(df: DataFrame, column: str, codes=None) -> DataFrame:
    """``column IN codes``; None or an empty list means no filter (NULLs kept)."""
    if not codes:
        return df
    return df.where(F.col(column).isin(list(codes)))


def lookback(df: DataFrame, months: int = DEFAULT_LOOKBACK_MONTHS, as_of=None) -> DataFrame:
    """Weeks starting on or after ``as_of`` minus ``months`` (no upper bound).

    ``as_of`` defaults to the current date; month ends clamp (Aug 31 - 6 -> Feb 28).
    """
    base = F.current_date() if as_of is None else date_lit(as_of)
    return df.where(F.col(WEEK) >= F.add_months(base, -int(months)))


def eligible(df: DataFrame) -> DataFrame:
    """Denominator gaps with a PDC value (the rows PDC statistics use)."""
    return df.where(is_eligible())


def apply_filters(df: DataFrame, week=None, measures=None, markets=None,
                  payers=None) -> DataFrame:
    """The dashboard's conjunction of optional predicates."""
    if week is not None:
        df = by_week(df, week)
    df = by_codes(df, MEASURE, measures)
    df = by_codes(df, MARKET, markets)
    return by_codes(df, PAYER, payers)


def lookback_start(months: int = DEFAULT_LOOKBACK_MONTHS, as_of=None, spark=None) -> _dt.date:
    """Python twin of the lookback bound (for pushing it into a source).

    Without ``as_of`` the anchor is Spark's ``current_date()`` in the session
    time zone when a session is given, the same date ``lookback`` uses; the
    Python process date could differ from it around midnight.
    """
    if as_of is None and spark is not None:
        as_of = spark.range(1).select(F.current_date()).first()[0]
    if as_of is None:
        as_of = _dt.date.today()
    d = _dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    m = d.month - 1 - int(months)
    y = d.year + m // 12
    m = m % 12 + 1
    import calendar

    last = calendar.monthrange(y, m)[1]
    return _dt.date(y, m, min(d.day, last))
