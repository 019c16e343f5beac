"""Calendar expressions: week numbers, month keys and the dashboard's date texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pdcspark.schema import WEEK


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def week_start(c) -> Column:
    """Monday that starts the week of a date or timestamp (stays a DATE)."""
    return F.trunc(F.to_date(_col(c)), "week")


def week_number(c=WEEK) -> Column:
    """Week of year with weeks starting on Sunday, 0-53.

    Days before the year's first Sunday are week 0 (the SQL ``EXTRACT(WEEK)`` /
    strftime ``%U`` rule).  ``weekofyear`` is ISO-8601 and differs on most days.
    dayofyear is 1-based and dayofweek has Sunday = 1, so the 0-based form
    ``(yday + 7 - wday) / 7`` becomes ``(dayofyear + 7 - dayofweek) div 7``.
    """
    d = _col(c)
    return ((F.dayofyear(d) + F.lit(7) - F.dayofweek(d)) / F.lit(7)).cast("int")


def month_start(c=WEEK) -> Column:
    """First day of the month, as a DATE."""
    return F.trunc(_col(c), "month")


def month_label(c=WEEK) -> Column:
    """Month label such as ``Jun 2025``."""
    return F.date_format(month_start(c), "MMM yyyy")


def date_text(c=WEEK, style: str = "iso") -> Column:
    """``2025-06-02`` (iso) or ``Jun 02, 2025`` (long)."""
    pattern = {"iso": "yyyy-MM-dd", "long": "MMM dd, yyyy"}[style]
    return F.date_format(_col(c), pattern)


def week_label(c=WEEK) -> Column:
    """Week picker text: ``Week 22, 2025 (Week of Jun 02, 2025)``."""
    d = _col(c)
    return F.format_string(
        "Week %d, %d (Week of %s)", week_number(d), F.year(d), date_text(d, "long")
    )
