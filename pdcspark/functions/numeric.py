"""Safe arithmetic: percent change and shares that never divide by zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_change(current: Column, previous: Column) -> Column:
    """Percent change with the dashboard's zero rule.

    previous = 0: 0 if current is also 0, else 100.  Otherwise
    ``(current - previous) / previous * 100``.  NULL previous gives NULL.
    """
    ratio = F.try_divide(current - previous, previous) * F.lit(100.0)
    return (
        F.when(previous.isNull(), F.lit(None).cast("double"))
        .when(previous == 0, F.when(current == 0, F.lit(0.0)).otherwise(F.lit(100.0)))
        .otherwise(ratio)
    )


def share_percent(part: Column, total: Column) -> Column:
    """``100 * part / total``; NULL when the total is 0."""
    return F.try_divide(part.cast("double") * F.lit(100.0), total.cast("double"))


def distinct_count(c, exact: bool = True, rsd: float = 0.01) -> Column:
    """Exact ``count(DISTINCT c)``, or HyperLogLog++ with relative error ``rsd``.

    Exact distinct counts shuffle one row per distinct (group, id); the
    approximate form ships fixed-size sketches instead (opt-in, for very
    large interactive scans).
    """
    col = F.col(c) if isinstance(c, str) else c
    return F.count_distinct(col) if exact else F.approx_count_distinct(col, rsd)
