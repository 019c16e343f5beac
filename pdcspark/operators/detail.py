"""Row-level week detail: the filtered rows with week number and year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdcspark.functions.calendar import week_number
from pdcspark.operators.filters import apply_filters
from pdcspark.schema import WEEK, WEEK_NUMBER, WEEKLY_COLUMNS, YEAR


def week_detail(df: DataFrame, week=None, measures=None, markets=None,
                payers=None) -> DataFrame:
    """The stored columns of the selected rows plus WeekNumber and Year.

    ``week`` None keeps every week.  No ordering: the detail of one week has
    no meaningful order, and sorting all rows would cost a full shuffle.
    """
    rows = apply_filters(df, week, measures, markets, payers)
    cols = [c for c in WEEKLY_COLUMNS if c in rows.columns]
    extra = [week_number(WEEK).alias(WEEK_NUMBER), F.year(WEEK).alias(YEAR)]
    # Column order of the detail table: dates, derived week keys, then the rest.
    return rows.select(*cols[:2], *extra, *cols[2:])
