"""Filter options: distinct codes and the week picker entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdcspark.functions.calendar import week_label
from pdcspark.schema import DEFAULT_NUM_WEEKS, MARKET, MEASURE, PAYER, WEEK

OPTION_COLUMNS = {"measure": MEASURE, "market": MARKET, "payer": PAYER}


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-NULL values of one column."""
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def code_table(df: DataFrame) -> DataFrame:
    """(Kind, Value, WeekOf): the distinct codes of each week, and the week itself.

    One pass: each row is unpivoted into its codes, and a partial aggregate
    leaves at most one row per week and code for each task.  Stored beside the
    fact table it answers the pickers without reading fact rows.
    """
    pairs = ", ".join(f"'{k}', `{c}`" for k, c in OPTION_COLUMNS.items())
    kinds = f"stack({len(OPTION_COLUMNS) + 1}, {pairs}, 'week', CAST(`{WEEK}` AS STRING)) AS (Kind, Value)"
    rows = df.select(WEEK, *OPTION_COLUMNS.values()).select(F.expr(kinds), WEEK)
    return rows.where(F.col("Value").isNotNull()).distinct()


def distinct_codes(codes: DataFrame, kind: str) -> DataFrame:
    """``distinct_values`` of one kind, from a code table."""
    found = codes.where(F.col("Kind") == kind).select(F.col("Value").alias(OPTION_COLUMNS[kind]))
    return found.distinct()


def options_from_codes(codes: DataFrame, num_weeks: int = DEFAULT_NUM_WEEKS) -> DataFrame:
    """All picker options in long form (Kind, Value): the codes, and the latest weeks' labels."""
    own = codes.where(F.col("Kind") != "week").select("Kind", "Value").distinct()
    weeks = codes.where(F.col("Kind") == "week").select(WEEK).distinct()
    latest = weeks.orderBy(F.col(WEEK).desc()).limit(int(num_weeks))
    return own.unionByName(latest.select(F.lit("week").alias("Kind"), week_label(WEEK).alias("Value")))


def filter_options(df: DataFrame, num_weeks: int = DEFAULT_NUM_WEEKS) -> DataFrame:
    """All picker options (Kind, Value) of fact rows."""
    return options_from_codes(code_table(df), num_weeks)
