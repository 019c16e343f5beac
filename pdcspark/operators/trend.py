"""Month-over-month trend and everything derived from it.

``monthly_trend`` aggregates the fact table to one row per (month, measure);
the series, threshold, star-comparison and pivot tables all start from that
small result, never from the fact rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pdcspark.functions.calendar import month_label, month_start
from pdcspark.functions.labels import measure_label
from pdcspark.functions.moments import mean_of, merged
from pdcspark.functions.numeric import distinct_count
from pdcspark.functions.predicates import is_compliant, is_eligible, is_one_fill
from pdcspark.operators.cube import ONE_FILL, class_count, compliant_count, is_eligible_cell, pdc_of_cell
from pdcspark.operators.filters import apply_filters, by_codes, lookback
from pdcspark.operators.members import distinct_members
from pdcspark.operators.printed import percent, printed
from pdcspark.schema import (
    COMPLIANCE_CUTOFF,
    DEFAULT_LOOKBACK_MONTHS,
    DISPLAYED_STAR_LEVELS,
    GAP_ID,
    LABEL,
    MEASURE,
    MEASURE_LABELS,
    MONTH,
    MONTH_DATE,
    MONTH_LABEL,
    PATIENT_ID,
    PDC,
    STAR_THRESHOLDS,
    WEEK,
    YEAR,
)
from pdcspark.sources.dimensions import star_thresholds

TREND_METRICS = ("TotalGaps", "UniquePatients", "OneFillCount", "AvgPDC", "ComplianceRate")


def trend_input(df: DataFrame, lookback_months: int = DEFAULT_LOOKBACK_MONTHS, as_of=None,
                measures=None, markets=None, payers=None) -> DataFrame:
    """The rows the trend aggregates: lookback window plus optional code filters."""
    return apply_filters(lookback(df, lookback_months, as_of), None, measures, markets, payers)


def monthly_trend(df: DataFrame, lookback_months: int = DEFAULT_LOOKBACK_MONTHS, as_of=None,
                  measures=None, markets=None, payers=None,
                  threshold: float = COMPLIANCE_CUTOFF, exact: bool = True) -> DataFrame:
    """Distinct gaps and patients, one-fills, mean eligible PDC and compliance
    rate per month and measure, over the lookback window.

    ``exact=False`` (opt-in) counts distinct gaps and patients with
    HyperLogLog++ sketches: no Expand, and a shuffle of fixed-size sketches
    instead of one row per distinct id.

    Grouped by (MonthDate, measure) only - the labels are functions of the
    month and are derived after the aggregate.  A NULL measure is its own group.
    Both distinct counts run as Spark's two-level aggregate: the first shuffle
    is keyed by (month, measure, id), so no single group lands on one task.
    """
    f = trend_input(df, lookback_months, as_of, measures, markets, payers)
    elig = is_eligible()
    g = (
        f.select(
            month_start(WEEK).alias(MONTH_DATE), MEASURE, GAP_ID, PATIENT_ID,
            F.col("OneFillCode"), PDC,
        )
        .groupBy(MONTH_DATE, MEASURE)
        .agg(
            distinct_count(GAP_ID, exact).alias("TotalGaps"),
            distinct_count(PATIENT_ID, exact).alias("UniquePatients"),
            F.count_if(is_one_fill()).alias("OneFillCount"),
            F.avg(F.when(elig, F.col(PDC))).alias("AvgPDC"),
            F.try_divide(
                F.count_if(elig & is_compliant(threshold)), F.count_if(elig)
            ).alias("ComplianceRate"),
        )
    )
    return _with_labels(g)


def _with_labels(g: DataFrame) -> DataFrame:
    return g.select(
        F.month(MONTH_DATE).alias(MONTH),
        F.year(MONTH_DATE).alias(YEAR),
        month_label(MONTH_DATE).alias(MONTH_LABEL),
        MONTH_DATE,
        MEASURE,
        *TREND_METRICS,
    )


def monthly_trend_of(cube: DataFrame, members: DataFrame, lookback_months: int = DEFAULT_LOOKBACK_MONTHS,
                     as_of=None, measures=None) -> DataFrame:
    """``monthly_trend`` from stored states: the weekly cube and the weeks' member bitmaps.

    A week lies in one month, so a month's counts and moments are those of its
    weeks, merged, and its distinct ids are the union of their bitmaps.  No fact
    row is read.  The cube has no markets or payers, so only measures filter;
    the compliance cut-off is the cube's.
    """
    cells = by_codes(lookback(cube, lookback_months, as_of), MEASURE, measures)
    month = month_start(WEEK)
    additive = cells.groupBy(month.alias(MONTH_DATE), MEASURE).agg(
        class_count(ONE_FILL).alias("OneFillCount"),
        merged(F.when(is_eligible_cell(), pdc_of_cell())).alias("_pdc"),
        compliant_count().alias("_compliant"),
    )
    m = F.col("_pdc")
    additive = additive.select(
        MONTH_DATE, MEASURE, "OneFillCount", mean_of(m).alias("AvgPDC"),
        F.try_divide(F.col("_compliant").cast("double"), m["n"].cast("double")).alias("ComplianceRate"),
    )
    bits = by_codes(lookback(members, lookback_months, as_of), MEASURE, measures)
    distinct = distinct_members(bits, month, F.col(MEASURE)).withColumnsRenamed({"_k0": MONTH_DATE, "_k1": MEASURE})
    # Both sides have a row for each month and measure; a union keeps NULL measures together.
    both = additive.unionByName(distinct, allowMissingColumns=True).groupBy(MONTH_DATE, MEASURE)
    counts = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("TotalGaps", "UniquePatients", "OneFillCount")]
    return _with_labels(both.agg(*counts, F.max("AvgPDC").alias("AvgPDC"), F.max("ComplianceRate").alias("ComplianceRate")))


def trend_series(trend: DataFrame, metrics=("AvgPDC", "ComplianceRate")) -> DataFrame:
    """One line per measure and metric (long form).

    A NULL measure has no line (it matches no series on the chart).
    """
    pairs = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    return trend.where(F.col(MEASURE).isNotNull()).select(
        MEASURE,
        measure_label(MEASURE).alias(LABEL),
        MONTH_DATE,
        MONTH_LABEL,
        F.expr(f"stack({len(metrics)}, {pairs}) AS (Metric, Value)"),
    )


def trend_with_thresholds(trend: DataFrame, levels=DISPLAYED_STAR_LEVELS,
                          metric: str = "AvgPDC") -> DataFrame:
    """Trend values beside each star threshold of their measure.

    Measures without thresholds drop out (inner join); the threshold dimension
    is a fixed 9-12 row broadcast.
    """
    stars = star_thresholds(trend.sparkSession, levels)
    return trend.join(stars, MEASURE, "inner").select(
        MONTH_DATE,
        MONTH_LABEL,
        MEASURE,
        measure_label(MEASURE).alias(LABEL),
        F.col(metric).alias("Value"),
        "Stars",
        "Threshold",
    )


def star_comparison(trend: DataFrame, metric: str = "AvgPDC",
                    levels=DISPLAYED_STAR_LEVELS) -> DataFrame:
    """Current value per measure against its star thresholds.

    Current = unweighted mean of the monthly values; FirstMonth = the earliest
    month's label.  Measures without thresholds keep one row with NULL level.
    ``Meets`` says whether the current value reaches the threshold.
    """
    cur = (
        trend.where(F.col(MEASURE).isNotNull())
        .groupBy(MEASURE)
        .agg(
            F.avg(F.col(metric)).alias("Current"),
            F.min_by(F.col(MONTH_LABEL), F.col(MONTH_DATE)).alias("FirstMonth"),
        )
    )
    stars = star_thresholds(trend.sparkSession, levels)
    return cur.join(stars, MEASURE, "left").select(
        MEASURE,
        measure_label(MEASURE).alias(LABEL),
        "Current",
        "FirstMonth",
        "Stars",
        "Threshold",
        (F.col("Current") >= F.col("Threshold")).alias("Meets"),
    )


def pivot_months(trend: DataFrame, metric: str = "AvgPDC") -> list:
    """Month labels that have a value, in calendar order.

    Of the trend only the month and the metric are asked for, so Spark leaves
    its distinct counts out.  The list has at most lookback + 1 entries: it is
    bounded by the lookback, not the data.
    """
    rows = _with_value(trend, metric).select(MONTH_DATE, MONTH_LABEL).distinct().collect()
    return [label for _, label in sorted(map(tuple, rows))]


def pivot_months_of(cube: DataFrame, lookback_months: int = DEFAULT_LOOKBACK_MONTHS, as_of=None) -> list:
    """The months of ``pivot_months`` (of the mean PDC) from the stored cube, without a fact row."""
    cells = lookback(cube, lookback_months, as_of).where(is_eligible_cell() & F.col(MEASURE).isNotNull())
    rows = cells.select(month_start(WEEK).alias(MONTH_DATE), month_label(WEEK).alias(MONTH_LABEL)).distinct().collect()
    return [label for _, label in sorted(map(tuple, rows))]


def _with_value(trend: DataFrame, metric: str) -> DataFrame:
    return trend.where(F.col(MEASURE).isNotNull() & F.col(metric).isNotNull())


def _wide(cells: DataFrame, months: list) -> DataFrame:
    """(measure, month label, Value) cells, one for each pair, as a column for each month."""
    of_month = [F.max(F.when(F.col(MONTH_LABEL) == m, F.col("Value"))).alias(m) for m in months]
    return cells.groupBy(MEASURE).agg(*of_month) if of_month else cells.select(MEASURE).distinct()


def pdc_pivot(trend: DataFrame, metric: str = "AvgPDC", months=None) -> DataFrame:
    """Measure x month matrix of the metric, months in calendar order.

    Cells without a value are dropped before pivoting, so a measure or month
    that has no value at all does not appear.  The matrix is lazy and its cells
    stay in the cluster; only the list of months, the columns, is looked up
    (``pivot_months``) where it isn't given.
    """
    months = pivot_months(trend, metric) if months is None else months
    return _wide(_with_value(trend, metric).select(MEASURE, MONTH_LABEL, F.col(metric).alias("Value")), months)


def pdc_pivot_text(trend: DataFrame, metric: str = "AvgPDC", months=None) -> DataFrame:
    """The pivot as display text: label first, "86.7%" cells, "-" when empty.

    Cells are printed in long form, one expression for all, and then pivoted.
    """
    months = pivot_months(trend, metric) if months is None else months
    cells = _with_value(trend, metric).select(MEASURE, MONTH_LABEL, F.col(metric).alias("Value"))
    wide = _wide(printed(cells, Value=100).select(MEASURE, MONTH_LABEL, percent("Value")), months)
    return wide.select(
        measure_label(MEASURE).alias(LABEL),
        *[F.coalesce(F.col(f"`{m}`"), F.lit("-")).alias(m) for m in months],
    )


def threshold_table(spark, gate: DataFrame | None = None,
                    levels=DISPLAYED_STAR_LEVELS) -> DataFrame:
    """Star thresholds per measure as whole percents ("89%"), one column per level: a constant.

    With ``gate`` given, the table is shown only when ``gate`` has a row (an
    uncorrelated EXISTS, evaluated once).  The page shows it when the trend
    is non-empty; pass ``trend_input(...)`` rather than the trend itself -
    it is non-empty exactly when the trend is, and EXISTS over rows stops at
    the first one instead of running the whole aggregation.
    """
    rows = [(MEASURE_LABELS.get(m, m), *(f"{by_level[s]:.0%}" for s in levels)) for m, by_level in STAR_THRESHOLDS.items()]
    out = spark.createDataFrame(rows, ", ".join([f"{LABEL} string", *(f"`{s}-Star` string" for s in levels)]))
    if gate is not None:
        out = out.where(gate.exists())
    return out


def trend_measures(trend: DataFrame) -> DataFrame:
    """Measures present in the trend, with the trend's number of distinct months.

    The window spans the aggregated trend (months x measures rows).
    """
    months = F.size(F.collect_set(MONTH_DATE).over(Window.partitionBy()))
    return (
        trend.select(MEASURE, months.alias("NumMonths"))
        .distinct()
    )
