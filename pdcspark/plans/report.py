"""Report bundles: every table the dashboard page shows, as lazy DataFrames.

``weekly_report`` covers the week picker, KPI cards, measure and PDC tables,
histogram, compliance split and the market / payer tables; ``trend_report``
covers the month-over-month section.  Shared inputs are computed once:

* codes and weeks come from a code table, stored or made in one pass;
* the measure and PDC tables of the week are read from its cube, one aggregate
  of the selected rows (a few hundred cells), which is shared like the trend;
* the trend (months x measures rows) is cut from its lineage with
  ``checkpoint()`` into ``spark.checkpoint.dir`` when one is set (else
  persisted), so its five consumers do not re-aggregate the fact table;
* with ``share_week=True`` the selected week's rows are persisted (useful
  when the source is not partitioned by WeekOf; on a partitioned table the
  week is a partition read and sharing is not needed).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdcspark import operators as O
from pdcspark.sources.sinks import write_report
from pdcspark.schema import (
    COMPLIANCE_CUTOFF,
    DEFAULT_LOOKBACK_MONTHS,
    DEFAULT_NUM_WEEKS,
    LABEL,
    MARKET,
    PAYER,
    WEEK,
)


def share(df: DataFrame, how: str = "auto") -> DataFrame:
    """Reuse ``df`` across several consumers.

    ``checkpoint``: reliable checkpoint (survives executor loss, cuts lineage);
    ``persist``: memory-and-disk cache (recomputed from lineage if lost);
    ``auto``: checkpoint if the session names a checkpoint dir, else persist.
    """
    if how == "none":
        return df
    if how == "auto":
        how = "checkpoint" if df.sparkSession.sparkContext.getCheckpointDir() else "persist"
    if how == "checkpoint":
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def weekly_report(df: DataFrame, position: int = 0, measures=None, markets=None, payers=None,
                  num_weeks: int = DEFAULT_NUM_WEEKS, threshold: float = COMPLIANCE_CUTOFF,
                  share_week: bool = False, codes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The weekly section for the week at picker ``position`` (0 = newest).

    Market and payer tables are included when codes for them are selected,
    as on the page.  ``measures=None`` is the page's default, every non-NULL
    code, so rows without a code drop out; an empty list is no filter.
    ``codes`` is a stored code table; without one the codes come from one pass
    over ``df``.  The weeks are resolved once and reused as a small table.
    """
    codes = share(O.code_table(df), "persist") if codes is None else codes
    listed = O.available_weeks(codes.where("Kind = 'week'"), num_weeks)
    picked = O.week_positions(listed).orderBy("Position").collect()  # <= num_weeks rows
    if position >= len(picked):
        raise ValueError(f"the table has no week at picker position {position}")
    week, prev = picked[position][WEEK], picked[position]["PreviousWeekOf"]
    weeks = O.by_weeks(listed, [r[WEEK] for r in picked])
    filtered = O.apply_filters(df, None, default_measures(codes) if measures is None else measures, markets, payers)
    current = O.by_week(filtered, week)
    if share_week:
        current = share(current, "persist")
    cube = share(O.weekly_cube(current, threshold))
    distribution, split, rate = O.cube_distribution(cube), O.cube_compliance_split(cube), O.cube_compliance_rate(cube)
    page_stats = O.order_measures(O.cube_pdc_stats_table(cube))
    cards = O.kpi_change(filtered, week, prev)
    out = {
        "weeks": O.week_positions(weeks),
        "week_labels": O.week_labels(weeks),
        "options": O.order_options(O.options_from_codes(codes, num_weeks)),
        "record_count": O.cube_counts(cube).select("TotalGaps"),
        "record_count_text": O.record_count_text(O.cube_counts(cube)),
        "kpi_cards": cards,
        "kpi_cards_text": O.kpi_cards_text(cards).orderBy("Card"),
        "measure_distribution": O.order_counts(distribution),
        "measure_counts_text": O.measure_counts_text(O.order_counts(distribution)),
        "measure_shares_text": O.share_text(O.order_counts(distribution), LABEL),
        "pdc_stats": page_stats,
        "pdc_stats_text": O.pdc_stats_text(page_stats),
        "pdc_stats_standard": O.order_measures(O.cube_pdc_stats(cube)),
        "pdc_histogram": O.cube_histogram(cube),
        "compliance_split": split,
        "compliance_shares_text": O.share_text(split, "Status"),
        "compliance_rate": rate,
        "compliance_rate_text": O.compliance_rate_text(rate),
        "detail": O.week_detail(current),
    }
    if markets or payers:
        # Both segmentations, their texts and their chart come from one aggregate of the week.
        summaries = share(O.segment_summaries(current))
        out["segment_series"] = O.series_of_summaries(summaries)
        for name, column, chosen in (("market", MARKET, markets), ("payer", PAYER, payers)):
            if chosen:
                own = summaries.where(F.col("Segment") == column).drop("Segment").withColumnRenamed("Code", column)
                out[f"{name}_summary"] = O.order_segments(own)
                out[f"{name}_text"] = O.segment_text(O.order_segments(own), column)
    return out


def trend_report(df: DataFrame, lookback_months: int = DEFAULT_LOOKBACK_MONTHS, as_of=None,
                 measures=None, markets=None, payers=None,
                 threshold: float = COMPLIANCE_CUTOFF, how: str = "auto") -> dict[str, DataFrame]:
    """The month-over-month section, all derived from one shared trend."""
    trend = share(
        O.monthly_trend(df, lookback_months, as_of, measures, markets, payers, threshold), how
    )
    return {
        "trend": O.order_trend(trend),
        "trend_series": O.order_series(O.trend_series(trend)),
        "trend_with_thresholds": O.trend_with_thresholds(trend),
        "star_comparison": O.star_comparison(trend),
        "star_labels_text": O.star_labels_text(O.star_comparison(trend)),
        "pdc_pivot": O.pdc_pivot(trend),
        "pdc_pivot_text": O.pdc_pivot_text(trend),
        "threshold_table": O.threshold_table(
            df.sparkSession,
            O.trend_input(df, lookback_months, as_of, measures, markets, payers),
        ),
        "trend_measures": O.trend_measures(trend),
    }


def dashboard(df: DataFrame, position: int = 0, measures=None, markets=None, payers=None,
              lookback_months: int = DEFAULT_LOOKBACK_MONTHS, as_of=None,
              num_weeks: int = DEFAULT_NUM_WEEKS, codes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Both sections with the same filters.

    ``measures=None`` selects every non-NULL code, as the page does; an empty
    list is no filter, and rows without a code stay.
    """
    codes = share(O.code_table(df), "persist") if codes is None else codes
    measures = default_measures(codes) if measures is None else measures
    out = weekly_report(df, position, measures, markets, payers, num_weeks, codes=codes)
    out.update(trend_report(df, lookback_months, as_of, measures, markets, payers))
    return out


def default_measures(codes: DataFrame) -> list:
    """The page's default measure selection: every non-NULL code of a code table."""
    return sorted(r[0] for r in O.distinct_codes(codes, "measure").collect())


def write_reports(reports: dict[str, DataFrame], root: str, format: str = "parquet",
                  mode: str = "overwrite", skip=(), **options) -> list[str]:
    """Write every table of a bundle but those in ``skip`` to ``root/<name>``; returns the names."""
    written = []
    for name, df in reports.items():
        if name in skip:
            continue
        write_report(df, f"{root.rstrip('/')}/{name}", format=format, mode=mode, **options)
        written.append(name)
    return written
