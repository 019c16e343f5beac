"""The registered queries: each takes (spark, sf_dir) and returns a lazy DataFrame.

Every query reads the weekly fact table Spark derives from the whole
star-schema tables of ``sf_dir``:

* ``PDCSPARK_SOURCE=table`` (default): the derived table is a catalog table
  partitioned by WeekOf, loaded at its first use in a session and again
  whenever ``plans.materialize.load_star_weeks`` is called; queries select
  their columns and the week / lookback predicates prune partitions.
* ``PDCSPARK_SOURCE=star``: each query re-derives the rows it needs with
  ``weekly_from_star_schema`` (only the joins its columns need, week ranges
  pushed into the lineitem scan).

"The latest week" is resolved first with one small aggregate (as the
dashboard's week picker does) and then used as a literal, so it reaches the
scan.  Double results are rounded to 6 places here only, for a stable
comparison with the SQL oracles; the operators that compute never round.
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdcspark import operators as O
from pdcspark.schema import (
    DEFAULT_NUM_WEEKS,
    GAP_ID,
    LABEL,
    MARKET,
    MEASURE,
    ONE_FILL,
    PATIENT_ID,
    PAYER,
    PDC,
    WEEK,
    WEEKLY_COLUMNS,
)
from pdcspark.plans.materialize import (
    weekly_cells,
    weekly_codes,
    weekly_kpi_rows,
    weekly_members,
    weekly_table,
    weekly_table_weeks,
)
from pdcspark.session import storage_root
from pdcspark.sources.sinks import write_report
from pdcspark.sources.star import weekly_from_star_schema
from pdcspark.sources.weekly import conform

# Query parameters (the test data ends in 2001, so the trend date is pinned).
AS_OF = "2001-08-15"
LOOKBACK_MONTHS = 6
FILTER_MEASURES = ("MAC", "MAD")
FILTER_MARKETS = ("AMERICA", "ASIA", "EUROPE")
FILTER_PAYERS = ("BUILDING", "HOUSEHOLD", "MACHINERY")

KPI_COLS = [WEEK, PATIENT_ID, MEASURE, ONE_FILL]
PDC_COLS = [WEEK, MEASURE, ONE_FILL, PDC]
SEGMENT_COLS = [WEEK, GAP_ID, PATIENT_ID, MARKET, PAYER, ONE_FILL, PDC]
TREND_COLS = [WEEK, GAP_ID, PATIENT_ID, MEASURE, MARKET, PAYER, ONE_FILL, PDC]
TREND_COLS_UNFILTERED = [WEEK, GAP_ID, PATIENT_ID, MEASURE, ONE_FILL, PDC]


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), places).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def source_mode() -> str:
    """``table`` or ``star``.  Table mode needs a shared folder: a cluster without
    ``spark.checkpoint.dir`` is an error, never another mode."""
    mode = os.environ.get("PDCSPARK_SOURCE", "table")
    if mode not in ("table", "star"):
        raise ValueError(f"PDCSPARK_SOURCE is {mode!r}; table or star is needed")
    return mode


def _weekly(spark, sf, columns, weeks=None, since=None) -> DataFrame:
    if source_mode() == "star":
        return weekly_from_star_schema(spark, sf, columns=columns, weeks=weeks, since=since)
    # The operators' own WeekOf predicates become partition filters here.
    return weekly_table(spark, sf).select(*columns)


def _picker(spark, sf, position: int = 0):
    """(week, previous available week) at a picker position (0 = newest), as the
    week picker resolves them; the oldest listed week's previous week is itself.

    Table mode reads the partition listing (no job); star mode runs the
    picker's small top-k over a WeekOf-only lineitem scan.
    """
    if source_mode() == "star":
        return O.select_week(_weekly(spark, sf, [WEEK]), position)
    newest_first = weekly_table_weeks(spark, sf)[::-1][:DEFAULT_NUM_WEEKS]
    if position >= len(newest_first):
        raise ValueError(f"the table has no week at picker position {position}")
    return newest_first[position], newest_first[min(position + 1, len(newest_first) - 1)]


def _current_and_previous(spark, sf):
    return _picker(spark, sf, 0)


def _latest(spark, sf) -> _dt.date:
    return _picker(spark, sf, 0)[0]


def _week_slice(spark, sf, columns, week=None) -> DataFrame:
    w = week or _latest(spark, sf)
    return O.by_week(_weekly(spark, sf, columns, weeks=[w]), w)


def _trend(spark, sf, filtered: bool = False) -> DataFrame:
    since = O.lookback_start(LOOKBACK_MONTHS, AS_OF)
    cols = TREND_COLS if filtered else TREND_COLS_UNFILTERED
    df = _weekly(spark, sf, cols, since=since)
    if filtered:
        return O.monthly_trend(df, LOOKBACK_MONTHS, AS_OF, FILTER_MEASURES, FILTER_MARKETS,
                               FILTER_PAYERS)
    return O.monthly_trend(df, LOOKBACK_MONTHS, AS_OF)


# --------------------------------------------------------------------- queries


def q_weekly_detail(spark, sf):
    w = _latest(spark, sf)
    return O.week_detail(_weekly(spark, sf, list(WEEKLY_COLUMNS), weeks=[w]), w)


def _codes(spark, sf) -> DataFrame:
    """The code table: stored beside the weekly table, or one pass over the star schema."""
    if source_mode() == "star":
        return O.code_table(_weekly(spark, sf, [WEEK, MEASURE, MARKET, PAYER]))
    return weekly_codes(spark, sf)


def _weeks(spark, sf) -> DataFrame:
    """The available weeks: the stored weeks, or a WeekOf-only scan of the star schema."""
    if source_mode() == "star":
        return O.available_weeks(_weekly(spark, sf, [WEEK]))
    return O.available_weeks(weekly_codes(spark, sf).where(F.col("Kind") == "week"))


def q_available_weeks(spark, sf):
    return _weeks(spark, sf)


def q_week_labels(spark, sf):
    return O.week_labels(_weeks(spark, sf))


def q_previous_week(spark, sf):
    return O.week_positions(_weeks(spark, sf))


def q_distinct_measures(spark, sf):
    return O.distinct_codes(_codes(spark, sf), "measure")


def q_distinct_markets(spark, sf):
    return O.distinct_codes(_codes(spark, sf), "market")


def q_distinct_payers(spark, sf):
    return O.distinct_codes(_codes(spark, sf), "payer")


def q_filter_options(spark, sf):
    return O.options_from_codes(_codes(spark, sf))


def q_weekly_kpis(spark, sf):
    return O.weekly_kpis(_week_slice(spark, sf, KPI_COLS))


def q_weekly_kpis_filtered(spark, sf):
    w = _latest(spark, sf)
    df = _weekly(spark, sf, KPI_COLS + [MARKET, PAYER], weeks=[w])
    return O.weekly_kpis(O.apply_filters(df, w, FILTER_MEASURES, FILTER_MARKETS, FILTER_PAYERS))


def q_empty_week(spark, sf):
    w = _latest(spark, sf) + _dt.timedelta(days=7)
    return O.weekly_kpis(_week_slice(spark, sf, KPI_COLS, week=w))


def q_kpi_change(spark, sf):
    cur, prev = _current_and_previous(spark, sf)
    df = _weekly(spark, sf, KPI_COLS, weeks=[cur, prev])
    return round_doubles(O.kpi_change(df, cur, prev))


def _kpi_rows(spark, sf) -> DataFrame:
    """The KPI row of each week: kept by the load, or one pass over the star schema."""
    if source_mode() == "star":
        return O.kpis_by_week(_weekly(spark, sf, KPI_COLS))
    return weekly_kpi_rows(spark, sf)


def q_kpi_change_all_weeks(spark, sf):
    return round_doubles(O.kpi_changes_of(_kpi_rows(spark, sf)))


def q_kpi_change_stored(spark, sf):
    """The KPI cards of the latest week from the stored KPI rows."""
    cur, prev = _current_and_previous(spark, sf)
    return round_doubles(O.kpi_cards_of(_kpi_rows(spark, sf), cur, prev))


def q_kpi_change_oldest_week(spark, sf):
    """The oldest of the 12 listed weeks: its previous week is itself (all changes 0)."""
    week, prev = _picker(spark, sf, DEFAULT_NUM_WEEKS - 1)
    return round_doubles(O.kpi_change(_weekly(spark, sf, KPI_COLS, weeks=[week]), week, prev))


def q_kpis_by_week(spark, sf):
    return _kpi_rows(spark, sf)


def q_weekly_kpis_default_filters(spark, sf):
    """The page's default selection: every non-NULL measure code, so NULL-measure
    rows drop out (one small distinct for the code list)."""
    codes = [r[0] for r in O.distinct_codes(_codes(spark, sf), "measure").collect()]
    w = _latest(spark, sf)
    df = _weekly(spark, sf, KPI_COLS, weeks=[w])
    return O.weekly_kpis(O.apply_filters(df, w, measures=codes))


def q_weekly_kpis_text(spark, sf):
    cur, prev = _current_and_previous(spark, sf)
    return O.kpi_cards_text(O.kpi_change(_weekly(spark, sf, KPI_COLS, weeks=[cur, prev]), cur, prev))


def q_measure_distribution(spark, sf):
    return round_doubles(O.measure_distribution(_week_slice(spark, sf, [WEEK, MEASURE])))


def q_measure_distribution_complete(spark, sf):
    w = _latest(spark, sf)
    df = O.apply_filters(_weekly(spark, sf, [WEEK, MEASURE], weeks=[w]), w, FILTER_MEASURES)
    return round_doubles(O.measure_distribution_complete(df))


def q_pdc_stats(spark, sf):
    return round_doubles(O.pdc_stats(_week_slice(spark, sf, PDC_COLS)))


def q_pdc_stats_nan(spark, sf):
    """PDC statistics of values that hold NaN: the load makes them NULL, so none counts."""
    rows = _week_slice(spark, sf, PDC_COLS)
    holed = rows.withColumn(PDC, F.when(F.col(PDC) > 0.95, F.lit(float("nan"))).otherwise(F.col(PDC)))
    return round_doubles(O.pdc_stats(conform(holed, PDC_COLS)))


def q_pdc_histogram_out_of_range(spark, sf):
    """The histogram of PDC spread beyond [0, 1]: what is below and above has bins of its own."""
    rows = _week_slice(spark, sf, PDC_COLS)
    return round_doubles(O.pdc_histogram(rows.withColumn(PDC, (F.col(PDC) - F.lit(0.6)) * F.lit(3.0))))


def q_segment_text(spark, sf):
    """The printed market and payer tables, one under the other, from one scan."""
    rows = O.segment_summaries(_week_slice(spark, sf, SEGMENT_COLS)).withColumn("Key", F.struct("Segment", "Code"))
    text = O.segment_text(rows, "Key")
    return text.select("Key.Segment", "Key.Code", "TotalGaps", "UniquePatients", "OneFillCount", "AvgPDC")


def q_segment_summaries(spark, sf):
    return round_doubles(O.segment_summaries(_week_slice(spark, sf, SEGMENT_COLS)))


def q_segment_series_of_summaries(spark, sf):
    return round_doubles(O.series_of_summaries(O.segment_summaries(_week_slice(spark, sf, SEGMENT_COLS))))


def q_measure_counts_text(spark, sf):
    return O.measure_counts_text(O.measure_distribution(_week_slice(spark, sf, [WEEK, MEASURE])))


def q_compliance_rate_text(spark, sf):
    return O.compliance_rate_text(O.compliance_rate(_week_slice(spark, sf, PDC_COLS)))


def q_star_labels_text(spark, sf):
    return O.star_labels_text(O.star_comparison(_trend(spark, sf)))


def q_measure_distribution_ranked(spark, sf):
    """The counts in report order; the window spans one row per code."""
    return round_doubles(O.ranked(O.measure_distribution(_week_slice(spark, sf, [WEEK, MEASURE])), "counts"))


def q_monthly_trend_ranked(spark, sf):
    """The trend in report order; the window spans months x measures rows."""
    return round_doubles(O.ranked(_trend(spark, sf), "trend"))


def q_trend_series_ranked(spark, sf):
    """The lines of the trend chart in drawing order; months x measures x metrics rows."""
    return round_doubles(O.ranked(O.trend_series(_trend(spark, sf)), "series"))


def q_market_summary_ranked(spark, sf):
    return round_doubles(O.ranked(O.market_summary(_week_slice(spark, sf, SEGMENT_COLS)), "markets"))


def q_payer_summary_ranked(spark, sf):
    return round_doubles(O.ranked(O.payer_summary(_week_slice(spark, sf, SEGMENT_COLS)), "payers"))


def q_pdc_stats_ranked(spark, sf):
    return round_doubles(O.ranked(O.pdc_stats(_week_slice(spark, sf, PDC_COLS)), "measures"))


def q_filter_options_ranked(spark, sf):
    return O.ranked(O.options_from_codes(_codes(spark, sf)), "options")


def q_detail_newest_first(spark, sf):
    """Detail of the latest two weeks with each week's place in the order of the detail.

    The window ranks the two weeks, not the rows."""
    cur, prev = _current_and_previous(spark, sf)
    rows = O.week_detail(O.by_weeks(_weekly(spark, sf, list(WEEKLY_COLUMNS), weeks=[cur, prev]), [cur, prev]))
    places = O.ranked(spark.createDataFrame([(cur,), (prev,)], f"{WEEK} date").distinct(), "detail")
    return O.order_detail(rows.join(F.broadcast(places), WEEK))


def q_report_written(spark, sf):
    """A report table as the sink writes it and Spark reads it back."""
    folder = f"{storage_root(spark)}/pdcspark-reports/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}"
    write_report(round_doubles(O.market_summary(_week_slice(spark, sf, SEGMENT_COLS))), folder)
    return spark.read.parquet(folder)


def q_pdc_stats_page(spark, sf):
    """The page's statistics table: codes observed in the latest week."""
    return round_doubles(O.pdc_stats_table(_week_slice(spark, sf, PDC_COLS)))


def q_measure_distribution_empty_week(spark, sf):
    """A week without rows: the page falls back to the three standard measures."""
    w = _latest(spark, sf) + _dt.timedelta(days=7)
    return round_doubles(O.measure_distribution(_week_slice(spark, sf, [WEEK, MEASURE], week=w)))


def q_pdc_stats_text(spark, sf):
    return O.pdc_stats_text(O.pdc_stats(_week_slice(spark, sf, PDC_COLS)))


def q_pdc_stats_page_text(spark, sf):
    """The statistics table as the page prints it: codes observed in the latest week."""
    return O.pdc_stats_text(O.cube_pdc_stats_table(_latest_cells(spark, sf)))


def q_measure_shares_text(spark, sf):
    """The labels of the measure pie."""
    return O.share_text(O.cube_distribution(_latest_cells(spark, sf)), LABEL)


def q_compliance_shares_text(spark, sf):
    """The labels of the compliance pie."""
    return O.share_text(O.cube_compliance_split(_latest_cells(spark, sf)), "Status")


def q_record_count_text(spark, sf):
    return O.record_count_text(O.cube_counts(_latest_cells(spark, sf)))


def q_compliance_split(spark, sf):
    return round_doubles(O.compliance_split(_week_slice(spark, sf, PDC_COLS)))


def q_compliance_rate(spark, sf):
    return round_doubles(O.compliance_rate(_week_slice(spark, sf, PDC_COLS)))


def q_pdc_histogram(spark, sf):
    return round_doubles(O.pdc_histogram(_week_slice(spark, sf, PDC_COLS)))


def q_pdc_eligible_detail(spark, sf):
    df = O.eligible_detail(_week_slice(spark, sf, [WEEK, GAP_ID, PATIENT_ID] + PDC_COLS[1:]))
    return df.select(WEEK, GAP_ID, PATIENT_ID, MEASURE, PDC)


def q_market_summary(spark, sf):
    return round_doubles(O.market_summary(_week_slice(spark, sf, SEGMENT_COLS)))


def q_payer_summary(spark, sf):
    return round_doubles(O.payer_summary(_week_slice(spark, sf, SEGMENT_COLS)))


def q_market_summary_filtered(spark, sf):
    """The market section as shown when markets are selected (with a payer filter too)."""
    w = _latest(spark, sf)
    df = O.apply_filters(_weekly(spark, sf, SEGMENT_COLS + [MEASURE], weeks=[w]), w,
                         FILTER_MEASURES, FILTER_MARKETS, FILTER_PAYERS)
    return round_doubles(O.market_summary(df))


def q_payer_summary_filtered(spark, sf):
    w = _latest(spark, sf)
    df = O.apply_filters(_weekly(spark, sf, SEGMENT_COLS, weeks=[w]), w, None, None,
                         FILTER_PAYERS)
    return round_doubles(O.payer_summary(df))


def q_segment_series(spark, sf):
    return round_doubles(O.segment_series(_week_slice(spark, sf, SEGMENT_COLS)))


def q_monthly_trend(spark, sf):
    return round_doubles(_trend(spark, sf))


def _cube(spark, sf, since=None) -> DataFrame:
    """The weekly cube: kept by the load, or one pass over the star schema."""
    if source_mode() == "star":
        return O.weekly_cube(_weekly(spark, sf, PDC_COLS, since=since))
    return weekly_cells(spark, sf)


def _members(spark, sf) -> DataFrame:
    """The member bitmaps, kept by the load; star mode has no load and no numbers, and reads the table's."""
    return weekly_members(spark, sf)


def _latest_cells(spark, sf) -> DataFrame:
    return O.by_week(_cube(spark, sf), _latest(spark, sf))


def q_week_cube(spark, sf):
    """The cells of the latest week."""
    return round_doubles(_latest_cells(spark, sf))


def q_week_counts_cube(spark, sf):
    return O.cube_counts(_latest_cells(spark, sf))


def q_measure_distribution_cube(spark, sf):
    return round_doubles(O.cube_distribution(_latest_cells(spark, sf)))


def q_pdc_stats_cube(spark, sf):
    return round_doubles(O.cube_pdc_stats(_latest_cells(spark, sf)))


def q_pdc_stats_all_weeks_cube(spark, sf):
    """PDC statistics of all history, merged from the weeks' moments."""
    return round_doubles(O.cube_pdc_stats(_cube(spark, sf)))


def q_pdc_stats_page_cube(spark, sf):
    return round_doubles(O.cube_pdc_stats_table(_latest_cells(spark, sf)))


def q_pdc_histogram_cube(spark, sf):
    return round_doubles(O.cube_histogram(_latest_cells(spark, sf)))


def q_compliance_split_cube(spark, sf):
    return round_doubles(O.cube_compliance_split(_latest_cells(spark, sf)))


def q_compliance_rate_cube(spark, sf):
    return round_doubles(O.cube_compliance_rate(_latest_cells(spark, sf)))


def q_monthly_trend_stored(spark, sf):
    """The trend from the stored cube and bitmaps: no fact row is read."""
    return round_doubles(O.monthly_trend_of(_cube(spark, sf), _members(spark, sf), LOOKBACK_MONTHS, AS_OF))


def q_monthly_trend_stored_filtered(spark, sf):
    return round_doubles(O.monthly_trend_of(_cube(spark, sf), _members(spark, sf), LOOKBACK_MONTHS, AS_OF, FILTER_MEASURES))


def q_distinct_members_all_weeks(spark, sf):
    """Distinct gaps and patients of all history, for each measure."""
    found = O.distinct_members(_members(spark, sf), F.col(MEASURE))
    return found.withColumnRenamed("_k0", MEASURE)


def q_monthly_trend_filtered(spark, sf):
    return round_doubles(_trend(spark, sf, filtered=True))


def q_trend_series(spark, sf):
    return round_doubles(O.trend_series(_trend(spark, sf)))


def q_trend_with_thresholds(spark, sf):
    return round_doubles(O.trend_with_thresholds(_trend(spark, sf)))


def q_star_comparison(spark, sf):
    return round_doubles(O.star_comparison(_trend(spark, sf)))


def _pivot_months(spark, sf) -> list:
    """The pivot's columns, from the cube: at most lookback + 1 labels."""
    return O.pivot_months_of(_cube(spark, sf, since=O.lookback_start(LOOKBACK_MONTHS, AS_OF)), LOOKBACK_MONTHS, AS_OF)


def q_pdc_pivot(spark, sf):
    return round_doubles(O.pdc_pivot(_trend(spark, sf), months=_pivot_months(spark, sf)))


def q_pdc_pivot_text(spark, sf):
    return O.pdc_pivot_text(_trend(spark, sf), months=_pivot_months(spark, sf))


def q_threshold_table(spark, sf):
    since = O.lookback_start(LOOKBACK_MONTHS, AS_OF)
    rows = O.trend_input(_weekly(spark, sf, [WEEK], since=since), LOOKBACK_MONTHS, AS_OF)
    return O.threshold_table(spark, rows)


def q_trend_measures(spark, sf):
    return O.trend_measures(_trend(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_")
}
