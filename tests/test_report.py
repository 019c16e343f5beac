"""Report bundles."""

import tempfile

from pyspark.sql import functions as F

from pdcspark import operators as O
from pdcspark.plans.report import (
    dashboard,
    default_measures,
    trend_report,
    weekly_report,
    write_reports,
)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_weekly_report_matches_operators(hand):
    rep = weekly_report(hand, 0, measures=[], markets=["TX", "FL"])
    cur = O.by_codes(O.by_week(hand, "2025-07-07"), "MarketCode", ["TX", "FL"])
    assert same(rep["pdc_stats"], O.pdc_stats_table(cur))
    assert same(rep["pdc_stats_standard"], O.pdc_stats(cur))
    assert same(rep["market_summary"], O.market_summary(cur))
    assert "payer_summary" not in rep
    cards = {r.Metric: r.Current for r in rep["kpi_cards"].collect()}
    assert cards["Total Gaps (UGIDs)"] == 7


def test_trend_report_shares_one_trend(spark, hand):
    rep = trend_report(hand, 6, "2025-07-10")
    assert rep["trend"].count() == 7
    assert same(rep["star_comparison"], O.star_comparison(O.monthly_trend(hand, 6, "2025-07-10")))
    assert rep["pdc_pivot"].count() == 2


def test_dashboard_default_measures(hand):
    codes = default_measures(O.code_table(hand))
    assert codes == ["MAC", "MAD", "MAH", "SUPD"]
    rep = dashboard(hand, as_of="2025-07-10")
    # Selecting every code drops the NULL-measure rows (the page's default).
    assert rep["trend"].where(F.col("MedAdherenceMeasureCode").isNull()).count() == 0
    assert {"kpi_cards", "pdc_pivot_text", "threshold_table", "options"} <= set(rep)


def test_write_reports(spark, hand):
    root = tempfile.mkdtemp(prefix="pdcspark-reports-", dir="/tmp")
    rep = dashboard(hand, markets=["TX"], as_of="2025-07-10")
    names = write_reports(rep, root, format="json")
    assert "detail" in names and "record_count" in names and "kpi_cards" in names and "pdc_pivot_text" in names
    back = spark.read.json(f"{root}/kpi_cards")
    assert back.count() == 4
    pivot = spark.read.json(f"{root}/pdc_pivot_text")
    assert set(pivot.columns) == {"Measure", "Jun 2025", "Jul 2025"}
