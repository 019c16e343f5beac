"""Printed tables and report orders."""

import pytest
from pyspark.sql import functions as F

from pdcspark import operators as O
from pdcspark.plans.report import weekly_report


@pytest.fixture(scope="module")
def report(hand):
    return weekly_report(hand, 0, measures=[], markets=["TX", "FL"])


def as_key(value):
    return (value is not None, value)


@pytest.mark.parametrize("order,rows", [
    ("detail", lambda h: O.week_detail(h)), ("trend", lambda h: O.monthly_trend(h, 6, "2025-07-10")),
    ("series", lambda h: O.trend_series(O.monthly_trend(h, 6, "2025-07-10"))),
    ("counts", lambda h: O.measure_distribution(h)), ("measures", lambda h: O.pdc_stats(h)),
    ("markets", lambda h: O.market_summary(h)), ("payers", lambda h: O.payer_summary(h)), ("options", lambda h: O.filter_options(h))])
def test_ordered_output_follows_the_declared_keys(hand, order, rows):
    """What a reader collects is in the order that the ranked form gives places for."""
    got = O.ordered(O.ranked(rows(hand), order), order).collect()
    assert [r.Place for r in got] == sorted(r.Place for r in got) and got
    keys = O.ORDERS[order]
    for a, b in zip(got, got[1:]):
        for column, down in keys:
            x, y = as_key(a[column]), as_key(b[column])
            if x != y:
                assert (x > y) if down else (x < y), (order, column)
                break


def test_helpers_use_the_declared_orders(hand):
    stats, trend = O.pdc_stats(hand), O.monthly_trend(hand, 6, "2025-07-10")
    pairs = [(O.order_measures(stats), O.ordered(stats, "measures")), (O.order_trend(trend), O.ordered(trend, "trend")),
             (O.order_counts(O.measure_distribution(hand)), O.ordered(O.measure_distribution(hand), "counts")),
             (O.order_segments(O.payer_summary(hand)), O.ordered(O.payer_summary(hand), "payers")),
             (O.order_segments(O.market_summary(hand)), O.ordered(O.market_summary(hand), "markets"))]
    for a, b in pairs:
        assert a.collect() == b.collect()


def test_texts_are_in_the_order_of_their_tables(report):
    assert [r.Measure for r in report["measure_counts_text"].collect()] == [r.Measure for r in report["measure_distribution"].collect()]
    assert [r.Measure for r in report["measure_shares_text"].collect()] == [r.Measure for r in report["measure_distribution"].collect()]
    assert [r.Measure for r in report["pdc_stats_text"].collect()] == [r.Measure for r in report["pdc_stats"].collect()]
    assert [r.MarketCode for r in report["market_text"].collect()] == [r.MarketCode for r in report["market_summary"].collect()]
    assert [r.Card for r in report["kpi_cards_text"].collect()] == [0, 1, 2, 3]


def test_texts_are_those_of_python(report):
    cards = {r.Card: r for r in report["kpi_cards"].collect()}
    for r in report["kpi_cards_text"].collect():
        assert (r.CurrentText, r.ChangeText) == (f"{cards[r.Card].Current:,}", f"{cards[r.Card].PercentChange:.1f}%")
    stats = {r.MedAdherenceMeasureCode: r for r in report["pdc_stats"].collect()}
    for r in report["pdc_stats_text"].collect():
        s = stats[r.MedAdherenceMeasureCode]
        std = None if s.StdPDC is None else f"{s.StdPDC:.3f}"
        assert (r.CountText, r.AvgText, r.StdText, r.ComplianceText) == (f"{s.Count:,}", f"{s.AvgPDC:.2f}", std, f"{s.ComplianceRate:.1%}")
    shares = [f"{r.Percent:.1f}%" for r in report["measure_distribution"].collect()]
    assert [r.Percent for r in report["measure_shares_text"].collect()] == shares
    assert report["record_count_text"].first().Records == f"{report['record_count'].first().TotalGaps:,}"


def test_nothing_is_printed_of_an_empty_week(hand):
    none = O.by_week(hand, "1990-01-01")
    cube = O.weekly_cube(none)
    assert O.record_count_text(O.cube_counts(cube)).isEmpty()
    assert O.share_text(O.cube_distribution(cube), "Measure").isEmpty()
    assert O.share_text(O.cube_compliance_split(cube), "Status").isEmpty()


def test_a_tie_prints_alike_however_it_was_summed(spark):
    """Means that differ in their last bits around a tie have one text."""
    rows = spark.createDataFrame([("a", 1, 1, 1, 0.125), ("b", 1, 1, 1, 0.125 + 2**-53), ("c", 1, 1, 1, 0.125 - 2**-54)],
                                 "MarketCode string, TotalGaps long, UniquePatients long, OneFillCount long, AvgPDC double")
    assert {r.AvgPDC for r in O.segment_text(rows, "MarketCode").collect()} == {"0.12"}


def test_segment_summaries_equal_single_ones(hand):
    both = O.segment_summaries(hand)
    for column, own in (("MarketCode", O.market_summary(hand)), ("PayerCode", O.payer_summary(hand))):
        got = both.where(F.col("Segment") == column).select(F.col("Code").alias(column), *own.columns[1:])
        assert got.exceptAll(own).isEmpty() and own.exceptAll(got).isEmpty()
    series = O.series_of_summaries(both)
    assert series.exceptAll(O.segment_series(hand)).isEmpty() and O.segment_series(hand).exceptAll(series).isEmpty()


def test_pivot_is_lazy_and_its_months_are_given(hand):
    trend, cube = O.monthly_trend(hand, 6, "2025-07-10"), O.weekly_cube(hand)
    months = O.pivot_months_of(cube, 6, "2025-07-10")
    assert months == O.pivot_months(trend) == ["Jun 2025", "Jul 2025"]
    assert sorted(O.pdc_pivot(trend, months=months).collect()) == sorted(O.pdc_pivot(trend).collect())
    none = O.pdc_pivot_text(trend.where("false"))
    assert none.columns == ["Measure"] and none.isEmpty()
