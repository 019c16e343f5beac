"""Expected values of the 14-row hand fixture (FIXTURES.md section 3)."""

import datetime as dt

import pytest

from pdcspark import operators as O

W = "2025-07-07"
D = dt.date


def rows(df, key=None):
    out = [r.asDict() for r in df.collect()]
    return sorted(out, key=key) if key else out


def approx(x):
    return pytest.approx(x, abs=1e-6)


def test_available_weeks(hand):
    got = [(r["WeekOf"], r["WeekNumber"], r["Year"]) for r in O.available_weeks(hand).collect()]
    assert got == [
        (D(2025, 7, 7), 27, 2025), (D(2025, 6, 23), 25, 2025), (D(2025, 6, 9), 23, 2025),
        (D(2025, 6, 2), 22, 2025), (D(2025, 1, 6), 1, 2025),
    ]


def test_available_weeks_limit(hand):
    assert O.available_weeks(hand, 2).count() == 2


def test_previous_week_positions(hand):
    pos = {r["Position"]: (r["WeekOf"], r["PreviousWeekOf"])
           for r in O.week_positions(O.available_weeks(hand)).collect()}
    assert pos[0] == (D(2025, 7, 7), D(2025, 6, 23))
    assert pos[4] == (D(2025, 1, 6), D(2025, 1, 6))  # oldest compares with itself
    assert O.select_week(hand, 1) == (D(2025, 6, 23), D(2025, 6, 9))


def test_week_labels(hand):
    r = O.week_labels(O.available_weeks(hand, 1)).first()
    assert r["WeekLabel"] == "Week 27, 2025 (Week of Jul 07, 2025)"
    assert r["WeekText"] == "2025-07-07"


def test_weekly_kpis(hand):
    r = O.weekly_kpis(O.by_week(hand, W)).first()
    assert (r.TotalGaps, r.UniquePatients, r.OneFillCount, r.DenominatorGapCount,
            r.MACCount, r.MAHCount, r.MADCount) == (8, 5, 1, 6, 4, 1, 1)
    r = O.weekly_kpis(O.by_week(hand, "2025-06-23")).first()
    assert (r.TotalGaps, r.UniquePatients, r.OneFillCount, r.DenominatorGapCount,
            r.MACCount, r.MAHCount, r.MADCount) == (2, 1, 1, 1, 1, 1, 0)


def test_empty_week_is_zeros(hand):
    r = O.weekly_kpis(O.by_week(hand, "2030-01-07")).first()
    assert all(v == 0 for v in r.asDict().values())


def test_kpi_change(hand):
    got = {r.Metric: (r.Current, r.Previous, r.PercentChange)
           for r in O.kpi_change(hand, W, "2025-06-23").collect()}
    assert got["Total Gaps (UGIDs)"] == (8, 2, 300.0)
    assert got["Unique Patients (UPIDs)"] == (5, 1, 400.0)
    assert got["One-Fill Gaps"] == (1, 1, 0.0)
    assert got["Denominator Gaps"] == (6, 1, 500.0)


def test_kpi_change_zero_rules(spark):
    from pyspark.sql import functions as F

    from pdcspark.functions.numeric import percent_change

    df = spark.createDataFrame([(3, 0), (0, 0), (5, 4), (1, None)], "c long, p long")
    got = [r[0] for r in df.select(percent_change(F.col("c"), F.col("p"))).collect()]
    assert got == [100.0, 0.0, 25.0, None]


def test_kpi_change_all_weeks(hand):
    got = {(r.WeekOf, r.Card): (r.Current, r.Previous, r.PercentChange)
           for r in O.kpi_change_all_weeks(hand).collect()}
    assert got[(D(2025, 7, 7), 0)] == (8, 2, 300.0)
    assert got[(D(2025, 1, 6), 0)] == (1, None, None)
    assert len(got) == 5 * 4  # NULL week excluded


def test_measure_distribution(hand):
    got = {r.MedAdherenceMeasureCode: (r.Measure, r.Count, r.Percent)
           for r in O.measure_distribution(O.by_week(hand, W)).collect()}
    assert got["MAC"] == ("MAC (Cholesterol)", 4, approx(57.142857))
    for code in ("MAD", "MAH", "SUPD"):
        assert got[code][1] == 1 and got[code][2] == approx(14.285714)
    assert got["SUPD"][0] == "SUPD"
    order = [r.MedAdherenceMeasureCode for r in O.measure_distribution(O.by_week(hand, W)).collect()]
    assert order[0] == "MAC"


def test_measure_distribution_complete(hand):
    df = O.by_codes(O.by_week(hand, W), "MedAdherenceMeasureCode", ["MAC"])
    got = {r.MedAdherenceMeasureCode: (r.Count, r.Percent)
           for r in O.measure_distribution_complete(df).collect()}
    assert got == {"MAC": (4, 100.0), "MAH": (0, 0.0), "MAD": (0, 0.0)}
    empty = O.by_week(hand, "2030-01-07")
    got = {r.MedAdherenceMeasureCode: (r.Count, r.Percent)
           for r in O.measure_distribution_complete(empty).collect()}
    assert got == {"MAC": (0, None), "MAH": (0, None), "MAD": (0, None)}


def test_pdc_stats(hand):
    got = {r.MedAdherenceMeasureCode: r for r in O.pdc_stats(O.by_week(hand, W)).collect()}
    assert set(got) == {"MAC", "MAH", "MAD"}  # SUPD has no eligible rows
    mac = got["MAC"]
    assert (mac.Count, mac.AvgPDC, mac.StdPDC, mac.ComplianceRate) == (
        3, approx(0.866667), approx(0.115470), 1.0)
    mah = got["MAH"]
    assert (mah.Count, mah.AvgPDC, mah.StdPDC, mah.ComplianceRate) == (1, approx(0.79), None, 0.0)
    mad = got["MAD"]
    assert (mad.Count, mad.AvgPDC, mad.StdPDC, mad.ComplianceRate) == (0, 0.0, 0.0, 0.0)


def test_compliance_split(hand):
    got = {r.Status: (r.Count, r.Percent) for r in O.compliance_split(O.by_week(hand, W)).collect()}
    assert got == {"Compliant (PDC ≥ 80%)": (4, 80.0), "Non-Compliant (PDC < 80%)": (1, 20.0)}
    assert O.compliance_rate(O.by_week(hand, W)).first()[0] == approx(0.8)


def test_pdc_histogram(hand):
    got = {(r.MedAdherenceMeasureCode, r.Bin): (r.Count, r.Percent)
           for r in O.pdc_histogram(O.by_week(hand, W)).collect()}
    assert got == {("MAC", 16): (2, approx(66.666667)), ("MAC", 19): (1, approx(33.333333)),
                   ("MAH", 15): (1, 100.0)}


def test_histogram_bin_edges(spark):
    from pdcspark.operators.pdc import histogram_bin

    vals = [0.0, 0.15, 0.3, 0.35, 0.6, 0.7, 0.95, 0.999, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "PDCNbr double")
    got = [r[0] for r in df.select(histogram_bin()).collect()]
    assert got == [0, 3, 6, 7, 12, 14, 19, 19, 19]


def test_segments(hand):
    m = {r.MarketCode: (r.TotalGaps, r.UniquePatients, r.OneFillCount, r.AvgPDC)
         for r in O.market_summary(O.by_week(hand, W)).collect()}
    assert m == {"FL": (3, 3, 1, approx(0.8375)), "TX": (3, 1, 0, approx(0.796667))}
    p = {r.PayerCode: (r.TotalGaps, r.UniquePatients, r.OneFillCount, r.AvgPDC)
         for r in O.payer_summary(O.by_week(hand, W)).collect()}
    assert p == {"AET": (4, 3, 1, approx(0.85)), "HUM": (2, 2, 0, approx(0.896667))}


def test_segment_series(hand):
    got = {(r.Series, r.Key): r.Value for r in O.segment_series(O.by_week(hand, W)).collect()}
    assert got[("market_gaps", "FL")] == 3.0
    assert got[("market_pdc", "TX")] == approx(0.796667)
    assert got[("payer_gaps", "HUM")] == 2.0
    assert len(got) == 6


TREND = {
    ("Jun 2025", "MAC"): (2, 2, 0, 0.775, 0.5),
    ("Jun 2025", "MAH"): (1, 1, 1, 0.9, 1.0),
    ("Jul 2025", None): (1, 0, 0, 0.9, 1.0),
    ("Jul 2025", "MAC"): (2, 3, 1, 0.866667, 1.0),
    ("Jul 2025", "MAD"): (1, 1, 0, None, None),
    ("Jul 2025", "MAH"): (1, 1, 0, 0.79, 0.0),
    ("Jul 2025", "SUPD"): (1, 1, 0, None, None),
}


@pytest.fixture(scope="module")
def trend(hand):
    return O.monthly_trend(hand, 6, "2025-07-10").cache()


def test_monthly_trend(trend):
    got = {}
    for r in trend.collect():
        got[(r.MonthLabel, r.MedAdherenceMeasureCode)] = (
            r.TotalGaps, r.UniquePatients, r.OneFillCount, r.AvgPDC, r.ComplianceRate)
    assert set(got) == set(TREND)
    for k, v in TREND.items():
        g = got[k]
        assert g[:3] == v[:3]
        for a, b in zip(g[3:], v[3:]):
            assert (a is None and b is None) or a == approx(b)


def test_lookback_excludes_old_and_null_weeks(hand):
    df = O.lookback(hand, 6, "2025-07-10")
    assert df.where("UGID IN ('G8', 'G9')").count() == 0
    assert df.count() == 12


def test_lookback_month_end_clamp(spark):
    from pdcspark.operators.filters import lookback_start

    assert lookback_start(6, "2025-08-31") == D(2025, 2, 28)
    r = spark.sql("SELECT add_months(DATE'2025-08-31', -6) AS d").first()
    assert r.d == D(2025, 2, 28)


def test_star_comparison(trend):
    got = {}
    for r in O.star_comparison(trend).collect():
        got.setdefault(r.MedAdherenceMeasureCode, set()).add((r.Stars, r.Threshold))
        cur = got.setdefault(("cur", r.MedAdherenceMeasureCode), (r.Current, r.FirstMonth))
        assert cur == (r.Current, r.FirstMonth)
    assert got[("cur", "MAC")][0] == approx(0.820833)
    assert got[("cur", "MAH")][0] == approx(0.845)
    assert got[("cur", "MAD")] == (None, "Jul 2025")
    assert got[("cur", "SUPD")] == (None, "Jul 2025")
    assert got[("cur", "MAC")][1] == "Jun 2025"
    assert got["MAC"] == {(3, 0.89), (4, 0.91), (5, 0.93)}
    assert got["SUPD"] == {(None, None)}


def test_trend_with_thresholds(trend):
    df = O.trend_with_thresholds(trend)
    assert df.where("MedAdherenceMeasureCode = 'SUPD'").count() == 0
    # 2 MAC months + 2 MAH months + 1 MAD month, 3 levels each
    assert df.count() == 5 * 3


def test_trend_series(trend):
    got = [(r.MedAdherenceMeasureCode, r.Metric, r.MonthLabel)
           for r in O.order_series(O.trend_series(trend)).collect()]
    assert ("MAC", "AvgPDC", "Jun 2025") == got[0]
    assert all(m is not None for m, _, _ in got)
    assert len(got) == 6 * 2


def test_pdc_pivot(trend):
    got = {r.MedAdherenceMeasureCode: (r["Jun 2025"], r["Jul 2025"])
           for r in O.pdc_pivot(trend).collect()}
    assert set(got) == {"MAC", "MAH"}
    assert got["MAC"] == (approx(0.775), approx(0.866667))
    assert got["MAH"] == (approx(0.9), approx(0.79))
    assert O.pdc_pivot(trend).columns == ["MedAdherenceMeasureCode", "Jun 2025", "Jul 2025"]
    text = {r.Measure: (r["Jun 2025"], r["Jul 2025"]) for r in O.pdc_pivot_text(trend).collect()}
    assert text == {"MAC (Cholesterol)": ("77.5%", "86.7%"),
                    "MAH (Hypertension)": ("90.0%", "79.0%")}


def test_threshold_table(spark, trend, hand):
    got = {r.Measure: (r["3-Star"], r["4-Star"], r["5-Star"])
           for r in O.threshold_table(spark, trend).collect()}
    assert got == {"MAC (Cholesterol)": ("89%", "91%", "93%"),
                   "MAH (Hypertension)": ("88%", "91%", "93%"),
                   "MAD (Diabetes)": ("86%", "90%", "92%")}
    assert O.threshold_table(spark, O.trend_input(hand, 6, "2040-01-01")).count() == 0
    assert O.threshold_table(spark, O.trend_input(hand, 6, "2025-07-10")).count() == 3


def test_trend_measures(trend):
    got = {r.MedAdherenceMeasureCode: r.NumMonths for r in O.trend_measures(trend).collect()}
    assert got == {"MAC": 2, "MAH": 2, "MAD": 2, "SUPD": 2, None: 2}


def test_filter_options(hand):
    got = {}
    for r in O.filter_options(hand).collect():
        got.setdefault(r.Kind, set()).add(r.Value)
    assert got["measure"] == {"MAC", "MAH", "MAD", "SUPD"}
    assert got["market"] == {"TX", "FL"}
    assert got["payer"] == {"AET", "HUM"}
    assert len(got["week"]) == 5
    assert sorted(r[0] for r in O.distinct_values(hand, "MarketCode").collect()) == ["FL", "TX"]
    codes = O.code_table(hand)
    assert {r[0] for r in O.distinct_codes(codes, "market").collect()} == {"FL", "TX"}
    assert [tuple(r) for r in O.order_options(O.options_from_codes(codes)).collect()][0] == ("market", "FL")


def test_filters_empty_list_is_identity(hand):
    assert O.by_codes(hand, "MarketCode", []).count() == hand.count()
    assert O.by_codes(hand, "MarketCode", None).count() == hand.count()
    # Selecting every code drops the NULL-code rows.
    assert O.by_codes(hand, "MarketCode", ["TX", "FL"]).count() == hand.count() - 1


def test_report_orderings(trend, hand):
    got = [(r.Year, r.Month, r.MedAdherenceMeasureCode) for r in O.order_trend(trend).collect()]
    assert got == [(2025, 6, "MAC"), (2025, 6, "MAH"), (2025, 7, None), (2025, 7, "MAC"),
                   (2025, 7, "MAD"), (2025, 7, "MAH"), (2025, 7, "SUPD")]
    series = [(r.MedAdherenceMeasureCode, r.Metric, r.MonthDate)
              for r in O.order_series(O.trend_series(trend)).collect()]
    assert series == sorted(series)
    keys = [r.MarketCode for r in O.order_segments(O.market_summary(O.by_week(hand, W))).collect()]
    assert keys == sorted(keys)
    codes = [r.MedAdherenceMeasureCode for r in O.order_measures(O.pdc_stats(O.by_week(hand, W))).collect()]
    detail = [r.WeekOf for r in O.order_detail(O.week_detail(hand)).collect()]
    assert detail[:-1] == sorted(detail[:-1], reverse=True) and detail[-1] is None
    assert codes == sorted(codes)
    weeks = [r.WeekOf for r in O.available_weeks(hand).collect()]
    assert weeks == sorted(weeks, reverse=True)


def test_week_detail(hand):
    d = O.week_detail(hand, W, measures=["MAC"])
    assert d.columns[:4] == ["DataAsOfDate", "WeekOf", "WeekNumber", "Year"]
    assert d.count() == 4
    assert {r.WeekNumber for r in d.collect()} == {27}
    assert O.week_detail(hand).count() == 14


def test_pdc_stats_table_page_rows(hand):
    got = {r.MedAdherenceMeasureCode: (r.Count, r.AvgPDC, r.StdPDC, r.ComplianceRate)
           for r in O.pdc_stats_table(O.by_week(hand, W)).collect()}
    # Observed codes only (SUPD observed, no eligible rows -> zeros).
    assert set(got) == {"MAC", "MAH", "MAD", "SUPD"}
    assert got["SUPD"] == (0, 0.0, 0.0, 0.0)
    assert got["MAH"][0] == 1 and got["MAH"][2] is None
    empty = {r.MedAdherenceMeasureCode: r.Count
             for r in O.pdc_stats_table(O.by_week(hand, "2030-01-07")).collect()}
    assert empty == {"MAC": 0, "MAH": 0, "MAD": 0}
    only_mac = O.by_codes(O.by_week(hand, W), "MedAdherenceMeasureCode", ["MAC"])
    assert [r[0] for r in O.pdc_stats_table(only_mac).select("MedAdherenceMeasureCode").collect()] == ["MAC"]


def test_measure_distribution_fallback(hand):
    empty = {r.MedAdherenceMeasureCode: (r.Count, r.Percent)
             for r in O.measure_distribution(O.by_week(hand, "2030-01-07")).collect()}
    assert empty == {"MAC": (0, None), "MAH": (0, None), "MAD": (0, None)}
    assert O.measure_distribution(O.by_week(hand, "2030-01-07"), fallback=False).count() == 0
    assert O.measure_distribution(O.by_week(hand, W)).count() == 4


def test_lookback_start_uses_session_date(spark):
    from pyspark.sql import functions as F

    from pdcspark.operators.filters import lookback_start

    today = spark.range(1).select(F.current_date()).first()[0]
    m = today.month - 1 - 6
    y, m = today.year + m // 12, m % 12 + 1
    got = lookback_start(6, spark=spark)
    assert (got.year, got.month) == (y, m) and got.day <= today.day
