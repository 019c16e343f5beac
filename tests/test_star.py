"""The star-schema source: join pruning keeps every row; both source modes agree."""

import pytest

from conftest import SF0001, SF001
from pdcspark.plans import catalog as C
from pdcspark.sources.star import weekly_from_star_schema


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01",
                                "/root/testdata/sf0.1"])
def test_foreign_keys_hold(spark, sf):
    """Every join keeps each fact row once."""
    full = weekly_from_star_schema(spark, sf).count()
    lineitem = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert full == lineitem


def test_pruned_columns_same_rows(spark):
    a = weekly_from_star_schema(spark, SF0001, columns=["UGID", "WeekOf"])
    b = weekly_from_star_schema(spark, SF0001).select("UGID", "WeekOf")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("missing", ["part", "customer", "orders", "region"])
def test_rows_do_not_depend_on_the_columns(spark, missing):
    """Half of a dimension is gone: every choice of columns keeps every fact row."""
    from pdcspark.sources.star import STAR_SCHEMAS, weekly_from_tables

    frames = {t: spark.read.schema(s).parquet(f"{SF0001}/{t}.parquet") for t, s in STAR_SCHEMAS.items()}
    key = STAR_SCHEMAS[missing].split()[0]
    frames[missing] = frames[missing].where(f"{key} % 2 = 0")
    n = frames["lineitem"].count()
    for columns in (None, ["WeekOf"], ["UPID"], ["MarketCode", "PDCNbr"], ["NDCDesc"], ["PayerCode", "UGID"]):
        assert weekly_from_tables(columns=columns, **frames).count() == n


def test_week_pushdown_is_exact(spark):
    w = "2001-10-29"
    a = weekly_from_star_schema(spark, SF001, weeks=[w]).where(f"WeekOf = DATE'{w}'")
    b = weekly_from_star_schema(spark, SF001).where(f"WeekOf = DATE'{w}'")
    assert a.count() == b.count() == 157
    since = weekly_from_star_schema(spark, SF001, since="2001-02-15", columns=["WeekOf"])
    full = weekly_from_star_schema(spark, SF001, columns=["WeekOf"]).where(
        "WeekOf >= DATE'2001-02-15'")
    assert since.count() == full.count() == 6114


@pytest.mark.parametrize("name", ["weekly_kpis", "monthly_trend", "market_summary",
                                  "kpi_change", "pdc_pivot"])
def test_source_modes_agree(spark, monkeypatch, name):
    monkeypatch.setenv("PDCSPARK_SOURCE", "table")
    a = C.QUERIES[name](spark, SF0001)
    monkeypatch.setenv("PDCSPARK_SOURCE", "star")
    b = C.QUERIES[name](spark, SF0001)
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_approximate_distinct_opt_in(spark):
    from pdcspark import operators as O

    df = weekly_from_star_schema(spark, SF001, since="2001-02-15")
    exact = {(r.MonthDate, r.MedAdherenceMeasureCode): (r.TotalGaps, r.UniquePatients)
             for r in O.monthly_trend(df, 6, "2001-08-15").collect()}
    approx = {(r.MonthDate, r.MedAdherenceMeasureCode): (r.TotalGaps, r.UniquePatients)
              for r in O.monthly_trend(df, 6, "2001-08-15", exact=False).collect()}
    assert set(exact) == set(approx)
    for k, (g, p) in exact.items():
        ag, ap = approx[k]
        assert abs(ag - g) <= max(2, 0.05 * g) and abs(ap - p) <= max(2, 0.05 * p)


def test_approximate_distinct_opt_in_kpis_and_segments(spark):
    from pdcspark import operators as O

    df = weekly_from_star_schema(spark, SF001, columns=["WeekOf", "UPID", "UGID", "MarketCode",
                                                         "MedAdherenceMeasureCode", "OneFillCode",
                                                         "PDCNbr"])
    exact = O.weekly_kpis(df).first()
    approx = O.weekly_kpis(df, exact=False).first()
    assert approx.TotalGaps == exact.TotalGaps  # only distinct counts are approximate
    assert abs(approx.UniquePatients - exact.UniquePatients) <= 0.05 * exact.UniquePatients
    seg_e = {r.MarketCode: r.UniquePatients for r in O.segment_summary(df, "MarketCode").collect()}
    seg_a = {r.MarketCode: r.UniquePatients
             for r in O.segment_summary(df, "MarketCode", exact=False).collect()}
    assert set(seg_e) == set(seg_a)
    assert all(abs(seg_a[k] - v) <= max(2, 0.05 * v) for k, v in seg_e.items())
