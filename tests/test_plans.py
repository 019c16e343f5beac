"""Physical-plan checks: no Python UDFs, pruning reaches the scan, broadcasts are bounded."""

import contextlib
import io

import pytest

from pdcspark.plans.catalog import QUERIES
from conftest import SF0001
from pdcspark.plans import catalog as C


def formatted(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def built(spark):
    return {name: fn(spark, SF0001) for name, fn in QUERIES.items()}


def test_no_python_udf_anywhere(built):
    for name, df in built.items():
        text = formatted(df)
        for marker in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                       "MapInPandas"):
            assert marker not in text, (name, marker)


def test_week_queries_prune_partitions(built):
    for name in ("weekly_kpis", "pdc_stats", "market_summary", "weekly_detail", "kpi_change",
                 "compliance_split", "pdc_histogram"):
        text = formatted(built[name])
        line = text.split("PartitionFilters:")[1].split("\n")[0]
        assert "WeekOf" in line and "2001-10-29" in line, (name, line)


def test_trend_prunes_by_lookback(built):
    line = formatted(built["monthly_trend"]).split("PartitionFilters:")[1].split("\n")[0]
    assert "WeekOf" in line and ">=" in line and "2001-02-15" in line


def test_column_pruning_reaches_scan(built):
    text = formatted(built["weekly_kpis"])
    schema = text.split("ReadSchema:")[1].split("\n")[0]
    assert "PDCNbr" not in schema and "NDCDesc" not in schema and "MarketCode" not in schema


def test_star_mode_pushes_ship_range(spark, monkeypatch):
    monkeypatch.setenv("PDCSPARK_SOURCE", "star")
    df = C.QUERIES["weekly_kpis"](spark, SF0001)
    text = formatted(df)
    assert "GreaterThanOrEqual(l_shipdate" in text and "LessThan(l_shipdate" in text
    # Only the tables its columns need: no customer/part scan for KPIs.
    assert "customer.parquet" not in text and "part.parquet" not in text
    assert "orders.parquet" in text


def test_threshold_dimension_is_broadcast(built):
    text = formatted(built["star_comparison"])
    assert "BroadcastHashJoin" in text or "BroadcastExchange" in text


def test_distinct_counts_use_partial_aggregation(built):
    text = formatted(built["monthly_trend"])
    # Two distinct counts: Expand + partial aggregates before any exchange.
    assert "Expand" in text
    assert text.count("HashAggregate") >= 4


def test_kpi_cards_read_both_weeks_in_one_scan(built):
    text = formatted(built["kpi_change"])
    head = text.split("\n\n\n", 1)[0]
    assert head.count("Scan parquet") == 1
    line = text.split("PartitionFilters:")[1].split("\n")[0]
    assert "IN (2001-10-29,2001-10-22)" in line


def test_segment_series_is_one_scan(built):
    head = formatted(built["segment_series"]).split("\n\n\n", 1)[0]
    assert head.count("Scan parquet") == 1
    assert "Expand" in head  # grouping sets over market and payer


def test_star_week_query_gets_runtime_bloom_filter(spark):
    """At scale the orders side of a one-week star query is pre-filtered by a
    runtime bloom filter of that week's order keys (thresholds lowered here)."""
    from pdcspark.sources.star import weekly_from_star_schema

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1k",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = weekly_from_star_schema(spark, "/root/testdata/sf0.01", columns=["WeekOf", "UPID"],
                                     weeks=["2001-10-29"])
        text = formatted(df)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "might_contain" in text and "bloom_filter_agg" in text
