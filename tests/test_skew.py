"""Hot keys: one week (and one patient) holding over a third of all rows.

The skewed table is derived from the given sf0.01 tables: the latest week's
rows are repeated, so the results on it are known exactly.
"""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from pdcspark import operators as O
from pdcspark.sources.star import weekly_from_star_schema
from pdcspark.sources.weekly import load_weekly, write_weekly

COPIES = 200
HOT = "2001-10-29"


@pytest.fixture(scope="module")
def skewed(spark):
    base = weekly_from_star_schema(spark, SF001)
    hot = base.where(F.col("WeekOf") == F.lit(HOT).cast("date"))
    # Repeat the hot week COPIES more times.
    extra = hot.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).drop("copy")
    return base.unionByName(extra).cache()


def test_hot_week_holds_a_third(skewed):
    total = skewed.count()
    hot = skewed.where(F.col("WeekOf") == F.lit(HOT).cast("date")).count()
    assert hot == 157 * (COPIES + 1)
    assert hot > total / 3


def test_kpis_exact_on_hot_week(spark, skewed):
    plain = O.weekly_kpis(O.by_week(weekly_from_star_schema(spark, SF001), HOT)).first()
    hot = O.weekly_kpis(O.by_week(skewed, HOT)).first()
    factor = COPIES + 1
    assert hot.TotalGaps == plain.TotalGaps * factor
    assert hot.UniquePatients == plain.UniquePatients  # distinct, not summed
    assert hot.MACCount == plain.MACCount * factor
    assert hot.OneFillCount == plain.OneFillCount * factor


def test_trend_distinct_counts_unchanged_by_copies(spark, skewed):
    a = O.monthly_trend(weekly_from_star_schema(spark, SF001), 6, "2001-08-15")
    b = O.monthly_trend(skewed, 6, "2001-08-15")
    # Distinct gaps and patients ignore the copies (AvgPDC, a row mean, does not).
    cols = ["MonthDate", "MedAdherenceMeasureCode", "TotalGaps", "UniquePatients"]
    a, b = a.select(*cols), b.select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hot_patient(skewed, spark):
    hot_patient = skewed.withColumn(
        "UPID", F.when(F.col("UGID").endswith("-1"), F.lit("P1")).otherwise(F.col("UPID")))
    seg = {r.MarketCode: r.UniquePatients
           for r in O.market_summary(O.by_week(hot_patient, HOT)).collect()}
    brute = (O.by_week(hot_patient, HOT).where(F.col("MarketCode").isNotNull())
             .select("MarketCode", "UPID").distinct().groupBy("MarketCode").count().collect())
    assert seg == {r.MarketCode: r["count"] for r in brute}


def test_rebalanced_write_splits_the_hot_week(spark, skewed):
    out = tempfile.mkdtemp(prefix="pdcspark-skew-", dir="/tmp") + "/weekly"
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        write_weekly(skewed, out)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    hot_files = [f for f in os.listdir(f"{out}/WeekOf={HOT}") if f.endswith(".parquet")]
    assert len(hot_files) > 1  # AQE split the hot week over several tasks
    back = load_weekly(spark, out)
    assert back.count() == skewed.count()
    assert O.weekly_kpis(O.by_week(back, HOT)).first().TotalGaps == 157 * (COPIES + 1)


def test_hot_join_key_is_split_by_aqe(spark):
    """A third of lineitem on one orderkey: the sort-merge join is skew-split.

    Broadcasts are disabled and the skew thresholds lowered so that the
    small test tables exercise the plan a cluster would run.
    """
    import contextlib
    import io

    from pdcspark.sources.star import STAR_SCHEMAS, weekly_from_tables

    def read(t):
        return spark.read.schema(STAR_SCHEMAS[t]).parquet(f"{SF001}/{t}.parquet")

    li = read("lineitem")
    hot = li.select(F.min("l_orderkey")).first()[0]
    # Every third row moves to the hot order (keys stay valid: the order exists).
    # Staged as 8 files: AQE splits a skewed partition along map outputs, and the
    # given lineitem file is a single row group (one mapper), unlike real tables.
    staged = tempfile.mkdtemp(prefix="pdcspark-hotkey-", dir="/tmp") + "/lineitem"
    (li.withColumn(
        "l_orderkey",
        F.when(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(3)) == 0, F.lit(hot))
        .otherwise(F.col("l_orderkey")))
     .repartition(8).write.parquet(staged))
    skewed_li = spark.read.schema(STAR_SCHEMAS["lineitem"]).parquet(staged)
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = weekly_from_tables(skewed_li, read("orders"), columns=["UGID", "UPID"])
        rows = df.collect()  # run on this DataFrame so explain shows AQE's final plan
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        plan = buf.getvalue()
        assert len(rows) == li.count()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert "isFinalPlan=true" in plan
    assert "SortMergeJoin" in plan
    assert "skew=true" in plan
