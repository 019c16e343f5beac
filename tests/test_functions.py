import datetime as dt

from pyspark.sql import functions as F

from pdcspark.functions import (
    cell_percent,
    fixed_text,
    measure_label,
    month_label,
    percent_text,
    thousands,
    week_number,
    week_start,
)


def test_week_number_matches_sunday_start_rule(spark):
    days = [dt.date(1999, 1, 1) + dt.timedelta(days=i) for i in range(0, 4000, 3)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = {r.d: r.w for r in df.select("d", week_number("d").alias("w")).collect()}
    for d in days:
        assert got[d] == int(d.strftime("%U")), d


def test_week_start_is_monday(spark):
    df = spark.createDataFrame([(dt.datetime(2001, 11, 4, 13, 0),)], "t timestamp_ntz")
    assert df.select(week_start("t")).first()[0] == dt.date(2001, 10, 29)


def test_month_label(spark):
    df = spark.createDataFrame([(dt.date(2025, 6, 23),)], "WeekOf date")
    assert df.select(month_label()).first()[0] == "Jun 2025"


def test_measure_label(spark):
    df = spark.createDataFrame([("MAC",), ("MAD",), ("MAH",), ("SUPD",), (None,)], "m string")
    got = [r[0] for r in df.select(measure_label("m")).collect()]
    assert got == ["MAC (Cholesterol)", "MAD (Diabetes)", "MAH (Hypertension)", "SUPD", None]


def test_text_forms(spark):
    df = spark.createDataFrame([(0.8666666666666667, 1234567, 0.8375), (None, None, None),
                                (0.0115, 0, 0.125)], "x double, n long, y double")
    got = df.select(percent_text("x").alias("p"), thousands("n").alias("t"),
                    fixed_text("y", 2).alias("f"), cell_percent("x").alias("c")).collect()
    assert tuple(got[0]) == ("86.7%", "1,234,567", "0.84", "86.7%")
    assert tuple(got[1]) == (None, None, None, "-")
    assert tuple(got[2]) == ("1.1%", "0", "0.12", "1.1%")  # as Python: below a tie, and a tie to even


def test_whole_percent(spark):
    df = spark.createDataFrame([(0.89,), (0.9,)], "x double")
    assert [r[0] for r in df.select(percent_text(F.col("x"), 0)).collect()] == ["89%", "90%"]


def test_text_equals_python(spark):
    """Every double below 2**52 prints as Python prints it, ties and the sign of zero included."""
    import random

    rnd = random.Random(5)
    xs = [rnd.uniform(-2, 2) for _ in range(1000)] + [round(rnd.uniform(-3, 3), 3) for _ in range(1000)]
    xs += [0.0, -0.0, 0.84949999999999, 0.00049999999999996, -0.0004, 1.15, 12.25, 2.5, 1e15, 5e-324]
    xs += [k / 8 for k in range(-40, 40)] + [k / 1000 for k in range(1000)] + [float("nan"), float("inf")]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", percent_text("x").alias("p1"), percent_text("x", 0).alias("p0"),
        percent_text("x", 1, scale=1).alias("q1"), fixed_text("x", 2).alias("f2"), fixed_text("x", 3).alias("f3"))
    for r in df.collect():
        x = r.x
        assert tuple(r)[1:] == (f"{x:.1%}", f"{x:.0%}", f"{x:.1f}%", f"{x:.2f}", f"{x:.3f}")
