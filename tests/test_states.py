"""Stored states of the weekly table: the cube, KPI rows, codes and member bitmaps."""

import contextlib
import datetime as dt
import io
import statistics
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from pdcspark import operators as O
from pdcspark import session
from pdcspark.functions.moments import mean_of, merged, moments, sample_std_of
from pdcspark.operators import members as D
from pdcspark.plans import materialize as M
from pdcspark.plans import states as S
from pdcspark.plans.catalog import QUERIES
from pdcspark.plans.report import weekly_report
from pdcspark.sources.star import weekly_from_star_schema

AS_OF = "2025-07-10"


def folder():
    return tempfile.mkdtemp(prefix="pdcspark-test-", dir="/tmp") + "/t"


def loaded(spark, rows, members=False):
    table = f"states_{uuid.uuid4().hex[:8]}"
    M.load_weeks(rows, table, path=folder())
    if members:
        S.keep_members(spark, table)
    return table


def rounded(df):
    kinds = dict(df.dtypes)
    return sorted(
        (tuple((c, round(r[c], 9) if kinds[c] == "double" and r[c] is not None else r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def states_match(spark, table):
    """Every stored state equals what the fact rows give."""
    facts = spark.table(table)
    assert S.committed(spark, table)
    assert rounded(S.kpis(spark, table)) == rounded(O.kpis_by_week(facts))
    assert rounded(S.cells(spark, table)) == rounded(O.weekly_cube(facts))
    assert rounded(S.codes(spark, table)) == rounded(O.code_table(facts).select("Kind", "Value", "WeekOf"))
    if S.keeps_members(spark, table):
        found = O.distinct_members(S.members(spark, table), F.col("WeekOf"), F.col("MedAdherenceMeasureCode"))
        rows = facts.groupBy("WeekOf", "MedAdherenceMeasureCode").agg(F.count_distinct("UGID").alias("g"), F.count_distinct("UPID").alias("p"))
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(str(tuple(r)) for r in rows.collect() if r.g or r.p)


# ------------------------------------------------------------------ moments


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_moments_merge(spark, parts):
    values = [0.1 * (i % 13) + 1e6 for i in range(40)] + [None, None]
    rows = spark.createDataFrame([(i % parts, v) for i, v in enumerate(values)], "part int, v double")
    merged_ = rows.groupBy("part").agg(moments(F.col("v")).alias("m")).agg(merged(F.col("m")).alias("m"))
    r = merged_.select(F.col("m.n"), mean_of(F.col("m")).alias("mean"), sample_std_of(F.col("m")).alias("std")).first()
    real = [v for v in values if v is not None]
    assert r.n == 40 and r["mean"] == pytest.approx(statistics.fmean(real), abs=1e-8)
    assert r["std"] == pytest.approx(statistics.stdev(real), abs=1e-8)


def test_moments_of_few_rows(spark):
    for values, expected in (([None], (0, None, None)), ([0.5, None], (1, 0.5, None)), ([0.5, 0.5], (2, 0.5, 0.0))):
        rows = spark.createDataFrame([(v,) for v in values], "v double")
        m = rows.agg(moments(F.col("v")).alias("m")).agg(merged(F.col("m")).alias("m"))
        assert tuple(m.select("m.n", mean_of(F.col("m")), sample_std_of(F.col("m"))).first()) == expected


# --------------------------------------------------------------------- cube


def test_tables_of_the_cube_equal_those_of_the_rows(spark, hand):
    star = weekly_from_star_schema(spark, SF0001)
    beyond = star.withColumn("PDCNbr", (F.col("PDCNbr") - 0.6) * 3)
    for rows in (hand, O.by_week(hand, "2025-07-07"), O.by_week(hand, "1990-01-01"), star, beyond):
        cube = O.weekly_cube(rows)
        for cell, row in ((O.cube_distribution, O.measure_distribution), (O.cube_pdc_stats, O.pdc_stats),
                          (O.cube_pdc_stats_table, O.pdc_stats_table), (O.cube_histogram, O.pdc_histogram),
                          (O.cube_compliance_split, O.compliance_split), (O.cube_compliance_rate, O.compliance_rate)):
            assert rounded(cell(cube)) == rounded(row(rows)), cell.__name__
        counts = O.weekly_kpis(rows).drop("UniquePatients")
        assert rounded(O.cube_counts(cube)) == rounded(counts)


def test_cube_of_other_cut_offs(hand):
    cube = O.weekly_cube(hand, threshold=0.9, bins=10)
    assert rounded(O.cube_compliance_split(cube)) == rounded(O.compliance_split(hand, 0.9))
    assert rounded(O.cube_histogram(cube, 10)) == rounded(O.pdc_histogram(hand, 10))


def test_bundle_scans_the_week_once(spark):
    """The measure and PDC tables of a bundle have no fact scan left: they read the shared cube."""
    rep = weekly_report(M.weekly_table(spark, SF0001), 0)
    for name in ("record_count", "measure_distribution", "measure_counts_text", "pdc_stats", "pdc_stats_standard",
                 "pdc_histogram", "compliance_split", "compliance_rate", "compliance_rate_text"):
        assert "Scan parquet" not in plan(rep[name]), name
    week = O.by_codes(O.by_week(M.weekly_table(spark, SF0001), M.weekly_table_weeks(spark, SF0001)[-1]),
                      "MedAdherenceMeasureCode", ["MAC", "MAD", "MAH", "SUPD"])
    assert rounded(rep["pdc_histogram"]) == rounded(O.pdc_histogram(week))


# ------------------------------------------------------------- kept by loads


def test_states_after_a_full_load(spark, hand):
    states_match(spark, loaded(spark, hand, members=True))


def test_corrected_and_emptied_weeks(spark, hand):
    """A load replaces its weeks' states; a week without rows has none any more; other weeks keep theirs."""
    table = loaded(spark, hand, members=True)
    weeks = M.week_list(spark, table)
    corrected, emptied = weeks[-1], weeks[-2]
    fixed = hand.where(F.col("WeekOf") == F.lit(corrected)).withColumn("PDCNbr", F.lit(0.5)).withColumn("UPID", F.lit("new patient"))
    M.load_weeks(fixed, table, weeks=[corrected, emptied])
    states_match(spark, table)
    assert M.week_list(spark, table) == [w for w in weeks if w != emptied]
    kpis = {r.WeekOf: r for r in S.kpis(spark, table).collect()}
    assert emptied not in kpis and kpis[corrected].UniquePatients == 1
    assert S.members(spark, table).where(F.col("WeekOf") == F.lit(emptied)).isEmpty()
    M.load_weeks(hand, table, weeks=[corrected, emptied])  # and back
    states_match(spark, table)
    assert M.week_list(spark, table) == weeks
    new = hand.where(F.col("WeekOf") == F.lit(corrected)).withColumn("WeekOf", F.lit("2030-01-07").cast("date"))
    M.load_weeks(new, table, weeks=[dt.date(2030, 1, 7)])  # a week that wasn't there
    states_match(spark, table)
    assert M.week_list(spark, table)[-1] == dt.date(2030, 1, 7)


@pytest.mark.parametrize("members", [False, True])
def test_a_load_that_breaks_off(spark, hand, monkeypatch, members):
    """Killed between the fact rows and the states: readers see the fact rows, and the next load mends all."""
    table = loaded(spark, hand, members)
    week = M.week_list(spark, table)[-1]
    fixed = hand.where(F.col("WeekOf") == F.lit(week)).limit(1)

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(S, "refresh", killed)
        with pytest.raises(KeyboardInterrupt):
            M.load_weeks(fixed, table, weeks=[week])
    assert S.committed(spark, table) is None
    facts = spark.table(table)
    assert facts.where(F.col("WeekOf") == F.lit(week)).count() == 1
    assert rounded(S.kpis(spark, table)) == rounded(O.kpis_by_week(facts))
    assert rounded(S.codes(spark, table)) == rounded(O.code_table(facts).select("Kind", "Value", "WeekOf"))
    if members:
        found = O.distinct_members(S.members(spark, table), F.col("WeekOf"))
        assert {r[0]: r.TotalGaps for r in found.collect()}[week] == 1
    other = M.week_list(spark, table)[0]
    M.load_weeks(hand, table, weeks=[other])  # of another week than the one that broke off
    states_match(spark, table)


def test_a_load_killed_before_its_fact_rows(spark, hand, monkeypatch):
    table = loaded(spark, hand)

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(M, "_write_weeks", killed)
        with pytest.raises(KeyboardInterrupt):
            M.load_weeks(hand, table, weeks=M.week_list(spark, table)[:1])
    assert S.committed(spark, table) is None
    assert rounded(S.kpis(spark, table)) == rounded(O.kpis_by_week(spark.table(table)))
    M.load_weeks(hand, table)
    states_match(spark, table)


def test_a_load_leaves_the_session_alone(spark, hand):
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    table = loaded(spark, hand)
    M.load_weeks(hand, table, weeks=M.week_list(spark, table)[:1])
    assert spark.conf.get(setting) == before


def test_small_states_are_one_file_and_old_versions_go(spark):
    M.weekly_table(spark, SF0001)
    table = M.table_name(SF0001)
    for state in (S.kpis, S.cells, S.codes):
        assert len(state(spark, table).inputFiles()) == 1
    first = S.committed(spark, table)
    last = M.weekly_table_weeks(spark, SF0001)[-1:]
    M.load_star_weeks(spark, SF0001, last)
    held = S.kpis(spark, table)  # a reader of this version
    M.load_star_weeks(spark, SF0001, last)
    assert held.count() == S.kpis(spark, table).count()
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(S._folder(spark, table, first))
    assert not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)


def test_all_weeks_queries_read_no_fact_row(spark):
    for name in ("kpis_by_week", "kpi_change_all_weeks", "kpi_change_stored", "monthly_trend_stored", "pdc_stats_all_weeks_cube"):
        text = plan(QUERIES[name](spark, SF0001))
        scans = [line for line in text.split("\n") if line.startswith("Location:")]
        assert scans and all("_states/" in s or "_members" in s for s in scans), (name, scans)


# -------------------------------------------------------------------- members


def test_trend_of_states_equals_trend_of_rows(spark, hand):
    table = loaded(spark, hand, members=True)
    facts, cells, bits = spark.table(table), S.cells(spark, table), S.members(spark, table)
    for months in (1, 6, 24):
        for measures in (None, ["MAC", "MAD"]):
            got = O.monthly_trend_of(cells, bits, months, AS_OF, measures)
            assert got.columns == O.monthly_trend(facts, months, AS_OF, measures).columns
            assert rounded(got) == rounded(O.monthly_trend(facts, months, AS_OF, measures)), (months, measures)


def test_numbers_are_dense_and_stay(spark, hand):
    table = loaded(spark, hand, members=True)

    def numbers():
        rows = spark.read.parquet(S._ids_folder(spark, table)).collect()
        assert sorted(r.Number for r in rows) == list(range(1, len(rows) + 1))
        assert len({(r.Kind, r.Id) for r in rows}) == len(rows)
        return {(r.Kind, r.Id): r.Number for r in rows}

    before = numbers()
    week = M.week_list(spark, table)[-1]
    more = hand.where(F.col("WeekOf") == F.lit(week)).withColumn("UGID", F.concat(F.lit("new-"), F.coalesce("UGID", F.lit("x"))))
    M.load_weeks(more, table, weeks=[week])
    after = numbers()
    assert {k: after[k] for k in before} == before and len(after) > len(before)
    states_match(spark, table)


def test_a_hot_patient_and_a_hot_week(spark):
    """A patient with over a third of all rows and a week with as many: one member for each week and measure."""
    star = weekly_from_star_schema(spark, SF0001)
    hot = star.where("WeekOf = DATE'2001-10-29'").crossJoin(spark.range(800)).drop("id")
    rows = star.unionByName(hot).withColumn("UPID", F.when(F.rand(1) < 0.4, F.lit("P-hot")).otherwise(F.col("UPID"))).checkpoint()
    table = loaded(spark, rows, members=True)
    states_match(spark, table)
    got = O.monthly_trend_of(S.cells(spark, table), S.members(spark, table), 6, "2001-08-15")
    assert rounded(got) == rounded(O.monthly_trend(rows, 6, "2001-08-15"))
    assert S.members(spark, table).where("WeekOf = DATE'2001-10-29'").count() <= 4 * 2 * 2


def test_bitmaps_are_made_after_the_shuffle(spark):
    """No bitmap is moved: those of a task alone would be nearly empty, as many as tasks times buckets."""
    members = spark.createDataFrame([(dt.date(2025, 7, 7), "MAC", "gap", f"G{i}") for i in range(50)], D.FOUND_SCHEMA)
    ids = spark.createDataFrame([("gap", f"G{i}", 32_700 + 3 * i) for i in range(50)], D.IDS_SCHEMA)
    made = D.member_bitmaps(members, ids)
    # Between the two halves of the aggregate there is no exchange, only in front of both.
    text = made._jdf.queryExecution().executedPlan().toString()
    halves = text.split("partial_bitmap_construct_agg")[0]
    assert "bitmap_construct_agg" in halves and "Exchange" not in halves
    got = {r.Bucket: sum(b.bit_count() for b in r.Bits) for r in made.collect()}
    numbers = [32_700 + 3 * i for i in range(50)]
    assert got == {b: sum((n - 1) // 32_768 + 1 == b for n in numbers) for b in (1, 2)}


def test_a_load_sizes_its_shuffles_by_its_input(spark, hand, monkeypatch):
    """More input means more shuffle partitions, not larger tasks; afterwards the session is as before."""
    settings = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    before, seen = [spark.conf.get(s) for s in settings], []
    path = folder()
    hand.write.parquet(path)
    rows = spark.read.schema(hand.schema).parquet(path)
    size = session.stored_bytes(spark, rows.inputFiles())
    assert 0 < size <= session.stored_bytes(spark, [path])
    monkeypatch.setattr(session, "LOAD_PARTITION_BYTES", size // 100)
    refresh = S.refresh

    def watched(*args):
        seen.append([spark.conf.get(s) for s in settings])
        return refresh(*args)

    monkeypatch.setattr(S, "refresh", watched)
    table = loaded(spark, rows, members=True)
    assert int(seen[0][0]) >= 100 and all(int(s) <= session.LOAD_TASK_BYTES for s in seen[0][1:])
    assert [spark.conf.get(s) for s in settings] == before
    monkeypatch.undo()
    states_match(spark, table)
