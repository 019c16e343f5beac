"""The weekly fact table as a catalog table, loaded week by week.

The dashboard queries a warehouse table.  Here it is a Parquet table of the
session's catalog, partitioned by ``WeekOf``, beside states that the load keeps
for it (``plans.states``): the KPI row of each week, the weekly cube and the
codes of each week.  A load is explicit: ``load_weeks`` writes the partitions of
the weeks it is given and no others, drops those that have no rows any more, and
replaces those weeks' states, so queries after a load see it.  Between loads the
table stays as it was loaded, like any warehouse table.

* A load names its weeks, so a late file costs its own weeks, not all history.
* A load is marked on the table before its first write and committed by one
  change of the table's properties after its last.  States count only while the
  two marks agree: after a load that broke off, readers derive what they need
  from the fact rows, until a load has run to its end.
* The write is a REBALANCE on WeekOf: AQE splits a hot week into several tasks
  and files and merges small ones.  Which weeks had rows is observed by the write.
* The week list comes from the catalog's partitions, one entry for each week;
  no file is listed or opened for it.
* The shuffles of a load have partitions by the size of its input, so a task's
  share, its memory and its spill don't grow with the data.
* Tables live under the shared ``spark.checkpoint.dir`` (a scratch folder only
  where a local session names none), in a folder of the application; a metastore
  keeps tables that are given a name and a path of their own.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import threading

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pdcspark.plans import states
from pdcspark.schema import WEEK
from pdcspark.session import sized_shuffles, storage_root, stored_bytes
from pdcspark.sources.star import weekly_from_star_schema
from pdcspark.sources.weekly import conform

_FIRST_LOAD = threading.Lock()  # two threads must not both make the table


def table_name(sf_dir: str) -> str:
    return f"weekly_{hashlib.md5(sf_dir.rstrip('/').encode()).hexdigest()[:12]}"


def _write_all(rows: DataFrame, table: str, path: str | None) -> None:
    writer = rows.hint("rebalance", WEEK).write.mode("overwrite").format("parquet").partitionBy(WEEK)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def _write_weeks(rows: DataFrame, table: str, weeks: list[dt.date]) -> None:
    """Replace the partitions of ``weeks``; a week without rows goes."""
    spark = rows.sparkSession
    columns = [c for c in spark.table(table).columns if c != WEEK] + [WEEK]
    seen = Observation()
    rows = rows.select(*columns).observe(seen, F.collect_set(F.col(WEEK).cast("string")).alias("weeks"))
    # Overwrites the partitions that the rows have, whatever the session's overwrite mode is.
    writer = rows.hint("rebalance", WEEK).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(WEEK).parquet(states.location(spark, table))
    written = set(seen.get["weeks"])  # at most the weeks that were asked for
    for week in map(dt.date.isoformat, weeks):
        change = "ADD IF NOT EXISTS" if week in written else "DROP IF EXISTS"
        spark.sql(f"ALTER TABLE {table} {change} PARTITION ({WEEK} = DATE '{week}')")
        if week not in written:
            states.drop_folder(spark, f"{states.location(spark, table)}/{WEEK}={week}")
    spark.catalog.refreshTable(table)


def load_weeks(rows: DataFrame, table: str, weeks=None, path: str | None = None) -> DataFrame:
    """Load ``rows`` into the catalog table and return it.

    ``weeks`` (dates) names the weeks that ``rows`` replaces: other rows are left
    out, and a named week without rows goes.  Without it the table is made anew,
    at ``path`` where one is given.  Repeating a load changes nothing.  One load
    of a table runs at a time; one that broke off is mended by the next load of
    its weeks.
    """
    spark = rows.sparkSession
    rows = conform(rows)
    with sized_shuffles(spark, stored_bytes(spark, rows.inputFiles())):
        if weeks is None:
            kept = spark.catalog.tableExists(table) and states.keeps_members(spark, table)
            _write_all(rows, table, path)  # the new table has no marks
            load = states.begin(spark, table)
            if kept:
                states.keep_members(spark, table)
        else:
            weeks = sorted(set(weeks))
            load = states.begin(spark, table)
            _write_weeks(rows.where(F.col(WEEK).isin([F.lit(w) for w in weeks])), table, weeks)
        states.refresh(spark, table, load, weeks)
    return spark.table(table)


def load_star_weeks(spark: SparkSession, sf_dir: str, weeks=None) -> DataFrame:
    """Load the weekly table of ``sf_dir`` from its star schema: ``weeks``, or all."""
    table = table_name(sf_dir)
    if weeks is not None and not spark.catalog.tableExists(table):
        raise ValueError("load all weeks before single ones")
    rows = weekly_from_star_schema(spark, sf_dir, weeks=weeks)
    path = f"{storage_root(spark)}/pdcspark-weekly/{spark.sparkContext.applicationId}/{table}"
    return load_weeks(rows, table, weeks, path)


def weekly_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly table of ``sf_dir`` as it was loaded last; the first use in a session loads it."""
    table = table_name(sf_dir)
    with _FIRST_LOAD:
        if not spark.catalog.tableExists(table):
            load_star_weeks(spark, sf_dir)
    return spark.table(table)


def weekly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Kind, Value, WeekOf): the codes that each week of the table has."""
    weekly_table(spark, sf_dir)
    return states.codes(spark, table_name(sf_dir))


def weekly_kpi_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The KPI row of each week of the table."""
    weekly_table(spark, sf_dir)
    return states.kpis(spark, table_name(sf_dir))


def weekly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly cube of the table."""
    weekly_table(spark, sf_dir)
    return states.cells(spark, table_name(sf_dir))


def weekly_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member bitmaps of each week of the table; the first use numbers its ids, later loads keep them."""
    weekly_table(spark, sf_dir)
    with _FIRST_LOAD:
        states.keep_members(spark, table_name(sf_dir))
        return states.members(spark, table_name(sf_dir))


def week_list(spark: SparkSession, table: str) -> list[dt.date]:
    """The weeks of a loaded table in order, from its partitions."""
    found = (r[0].partition("=")[2] for r in spark.sql(f"SHOW PARTITIONS {table}").collect())
    return sorted(dt.date.fromisoformat(w) for w in found if w[:1].isdigit())


def weekly_table_weeks(spark: SparkSession, sf_dir: str) -> list[dt.date]:
    weekly_table(spark, sf_dir)
    return week_list(spark, table_name(sf_dir))
