"""Mergeable states of the weekly table, kept by its loads.

``kpis``   one KPI row per week (rows, distinct patients, measures, one-fills)
``cells``  the weekly cube: counts and PDC moments by measure, class and bin
``codes``  the codes of each week, for the pickers
``members`` bitmaps of each week's numbered gap and patient ids (on request)

The first three have a few hundred rows for each week, whatever the fact table's
size; a load writes a new version of them: the version before without the loaded
weeks, and those weeks' states from the fact rows just written.  The bitmaps grow
with the ids, so they are partitioned by week and only the loaded weeks' are
written; ids that are new get the next numbers.

A load marks the table with its id when it begins (``pdcspark.loading``) and when
all is written (``pdcspark.loaded``).  A stored state is read only while both are
the same; otherwise the same rows are derived from the fact table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdcspark.operators import cube as C
from pdcspark.operators import members as D
from pdcspark.operators.kpi import CARD_COLUMNS, kpis_by_week
from pdcspark.operators.options import code_table
from pdcspark.schema import STANDARD_MEASURES, WEEK
from pdcspark.session import sized_shuffles, stored_bytes

LOADING, LOADED, BEFORE, MEMBERS = "pdcspark.loading", "pdcspark.loaded", "pdcspark.before", "pdcspark.members"

KPIS_SCHEMA = T.StructType(
    [T.StructField(WEEK, T.DateType(), True)]
    + [T.StructField(c, T.LongType(), True) for c in (*CARD_COLUMNS[:2], *(f"{m}Count" for m in STANDARD_MEASURES), *CARD_COLUMNS[2:])]
)
CODES_SCHEMA = T.StructType([T.StructField("Kind", T.StringType(), True), T.StructField("Value", T.StringType(), True), T.StructField(WEEK, T.DateType(), True)])

#: Name, schema and derivation of the states that a load writes anew.
SMALL: dict[str, tuple[T.StructType, Callable[[DataFrame], DataFrame]]] = {
    "kpis": (KPIS_SCHEMA, kpis_by_week),
    "cells": (C.CUBE_SCHEMA, C.weekly_cube),
    "codes": (CODES_SCHEMA, code_table),
}


# --------------------------------------------------------------- table marks


def _properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def _set(spark: SparkSession, table: str, **marks: str) -> None:
    pairs = ", ".join(f"'pdcspark.{k}' = '{v}'" for k, v in marks.items())
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")


def location(spark: SparkSession, table: str) -> str:
    """The folder of a catalog table."""
    found = {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    return found["Location"].rstrip("/")


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def begin(spark: SparkSession, table: str) -> str:
    """Mark the table as being loaded, and return the load's id.

    If the load before broke off, its states' version is given up with the mark.
    """
    load = uuid.uuid4().hex[:12]
    if committed(spark, table) is None:
        spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES IF EXISTS ('{LOADED}')")
    _set(spark, table, loading=load)
    return load


def committed(spark: SparkSession, table: str) -> str | None:
    """The load whose states stand for the fact rows; None during a load or after one that broke off."""
    marks = _properties(spark, table)
    return marks[LOADED] if LOADED in marks and marks[LOADED] == marks.get(LOADING) else None


# ---------------------------------------------------------------- the states


def _folder(spark: SparkSession, table: str, load: str) -> str:
    return f"{location(spark, table)}_states/{load}"


def _of_weeks(rows: DataFrame, weeks) -> DataFrame:
    return rows if weeks is None else rows.where(F.col(WEEK).isin([F.lit(w) for w in weeks]))


def refresh(spark: SparkSession, table: str, load: str, weeks=None) -> None:
    """Write the states of ``weeks`` (None: all) from the fact rows, and commit the load.

    Where the load before has not been committed, which weeks it changed isn't
    known, so all are written.
    """
    marks = _properties(spark, table)
    before = marks.get(LOADED)
    if before is None:
        weeks = None
    facts = _of_weeks(spark.table(table), weeks)
    for name, (schema, derive) in SMALL.items():
        rows = derive(facts).select(*schema.names)
        if weeks is not None:
            old = spark.read.schema(schema).parquet(f"{_folder(spark, table, before)}/{name}")
            others = F.col(WEEK).isNull() | ~F.col(WEEK).isin([F.lit(w) for w in weeks])
            rows = old.where(others).unionByName(rows)
        # A rebalance without keys merges a small result into one file.
        rows.hint("rebalance").sortWithinPartitions(WEEK).write.parquet(f"{_folder(spark, table, load)}/{name}")
    if keeps_members(spark, table):
        _write_members(spark, table, weeks)
    stale = marks.get(BEFORE)
    _set(spark, table, loaded=load, before=before or "")
    if stale:  # readers may still hold the version before, but not the one before that
        drop_folder(spark, _folder(spark, table, stale))


def _stored(spark: SparkSession, table: str, name: str) -> DataFrame:
    schema, derive = SMALL[name]
    load = committed(spark, table)
    if load is None:
        return derive(spark.table(table)).select(*schema.names)
    return spark.read.schema(schema).parquet(f"{_folder(spark, table, load)}/{name}")


def kpis(spark: SparkSession, table: str) -> DataFrame:
    return _stored(spark, table, "kpis")


def cells(spark: SparkSession, table: str) -> DataFrame:
    return _stored(spark, table, "cells")


def codes(spark: SparkSession, table: str) -> DataFrame:
    return _stored(spark, table, "codes")


# ------------------------------------------------------------------- members


def _ids_folder(spark: SparkSession, table: str) -> str:
    return f"{location(spark, table)}_ids"


def _members_folder(spark: SparkSession, table: str) -> str:
    return f"{location(spark, table)}_members"


def keeps_members(spark: SparkSession, table: str) -> bool:
    return _properties(spark, table).get(MEMBERS) == "kept"


def keep_members(spark: SparkSession, table: str) -> None:
    """Number the ids of the table and store its bitmaps, if that hasn't been done; from now on loads keep them."""
    if not keeps_members(spark, table):
        _write_members(spark, table, None)
        _set(spark, table, members="kept")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _read_or_none(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], schema)


def _write_members(spark: SparkSession, table: str, weeks) -> None:
    """Number what is new in ``weeks`` and write their bitmaps; a week without ids has none.

    Its shuffles have partitions by the size of the table and of the numbers kept so far.
    """
    sources = [location(spark, table), _ids_folder(spark, table)]
    with sized_shuffles(spark, stored_bytes(spark, [s for s in sources if _exists(spark, s)])):
        _number_and_write(spark, table, weeks)


def _number_and_write(spark: SparkSession, table: str, weeks) -> None:
    ids_folder, folder = _ids_folder(spark, table), _members_folder(spark, table)
    scratch = f"{folder}_load/{uuid.uuid4().hex[:12]}"
    D.member_ids(_of_weeks(spark.table(table), weeks)).write.parquet(f"{scratch}/members")
    found = spark.read.schema(D.FOUND_SCHEMA).parquet(f"{scratch}/members")
    known = _read_or_none(spark, ids_folder, D.IDS_SCHEMA)
    last = known.agg(F.max("Number")).first()[0] or 0
    D.placed(D.unnumbered(found, known)).write.parquet(f"{scratch}/new")
    new = spark.read.schema("Kind string, Id string, Place long").parquet(f"{scratch}/new")
    D.numbered(new, last).write.mode("append").parquet(ids_folder)
    ids = spark.read.schema(D.IDS_SCHEMA).parquet(ids_folder)
    bitmaps = D.member_bitmaps(found, ids).hint("rebalance", WEEK).write.mode("overwrite")
    if weeks is not None:
        bitmaps = bitmaps.option("partitionOverwriteMode", "dynamic")
        for week in weeks:  # those that have no ids any more aren't overwritten
            drop_folder(spark, f"{folder}/{WEEK}={week.isoformat()}")
    bitmaps.partitionBy(WEEK).parquet(folder)
    drop_folder(spark, scratch)


def members(spark: SparkSession, table: str) -> DataFrame:
    """The bitmaps of each week, which must be kept; after a load that broke off they are made anew."""
    if committed(spark, table) is None:
        _write_members(spark, table, None)
    return spark.read.schema(D.MEMBERS_SCHEMA).parquet(_members_folder(spark, table))
