"""Derive the weekly adherence table from the TPC-H-style star schema.

The test data has no adherence table, so this builds one (the SQL twin is in
FIXTURES.md and is what the DuckDB oracles embed):

* lineitem gives the dates, gap id, measure, one-fill code and PDC,
* orders gives the patient, customer gives the payer,
* nation -> region gives the market, part gives the drug text.

Scale notes
-----------
* Only the tables the requested ``columns`` need are joined.  Every join is a left
  join on a unique dimension key, so each fact row comes out once whatever the
  columns; attributes of a missing dimension row are NULL.
* No explicit repartition: Spark inserts the join exchanges itself, and
  AQE can then split a hot join key (``weekly_from_tables``).
* Join order: customer attributes are attached to *orders* first (customer and
  orders shuffle on custkey), then lineitem is shuffled once on orderkey for
  patient, market and payer together, not once per dimension.  Only the drug
  text needs a second fact-side shuffle (on partkey, for the part join).
  nation and region are tiny; Spark's size-checked auto-broadcast handles them.
* Week predicates on ``WeekOf`` cannot pass through ``trunc``.  ``weeks`` and
  ``since`` restate them as ranges on the raw ``l_shipdate`` so they reach the
  Parquet scan as PushedFilters (row-group skipping); the exact predicate on
  ``WeekOf`` is still applied by the operators.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pdcspark.functions.calendar import week_start
from pdcspark.schema import (
    DATA_AS_OF,
    DRUG,
    GAP_ID,
    MARKET,
    MEASURE,
    ONE_FILL,
    PATIENT_ID,
    PAYER,
    PDC,
    WEEK,
    WEEKLY_COLUMNS,
    WEEKLY_SCHEMA,
)

# Source column types (pinned: reading with a schema skips footer inference).
STAR_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string",
}

_NEEDS_ORDERS = {PATIENT_ID, MARKET, PAYER}
_NEEDS_CUSTOMER = {MARKET, PAYER}
_NEEDS_REGION = {MARKET}
_NEEDS_PART = {DRUG}


def _as_date(d) -> _dt.date:
    if isinstance(d, _dt.datetime):
        return d.date()
    if isinstance(d, _dt.date):
        return d
    return _dt.date.fromisoformat(d)  # a malformed text raises


def _ts(d: _dt.date) -> Column:
    # From text, so the literal never depends on the Python process time zone.
    return F.lit(f"{d.isoformat()} 00:00:00").cast("timestamp_ntz")


def _ship_predicate(weeks=None, since=None, until=None) -> Column | None:
    """Ranges on l_shipdate equivalent to week predicates on WeekOf."""
    preds = []
    if weeks:
        ranges = None
        for w in sorted({_as_date(w) for w in weeks}):
            r = (F.col("l_shipdate") >= _ts(w)) & (
                F.col("l_shipdate") < _ts(w + _dt.timedelta(days=7))
            )
            ranges = r if ranges is None else (ranges | r)
        preds.append(ranges)
    if since is not None:
        # trunc_week(s) >= D  <=>  s >= first Monday on or after D.
        d = _as_date(since)
        first_monday = d + _dt.timedelta(days=(7 - d.weekday()) % 7)
        preds.append(F.col("l_shipdate") >= _ts(first_monday))
    if until is not None:
        # trunc_week(s) <= D  <=>  s < Monday after the week containing D.
        d = _as_date(until)
        next_monday = d - _dt.timedelta(days=d.weekday()) + _dt.timedelta(days=7)
        preds.append(F.col("l_shipdate") < _ts(next_monday))
    out = None
    for p in preds:
        out = p if out is None else (out & p)
    return out


def weekly_from_star_schema(spark: SparkSession, sf_dir: str, columns=None, weeks=None,
                            since=None, until=None) -> DataFrame:
    """The weekly fact table derived from ``sf_dir``'s parquet tables.

    ``columns``: subset of the fact columns to produce (default all).
    ``weeks``: keep only these WeekOf values; ``since``/``until``: WeekOf bounds
    (inclusive).  All three are pushed to the lineitem scan.
    """
    cols = _check_columns(columns)
    need = set(cols)
    tables = ["lineitem"]
    if need & _NEEDS_ORDERS:
        tables.append("orders")
    if need & _NEEDS_CUSTOMER:
        tables.append("customer")
    if need & _NEEDS_REGION:
        tables += ["nation", "region"]
    if need & _NEEDS_PART:
        tables.append("part")
    frames = {
        t: spark.read.schema(STAR_SCHEMAS[t]).parquet(f"{sf_dir}/{t}.parquet") for t in tables
    }
    pred = _ship_predicate(weeks, since, until)
    if pred is not None:
        frames["lineitem"] = frames["lineitem"].where(pred)
    return weekly_from_tables(columns=cols, **frames)


def _check_columns(columns) -> list:
    cols = list(columns) if columns else list(WEEKLY_COLUMNS)
    unknown = set(cols) - set(WEEKLY_COLUMNS)
    if unknown:
        raise ValueError(f"unknown weekly columns {sorted(unknown)}")
    return cols


def weekly_from_tables(lineitem: DataFrame, orders: DataFrame | None = None,
                       customer: DataFrame | None = None, nation: DataFrame | None = None,
                       region: DataFrame | None = None, part: DataFrame | None = None,
                       columns=None) -> DataFrame:
    """The derivation on DataFrames (any source); only the needed tables are joined.

    The joins are plain equi-joins, so Spark plans the exchanges itself
    (ENSURE_REQUIREMENTS shuffles): that is what lets AQE split a hot
    orderkey, custkey or partkey in a sort-merge join.  No explicit
    repartition is added, since a user-requested shuffle would opt out of that.
    """
    cols = _check_columns(columns)
    need = set(cols)
    fact = lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
    if need & _NEEDS_ORDERS:
        o = orders.select("o_orderkey", "o_custkey")
        if need & _NEEDS_CUSTOMER:
            cust = customer.select("c_custkey", "c_nationkey", "c_mktsegment")
            if need & _NEEDS_REGION:
                n = nation.select("n_nationkey", "n_regionkey")
                r = region.select("r_regionkey", "r_name")
                geo = n.join(r, n.n_regionkey == r.r_regionkey, "left").select(
                    "n_nationkey", "r_regionkey", "r_name"
                )
                cust = cust.join(geo, cust.c_nationkey == geo.n_nationkey, "left").drop(
                    "n_nationkey", "c_nationkey"
                )
            # Customer attributes go onto orders first (orders-sized shuffle on
            # custkey), so the lineitem side is shuffled once, on orderkey.
            o = o.join(cust, o.o_custkey == cust.c_custkey, "left").drop("c_custkey")
        fact = fact.join(o, F.col("l_orderkey") == o.o_orderkey, "left")
    if need & _NEEDS_PART:
        p = part.select("p_partkey", "p_name")
        fact = fact.join(p, F.col("l_partkey") == p.p_partkey, "left")

    ln = F.col("l_linenumber")
    exprs = {
        DATA_AS_OF: F.to_date("l_shipdate"),
        WEEK: week_start("l_shipdate"),
        GAP_ID: F.concat(
            F.lit("G"), F.col("l_orderkey").cast("string"), F.lit("-"), ln.cast("string")
        ),
        PATIENT_ID: F.concat(F.lit("P"), F.col("o_custkey").cast("string")),
        MEASURE: F.when(ln <= 2, "MAC")
        .when(ln <= 4, "MAH")
        .when(ln <= 6, "MAD")
        .when(F.col("l_tax") > 0.01, "SUPD"),
        MARKET: F.when(
            (F.col("r_regionkey") == 4) & (F.col("l_tax") == 0.0), F.lit(None).cast("string")
        ).otherwise(F.col("r_name")),
        PAYER: F.when(F.col("l_discount") == 0.0, F.lit(None).cast("string")).otherwise(
            F.col("c_mktsegment")
        ),
        ONE_FILL: F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "Yes")
        .when((F.col("l_returnflag") == "R") & (F.col("l_quantity") <= 10), "No"),
        PDC: F.when(F.col("l_quantity") > 3, (F.lit(50) + F.col("l_quantity")) / F.lit(100)),
        DRUG: F.col("p_name"),
    }
    types = {f.name: f.dataType for f in WEEKLY_SCHEMA.fields}
    return fact.select(*[exprs[c].cast(types[c]).alias(c) for c in cols])
