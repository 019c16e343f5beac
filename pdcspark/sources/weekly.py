"""Weekly fact table: read any Spark source, conform it to the declared schema.

A production table should be stored partitioned by ``WeekOf`` (``write_weekly``)
so that week equality and the trend lookback prune partitions at planning time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdcspark.schema import WEEK, WEEKLY_SCHEMA


def conform(df: DataFrame, columns=None) -> DataFrame:
    """Select the declared columns, cast to the declared types.

    A missing column raises (the dashboard silently returned an empty frame and
    failed later).  ``columns`` restricts the projection; pruning then reaches
    the scan's ReadSchema.  NaN in a double column is NULL, as the reference's
    data frames have it.
    """
    wanted = list(columns) if columns else [f.name for f in WEEKLY_SCHEMA.fields]
    types = {f.name: f.dataType for f in WEEKLY_SCHEMA.fields}
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"weekly table lacks columns {missing}; has {df.columns}")
    return df.select(*[_typed(df, c, types.get(c)).alias(c) for c in wanted])


def _typed(df: DataFrame, name: str, kind: T.DataType | None) -> Column:
    column = F.col(name) if kind is None or df.schema[name].dataType == kind else F.col(name).cast(kind)
    return F.nanvl(column, F.lit(None).cast("double")) if kind == T.DoubleType() else column


def load_weekly(spark: SparkSession, path: str | None = None, format: str = "parquet",
                table: str | None = None, columns=None, schema=None, **options) -> DataFrame:
    """Load the weekly fact table from a path (any format) or a catalog table.

    ``schema`` (e.g. ``WEEKLY_SCHEMA`` for a table this package wrote) skips
    schema inference; otherwise the source's own schema is read and cast.
    """
    if table is not None:
        df = spark.read.options(**options).table(table)
    else:
        reader = spark.read.format(format).options(**options)
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.load(path)
    return conform(df, columns)


def write_weekly(df: DataFrame, path: str, mode: str = "overwrite",
                 format: str = "parquet") -> None:
    """Store the fact table partitioned by week (one directory per WeekOf).

    A REBALANCE on WeekOf clusters rows by week so each task writes few files,
    while AQE splits a hot week (say a third of all rows) over several tasks
    and merges small ones; a plain ``repartition(WeekOf)`` would put every
    week on exactly one task.
    """
    (
        df.hint("rebalance", WEEK)
        .write.mode(mode)
        .format(format)
        .partitionBy(WEEK)
        .save(path)
    )
