"""Constant dimensions built from the fixed values in ``schema``.

Both are tiny and of fixed size (3 and 12 rows), so broadcasting them is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pdcspark.schema import (
    MEASURE_LABEL_SCHEMA,
    MEASURE_LABELS,
    STAR_THRESHOLD_SCHEMA,
    STAR_THRESHOLDS,
)


def measure_labels(spark: SparkSession) -> DataFrame:
    rows = [(k, v) for k, v in MEASURE_LABELS.items()]
    return F.broadcast(spark.createDataFrame(rows, MEASURE_LABEL_SCHEMA))


def star_thresholds(spark: SparkSession, levels=None) -> DataFrame:
    """Long form: one row per (measure, star level)."""
    rows = [
        (m, int(s), float(t))
        for m, by_level in STAR_THRESHOLDS.items()
        for s, t in by_level.items()
        if levels is None or s in levels
    ]
    return F.broadcast(spark.createDataFrame(rows, STAR_THRESHOLD_SCHEMA))
