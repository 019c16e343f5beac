"""Measure display labels as a plain CASE expression (no join, stays in codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pdcspark.schema import MEASURE, MEASURE_LABELS


def measure_label(c=MEASURE) -> Column:
    """Label of a measure code; unknown codes label as themselves."""
    code = F.col(c) if isinstance(c, str) else c
    expr = None
    for k, v in MEASURE_LABELS.items():
        expr = (F.when if expr is None else expr.when)(code == F.lit(k), F.lit(v))
    return expr.otherwise(code)
