"""Report sink: any Spark writer format (parquet, csv, json, delta if installed...)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite",
                 partition_by=None, **options) -> None:
    """Write one report table.  Reports are small aggregates; the write is distributed anyway."""
    w = df.write.format(format).mode(mode).options(**options)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)
