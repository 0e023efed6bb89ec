"""Table scans: one Parquet file or folder per table, columns pruned by Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of table ``name``; timestamps without zone become UTC timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    casts = {f.name: F.col(f"`{f.name}`").cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(casts) if casts else df
