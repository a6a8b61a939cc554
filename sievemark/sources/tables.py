"""Tables of a folder: one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table `name`, projected to `columns` if any, so that the scan reads only those."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
