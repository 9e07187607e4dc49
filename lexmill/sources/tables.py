"""Parquet table access. A table is `<folder>/<name>.parquet`, a file or a folder of part files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The named table; Spark prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
