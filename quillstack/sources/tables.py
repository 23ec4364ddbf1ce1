"""Table access by folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name` in `folder`; columns and filters chosen later reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
