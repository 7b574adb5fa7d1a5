"""The tables of TESTDATA.md, read lazily by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of the data folder; columns are pruned and filters pushed by Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
