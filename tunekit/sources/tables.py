"""Parquet tables as rows of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as it lies; how its files are cut into tasks is left to Spark."""
    return spark.read.parquet(path)
