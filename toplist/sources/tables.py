"""Readers for the parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """``<data_dir>/<name>.parquet`` as a lazy scan (columns pruned by the caller)."""
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
