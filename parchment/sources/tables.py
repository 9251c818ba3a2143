"""Scans of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table of sf_dir; with columns, only these are read."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df
