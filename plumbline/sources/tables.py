"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder; the schema comes from the files' footers, and
    filters and columns asked for later reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
