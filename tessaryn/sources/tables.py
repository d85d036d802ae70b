"""Tables of a data folder: one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def existing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pruned to those of ``cols`` that are there, in that order (IO6)."""
    return df.select(*[c for c in cols if c in df.columns])
