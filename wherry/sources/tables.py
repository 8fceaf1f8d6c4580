"""Reading the engine's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wherry.session import ship_package


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``, with just ``columns`` if any are given."""
    ship_package(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
