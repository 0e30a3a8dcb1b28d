"""The driver's tables, and written tables that cut a lineage (from the core's helper)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.shared import shared_folder, written

__all__ = ["shared_folder", "table", "written"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
