"""What several operators need: tables in the shared folder, clash-free names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.sources.ranges import free_name, ranged, ranked
from lattica.sources.stored import remove, remove_table, work_dir, written

__all__ = ["bounded_batches", "free_name", "ranged", "ranked", "remove", "remove_table", "table", "work_dir", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Has texts go to Python in batches of at most so many rows and 8 MB, which bounds a worker's and Arrow's buffers.

    A smaller setting of the session stays. The settings are not put back, as plans are made when results are read.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
