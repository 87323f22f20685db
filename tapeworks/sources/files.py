"""Parquet, CSV and landed JSON pages. Schemas are always declared."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.session import scratch_path


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a scan that has fewer splits than the session has cores.

    A file of one row group is read by a single task, which would then do all the work up to the
    next shuffle. Scans of many splits are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite the table at ``path`` with rows that may be derived from it.

    The rows are first written beside it, so that the files being read are not the ones replaced.
    """
    spark = df.sparkSession
    beside = scratch_path(spark, "replace")
    df.write.parquet(beside)
    spark.read.schema(df.schema).parquet(beside).write.mode("overwrite").parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header whose order may differ from the declared columns."""
    return spark.read.schema(schema).options(header=True, enforceSchema=False).csv(path)


def write_csv(df: DataFrame, prefix: str, now: datetime | None = None) -> str:
    """CSV folder with a header, named by prefix and time; returns its path."""
    path = f"{prefix}_{(now or datetime.now()):%Y%m%d_%H%M%S}"
    df.write.option("header", True).csv(path)
    return path


def read_landed_pages(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """Rows of all response pages landed as JSON lines under ``path/market=.../``.

    A page without rows contributes nothing.
    """
    pages = spark.read.schema(f"data array<struct<{row_schema}>>, market string").json(path)
    return pages.select("market", F.explode("data").alias("_row")).select("market", "_row.*")
