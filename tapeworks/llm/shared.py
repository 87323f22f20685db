"""Helpers of the operators: tables, fresh column names, keys of labelled rows, counts of executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are cut at ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: str | Column) -> Column:
    """0, 1 or 2 from the CRC-32 of the id as text; 1 is held out of training. A null id has none."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(column.cast("string").cast("binary")) % 3


def training_labels(labels: DataFrame, id_column: str, label: str) -> DataFrame:
    """Ids and labels (0 or 1) that may be learned from; one row for each id, disagreeing ids dropped."""
    return (
        labels.where((fold(id_column) != 1) & F.col(label).isin(0, 1))
        .groupBy(id_column)
        .agg(F.min(label).alias("label"), F.max(label).alias("_most"))
        .where(F.col("label") == F.col("_most"))
        .select(F.col(id_column).alias("_id"), F.col("label").cast("int").alias("label"))
    )


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = "_" + name
    return name
