"""Relational tables over JDBC, read and written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_options(
    url: str,
    table: str,
    properties: dict[str, str],
    split_by: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 16,
) -> dict[str, str]:
    """Options of a scan. With ``split_by`` (a number, date or timestamp column) and its bounds the
    scan runs as ``partitions`` range queries; rows outside the bounds fall in the end ranges."""
    options = {"url": url, "dbtable": table, "fetchsize": "10000", **properties}
    if split_by:
        low, high = bounds
        options.update(
            partitionColumn=split_by, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)
        )
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str], **split) -> DataFrame:
    """Filters and column choices made on the result are pushed to the database by Spark."""
    return spark.read.format("jdbc").options(**read_options(url, table, properties, **split)).load()


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    properties: dict[str, str],
    mode: str = "append",
    writers: int | None = None,
    spread_by: str | None = None,
    batch_rows: int = 500,
    isolation: str = "NONE",
) -> None:
    """Write with ``writers`` connections, by default one for each partition of ``df``.

    Rows are dealt out evenly, or by hash of ``spread_by`` where one writer per key is wanted; an
    even deal keeps a busy key from loading a single connection.
    """
    dealt = df
    if spread_by:
        dealt = df.repartition(writers, spread_by) if writers else df.repartition(spread_by)
    elif writers:
        dealt = df.repartition(writers)
    (
        dealt.write.format("jdbc").mode(mode)
        .options(url=url, dbtable=table, batchsize=str(batch_rows), isolationLevel=isolation, **properties)
        .save()
    )
