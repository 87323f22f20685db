"""Where tables live: a folder of parquet tables, or a relational database."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeworks.operators.joins import not_in
from tapeworks.operators.merge import first_by_key, upsert
from tapeworks.operators.star import DATE_KEY, MEET, new_rows
from tapeworks.schemas import CHANNELS, NATURAL_KEYS, TABLES
from tapeworks.session import path_exists, staged
from tapeworks.sources.files import replace_table
from tapeworks.sources.jdbc import read_jdbc, write_jdbc
from tapeworks.sources.versions import Change, Conflict, Snapshot, Versions
from tapeworks.streaming.jobs import raw_table

MONTH = "trading_month"


BUCKET, BUCKETS = "key_bucket", 64
#: Columns that the folders of keyed tables add.
OWN = f", load string, {BUCKET} int"
#: Tables whose rows are replaced by key, and the key.
KEYED = {"index_list": "index_code", "model_info": "symbol", "model_state": "symbol"}


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias(BUCKET)


class Store(Protocol):
    def read(self, table: str, months: list[int] | None = None) -> DataFrame: ...

    def append(self, table: str, rows: DataFrame) -> int: ...

    def unstored(self, table: str, facts: DataFrame, months: list[int], days: DataFrame) -> DataFrame: ...

    def replace(self, table: str, rows: DataFrame) -> None: ...

    def upsert(self, table: str, batch: DataFrame, sequence: str | None = None) -> int: ...


def month_of(day_key: Column) -> Column:
    """yyyyMM of a date key, or 0 where the date is not in the dimension."""
    return F.coalesce((day_key / 100).cast("int"), F.lit(0))


def counted(rows: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Write rows and return their number, both in one pass."""
    written = Observation()
    write(rows.observe(written, F.count(F.lit(1)).alias("rows")))
    try:
        return written.get["rows"]
    except Py4JJavaError:  # Spark found that there are no rows and dropped the metric with the plan
        return 0


class ParquetStore:
    """Tables as folders under ``root``; fact tables are partitioned by month.

    A month is coarse enough to keep files large. Days are found within it by the row-group
    statistics of the date key, by which the rows are sorted.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] = TABLES):
        self.spark, self.root, self.schemas = spark, root, schemas

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str, months: list[int] | None = None) -> DataFrame:
        """The table, empty before the first write; of a fact table only ``months`` if given."""
        schema = self.schemas[table]
        if table in KEYED:
            return Versions(self.spark, self.path(table)).read(f"{schema}{OWN}").drop("load", BUCKET)
        partitioned = table.startswith("fact_")
        if not path_exists(self.spark, self.path(table)):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, {MONTH} int" if partitioned else schema).parquet(self.path(table))
        if not partitioned:
            return rows
        return (rows if months is None else rows.where(F.col(MONTH).isin(months))).drop(MONTH)

    def unstored(self, table: str, facts: DataFrame, months: list[int], days: DataFrame) -> DataFrame:
        """Facts of ``months`` and ``days`` (date keys) that are not stored yet."""
        return new_rows(facts, self.read(table, months), NATURAL_KEYS[table], days, MEET.get(table, ()))

    def append(self, table: str, rows: DataFrame) -> int:
        """Append and count. Facts are grouped by month into files of even size; the rebalance hint
        lets Spark split a month that holds many rows."""
        path = self.path(table)
        if not table.startswith("fact_"):
            return counted(rows, lambda df: df.write.mode("append").parquet(path))
        return counted(rows, lambda df: (
            df.withColumn(MONTH, month_of(F.col(DATE_KEY)))
            .hint("rebalance", MONTH)
            .sortWithinPartitions(MONTH, DATE_KEY)
            .write.mode("append").partitionBy(MONTH).parquet(path)
        ))

    def replace(self, table: str, rows: DataFrame) -> None:
        if table not in KEYED:
            replace_table(rows, self.path(table))
            return
        versions = Versions(self.spark, self.path(table))
        added = self._write_buckets(versions, table, rows)
        versions.change(lambda now: Change(add=added, drop=now.folders))

    def upsert(self, table: str, batch: DataFrame, sequence: str | None = None) -> int:
        """Replace rows by key, and add those of new keys; returns the number of keys in the batch.

        Rows lie in buckets of their key, and only buckets with a key of the batch are read and written, once, in
        fresh folders that replace the old ones in one version. Of several batch rows of a key the last by ``sequence``
        counts. ``create_time``, where the table has it, stays as it was stored first.
        """
        key, columns = KEYED[table], [f.name for f in StructType.fromDDL(self.schemas[table]).fields]
        versions = Versions(self.spark, self.path(table))
        order = [F.col(sequence).desc_nulls_last()] if sequence else []
        newest = staged(first_by_key(batch, [key], order).select(*columns, _bucket(key)), "upsert")
        touched = {row[0] for row in newest.select(BUCKET).distinct().collect()}  # BUCKETS numbers at most
        if not touched:
            return 0
        while True:
            now = versions.snapshot()
            old = frozenset(f for f in now.folders if int(f.rpartition("=")[2]) in touched)
            stored = versions.read(f"{self.schemas[table]}{OWN}", old).drop("load")
            rows = newest
            if "create_time" in columns:
                known = stored.select(F.col(key).alias("_key"), F.col("create_time").alias("_first"))
                rows = rows.join(known, F.col(key).eqNullSafe(F.col("_key")), "left")
                rows = rows.withColumn("create_time", F.coalesce("_first", "create_time")).drop("_key", "_first")
            merged = not_in(stored, newest, [key]).unionByName(rows)
            added = self._write_buckets(versions, table, merged)

            def swap(latest: Snapshot, old=old, added=added) -> Change:
                # another writer has added rows to these buckets since they were read
                if any(int(f.rpartition("=")[2]) in touched for f in latest.folders - old):
                    raise Conflict(table)
                return Change(add=added, drop=old)

            try:
                versions.change(swap)
                return newest.count()
            except Conflict:
                continue

    def _write_buckets(self, versions: Versions, table: str, rows: DataFrame) -> frozenset[str]:
        dealt = rows.withColumn(BUCKET, _bucket(KEYED[table])).hint("rebalance", BUCKET)
        return versions.write(dealt, f"load={uuid.uuid4().hex}", [BUCKET])

    def export(self, name: str, rows: DataFrame) -> int:
        """Write a CSV folder with a header under ``export`` in place of the last one; returns the rows written."""
        path = f"{self.root}/export/{name}"
        return counted(rows, lambda df: df.write.mode("overwrite").option("header", True).csv(path))


class RawStore(ParquetStore):
    """Raw tables as the ingestion streams write them, one folder per channel; other tables as usual."""

    def read(self, table: str, months: list[int] | None = None) -> DataFrame:
        channel = table.removeprefix("raw_")
        if channel not in CHANNELS:
            return super().read(table, months)
        return raw_table(self.spark, channel, f"{self.root}/{channel}")


class JdbcStore:
    """Tables of a database; ``names`` maps table names to qualified ones where they differ.

    ``writers`` is the number of connections that write a table, by default one per partition.
    ``splits`` gives the split column, bounds and number of range queries for tables that are read
    in parallel: ``{"raw_trade": {"split_by": "trading_date", "bounds": (...), "partitions": 64}}``.
    """

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str],
                 names: dict[str, str] | None = None, splits: dict[str, dict] | None = None,
                 writers: int | None = None):
        self.spark, self.url, self.properties, self.writers = spark, url, properties, writers
        self.names, self.splits = names or {}, splits or {}

    def read(self, table: str, months: list[int] | None = None) -> DataFrame:
        rows = read_jdbc(self.spark, self.url, self.names.get(table, table), self.properties, **self.splits.get(table, {}))
        if not months:
            return rows
        # a plain comparison, which Spark hands to the database
        wanted = F.col(DATE_KEY).isNull()
        for month in sorted(m for m in months if m):
            wanted = wanted | F.col(DATE_KEY).between(month * 100, month * 100 + 99)
        return rows.where(wanted)

    def unstored(self, table: str, facts: DataFrame, months: list[int], days: DataFrame) -> DataFrame:
        return new_rows(facts, self.read(table, months), NATURAL_KEYS[table], days, MEET.get(table, ()))

    def append(self, table: str, rows: DataFrame) -> int:
        name = self.names.get(table, table)
        return counted(rows, lambda df: write_jdbc(df, self.url, name, self.properties, writers=self.writers))

    def replace(self, table: str, rows: DataFrame) -> None:
        kept = staged(rows, "replace")
        write_jdbc(kept, self.url, self.names.get(table, table), self.properties | {"truncate": "true"}, mode="overwrite",
                   writers=self.writers)

    def upsert(self, table: str, batch: DataFrame, sequence: str | None = None) -> int:
        newest = staged(first_by_key(batch, [KEYED[table]], [F.col(sequence).desc_nulls_last()] if sequence else []), "upsert")
        self.replace(table, upsert(self.read(table), newest.withColumn("_sequence", F.lit(0)), KEYED[table], "_sequence"))
        return newest.count()
