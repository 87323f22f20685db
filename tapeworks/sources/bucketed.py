"""Fact tables in buckets of their natural key, so that a load moves only the rows of its batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeworks.operators.joins import all_same
from tapeworks.operators.star import DATE_KEY
from tapeworks.schemas import NATURAL_KEYS, TABLES
from tapeworks.session import file_system, path_exists
from tapeworks.sources.stores import MONTH, ParquetStore, counted, month_of

KEY_HASH = "natural_hash"


def _key_hash(table: str) -> Column:
    return F.xxhash64(*NATURAL_KEYS[table]).alias(KEY_HASH)


class BucketedStore(ParquetStore):
    """A store whose facts are tables of the catalog ``database``: partitioned by month, and by a hash of the
    natural key into ``buckets``. Other tables are as in ``ParquetStore``.

    The number of buckets is part of the folder's name: files of another number would be read as the wrong buckets.
    A session whose catalog does not know a table that is there finds it by its folder, with the number it has.
    """

    def __init__(self, spark: SparkSession, root: str, database: str, buckets: int = 256,
                 schemas: dict[str, str] = TABLES):
        super().__init__(spark, root, schemas)
        self.database, self.buckets = database, buckets

    def _opened(self, table: str) -> str:
        """The table's name in the catalog, which it enters where it is missing."""
        name = f"`{self.database}`.`{table}`"
        if self.spark.catalog.tableExists(name):
            return name
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}`")
        files, pattern = file_system(self.spark, f"{self.path(table)}_in_*")
        there = [f.getPath().getName() for f in files.globStatus(pattern) or []]
        if len(there) > 1:
            raise ValueError(f"{self.path(table)}: folders of several numbers of buckets")
        folder = there[0] if there else f"{table}_in_{self.buckets}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromDDL(self.schemas[table]).fields)
        location = f"{self.root}/{folder}".replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {KEY_HASH} bigint, {MONTH} int) USING parquet"
            f" PARTITIONED BY ({MONTH}) CLUSTERED BY ({KEY_HASH}) SORTED BY ({KEY_HASH})"
            f" INTO {int(folder.rpartition('_')[2])} BUCKETS LOCATION '{location}'"
        )
        if path_exists(self.spark, f"{self.root}/{folder}"):
            self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return name

    def _stored(self, table: str, months: list[int] | None) -> DataFrame:
        rows = self.spark.table(self._opened(table))
        return rows if months is None else rows.where(F.col(MONTH).isin(months))

    def read(self, table: str, months: list[int] | None = None) -> DataFrame:
        if not table.startswith("fact_"):
            return super().read(table, months)
        return self._stored(table, months).drop(MONTH, KEY_HASH)

    def append(self, table: str, rows: DataFrame) -> int:
        """Append and count. Rows go to the tasks of their buckets, one file for each month and bucket."""
        if not table.startswith("fact_"):
            return super().append(table, rows)
        name = self._opened(table)
        buckets = int(self.spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()[1])
        keyed = rows if KEY_HASH in rows.columns else rows.withColumn(KEY_HASH, _key_hash(table))
        keyed = keyed.withColumn(MONTH, month_of(F.col(DATE_KEY)))
        return counted(keyed, lambda df: (
            df.repartition(buckets, KEY_HASH).select(*self.spark.table(name).columns).write.insertInto(name)
        ))

    def unstored(self, table: str, facts: DataFrame, months: list[int], days: DataFrame) -> DataFrame:
        """Facts that are not stored yet, with their hash. Stored rows stay in their buckets and the facts are sent to
        them; ``append`` finds the new ones there and moves them no more.

        Rows meet by the hash alone, which is how the table is laid out; the columns of the key, NULL equal to NULL, are
        compared where they have met. ``days`` isn't needed: the months prune the table.
        """
        keys = NATURAL_KEYS[table]
        have = self._stored(table, months).select(F.col(KEY_HASH).alias("_have"), *[F.col(k).alias(f"_have_{k}") for k in keys])
        keyed = facts.withColumn(KEY_HASH, _key_hash(table))
        # equalities outside an array would become join keys, and the layout would no longer fit
        return keyed.join(have, (F.col(KEY_HASH) == F.col("_have")) & all_same(keys), "left_anti")
