"""Record access: keyword filters, human views, audit columns and schema changes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.functions.times import ms_to_text, text_to_ms
from tapeworks.session import scratch_path

CONTINUOUS = (T.IntegralType, T.FractionalType, T.DatetimeType)
# Stems of the automatic time columns.
AUTO_TIME = ("create", "start", "end", "update", "read_access", "write_access")


def filter_records(df: DataFrame, reverse: bool | None = None, order_by: str | None = None, **wanted) -> DataFrame:
    """Rows that meet every keyword.

    A scalar must be equal. A list must contain a value of a discrete column; for a continuous
    column a list of two is a range, open where an end is None. None values, unknown columns and
    lists of other lengths on continuous columns say nothing, and with nothing said the result is
    empty. ``reverse`` sorts descending (True) or ascending (False) by ``order_by``, or by
    ``create_time`` where that column is not known.
    """
    kinds = {field.name: field.dataType for field in df.schema.fields}
    predicates = []
    for name, value in wanted.items():
        if name not in kinds or value is None:
            continue
        column = F.col(name)
        if not isinstance(value, (list, set, tuple)):
            predicates.append(column == value)
        elif not isinstance(kinds[name], CONTINUOUS):
            predicates.append(column.isin(list(value)))
        elif len(value) == 2:
            low, high = [_bound(name, v) for v in value]
            if low is not None:
                predicates.append(column >= low)
            if high is not None:
                predicates.append(column <= high)
    if not predicates:
        return df.limit(0)
    kept = df.where(reduce(and_, predicates))
    if reverse is None:
        return kept
    field = order_by if order_by in kinds else "create_time"
    return kept.orderBy(F.col(field).desc() if reverse else F.col(field).asc())


def _bound(name: str, value):
    """Range end; text on an automatic time column means a moment in epoch milliseconds."""
    stem = name.removeprefix("f_").removesuffix("_time")
    if isinstance(value, str) and name.endswith("_time") and stem in AUTO_TIME:
        return text_to_ms(F.lit(value))
    return None if value is None else F.lit(value)


def human_view(df: DataFrame, keys: Sequence[str] = (), only: Sequence[str] = ()) -> DataFrame:
    """Names without the ``f_`` prefix; with ``only``, just the keys and those fields."""
    if not only:
        return df.select([F.col(c).alias(c.removeprefix("f_")) for c in df.columns])
    return df.select(
        *[F.col(k).alias(k.removeprefix("f_")) for k in keys], *[F.col(f"f_{c}").alias(c) for c in only]
    )


def with_audit(df: DataFrame, now_ms: int, inserting: bool = True) -> DataFrame:
    """Stamp the write time; ``*_date`` text follows every ``*_time`` column of epoch milliseconds."""
    now = F.lit(now_ms).cast("bigint")
    stamped = df.withColumn("update_time", now)
    if inserting:
        stamped = stamped.withColumn("create_time", now)
    dates = {
        f"{stem}_date": ms_to_text(F.col(f"{stem}_time")) for stem in AUTO_TIME if f"{stem}_time" in stamped.columns
    }
    return stamped.withColumns(dates)


def add_column(df: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    """Add a column unless it is there."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))


def change_type(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Cast a column; values that do not fit become NULL (count them with ``values_lost``)."""
    return df.withColumn(name, F.col(name).try_cast(kind))


def values_lost(df: DataFrame, name: str, kind: str) -> DataFrame:
    lost = F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()
    return df.agg(F.count_if(lost).alias("values_lost"))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename; nothing happens where the old name is missing or the new one taken."""
    return df.withColumnRenamed(old, new) if old in df.columns and new not in df.columns else df


def create_tables(spark, schemas: dict[str, str], database: str = "default", location: str | None = None) -> list[str]:
    """Create the declared tables that do not exist; returns the names created.

    Tables live under ``location``, by default a fresh path in the shared folder.
    """
    root = location or scratch_path(spark, "tables")
    made = []
    for name, schema in schemas.items():
        full = f"{database}.{name}"
        if not spark.catalog.tableExists(full):
            spark.catalog.createTable(full, path=f"{root}/{name}", source="parquet",
                                      schema=spark.createDataFrame([], schema).schema)
            made.append(name)
    return made
