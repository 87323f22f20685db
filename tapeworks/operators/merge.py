"""De-duplication, merges on a key and surrogate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.text import row_hash
from tapeworks.operators.joins import meeting, not_in


def first_by_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column] = (), meet: Sequence[str] = ()
) -> DataFrame:
    """One row per key: the first by ``order``, then by every other column, NULLs first.

    Spark keeps only the first row of each key before the shuffle, so copies of one key do not
    pile up in a task. That sorts the rows where they are read. With ``meet``, some of the keys, rows go
    unsorted to the task of the hash of these instead, where ``not_in`` on the same columns finds them in place.
    """
    rest = [F.col(c).asc_nulls_first() for c in df.columns if c not in keys]
    if not rest and not order:
        return df.distinct()
    together = [meeting(meet)] if meet else []
    df = df.repartition(*together) if meet else df
    # the hash comes last, so that rows leave in the order of their keys, which packs better than one of hashes
    window = Window.partitionBy(*keys, *together).orderBy(*order, *rest)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def with_row_hash(df: DataFrame, name: str = "row_hash", columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumn(name, row_hash([F.col(c) for c in columns or df.columns]))


def distinct_by_hash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that differ in the hash of ``columns`` (all by default), one of each."""
    hashed = with_row_hash(df, "_hash", columns)
    if columns is None or set(columns) == set(df.columns):
        return hashed.distinct().drop("_hash")
    return first_by_key(hashed, ["_hash"]).drop("_hash")


def insert_ignore(existing: DataFrame, batch: DataFrame, key: str, sequence: str) -> DataFrame:
    """Rows of ``batch`` to append: the first per key by ``sequence``, keys not yet present."""
    return not_in(first_by_key(batch, [key], [F.col(sequence)]), existing, [key])


def upsert(existing: DataFrame, batch: DataFrame, key: str, sequence: str) -> DataFrame:
    """``existing`` with ``batch`` merged in: the last batch row per key replaces the old one.

    Only the batch is ordered; stored rows are kept by an anti join, which needs no sort of them
    while the keys of the batch can be broadcast.
    """
    newest = first_by_key(batch, [key], [F.col(sequence).cast("bigint").desc_nulls_last()]).select(*existing.columns)
    return not_in(existing, newest, [key]).unionByName(newest)


def append_new(existing: DataFrame, collected: DataFrame, key: str) -> DataFrame:
    """All rows of both tables, one per key; a row already present wins over a collected one."""
    tagged = existing.withColumn("_age", F.lit(0)).unionByName(collected.withColumn("_age", F.lit(1)))
    return first_by_key(tagged, [key], [F.col("_age")]).drop("_age")


def surrogate_keys(members: DataFrame, name: str, key: str, start: Column | int = 0) -> DataFrame:
    """Number the members from ``start`` + 1 in the order of (md5 of the name, name).

    The numbering is the same on every run. Members are counted per bucket of the digest, and only
    those counts (one row per bucket) are summed in one task; the members themselves are numbered
    within their buckets in parallel.
    """
    digest = F.md5(F.col(name))
    bucket = F.conv(F.substring("_digest", 1, 3), 16, 10).cast("int")
    hashed = members.withColumn("_digest", digest).withColumn("_bucket", bucket)
    counts = hashed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_bucket").orderBy("_digest", name)
    start = F.lit(start) if isinstance(start, int) else start
    number = start + F.col("_offset") + F.row_number().over(within)
    return (
        hashed.join(F.broadcast(offsets), "_bucket")  # a row per digest prefix, 4,096 at most
        .withColumn(key, number.cast("bigint"))
        .select(key, *members.columns)
    )
