"""Comparison of a query with its SQL oracle."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    number = float(value)
    return None if math.isnan(number) else number + 0.0


def rows_of(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark_df, connection, sql: str) -> list[str]:
    """What differs between a Spark result and the oracle; empty when they agree."""
    relation = connection.sql(sql)
    want_names, want = rows_of(relation.columns, relation.fetchall())
    got_names, got = rows_of(spark_df.columns, spark_df.collect())
    if got_names != want_names:
        return [f"columns {got_names} instead of {want_names}"]
    found = []
    if sum(got.values()) != sum(want.values()):
        found.append(f"{sum(got.values())} rows instead of {sum(want.values())}")
    extra, missing = got - want, want - got
    if extra or missing:
        found.append(f"{sum(extra.values())} rows differ, columns {got_names}")
        found += [f"  got  {row}" for row in sorted(extra, key=repr)[:3]]
        found += [f"  want {row}" for row in sorted(missing, key=repr)[:3]]
    return found
