"""The register of named queries."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.plans.inputs import Inputs


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}

TEXT_FORMS = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss"}


def portable(df: DataFrame) -> DataFrame:
    """Result columns in types that compare alike everywhere: decimals as doubles, dates as text."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind.startswith("decimal"):
            column = column.cast("double")
        elif kind in TEXT_FORMS:
            column = F.date_format(column, TEXT_FORMS[kind])
        columns.append(column.alias(name))
    return df.select(columns)


def query(name: str, sql: str | None = None):
    """Register a function of the inputs under ``name``, with the SQL that gives the same rows."""

    def register(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(build(Inputs(spark, sf_dir)))

        CATALOG[name] = Query(run, sql)
        return build

    return register
