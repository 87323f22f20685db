"""Daily series per symbol: scaling, sequences, splits.

A series holds at most one row per symbol and calendar day, so a window over one symbol is bounded
by the calendar however much the symbol trades. Rows at tick level have no such bound; for those
see ``ticks.py``.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeworks.functions.numbers import rounded
from tapeworks.functions.scaling import minmax
from tapeworks.functions.times import clock_key
from tapeworks.operators.joins import lookup
from tapeworks.schemas import FEATURES

SYMBOL, DAY = "symbol", "tradingdate"


def by_symbol() -> WindowSpec:
    return Window.partitionBy(SYMBOL)


def by_day() -> WindowSpec:
    return by_symbol().orderBy(DAY)


def daily_series(trades: DataFrame) -> DataFrame:
    """One row per symbol and day: the day's last trade, with totals and extremes of the day.

    Trades of one second are ordered by price, then by a hash of their features, so the result does
    not depend on the order of the input. Values are combined before the shuffle, in a hash aggregate.
    """
    state = [c for c in FEATURES if c not in ("total_val", "highest", "lowest")]
    rows = trades.where("trading_date is not null").select(
        F.trim("symbol").alias(SYMBOL),
        F.col("trading_date").alias(DAY),
        _trade_order(clock_key(F.col("time")), F.col("last_price"), state).alias("_order"),
        *FEATURES,
    )
    days = rows.groupBy(SYMBOL, DAY).agg(
        *[F.max_by(c, "_order").alias(c) for c in state],
        F.sum("total_val").alias("total_val"),
        F.max("highest").alias("highest"),
        F.min("lowest").alias("lowest"),
    )
    return days.select(SYMBOL, DAY, *FEATURES)


def _trade_order(at: Column, price: Column, columns: Sequence[str]) -> Column:
    """Time, price in ten-thousandths and a hash of ``columns``, packed in one DECIMAL(38): a number stays in a
    hash aggregate, where a struct would force a sort of all trades. Missing parts come first.

    The parts are put together as two BIGINTs first, for arithmetic of wide decimals is slow: time and the upper
    bits of the price (at most 18 and 45 bits), then its lower 13 bits and the hash.
    """
    parts = rounded(price * 10_000, 0)
    whole = F.when(F.abs(parts) < 1e17, parts.cast("bigint")).otherwise(F.lit(-(10**16)))
    above = whole + 10**17
    high = (F.coalesce(at, F.lit(-1)) + 1).cast("bigint") * 2**45 + F.shiftright(above, 13)
    low = above.bitwiseAND(F.lit(8191)) * 10**14 + F.pmod(F.xxhash64(*columns), F.lit(10**14))
    return (high.cast("decimal(19,0)") * F.lit(Decimal(10**18)) + low.cast("decimal(18,0)")).cast("decimal(38,0)")


def feature_bounds(rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Minimum and maximum of every feature per symbol."""
    bounds = [f(c).alias(f"{c}_{n}") for c in features for n, f in (("min", F.min), ("max", F.max))]
    return rows.groupBy(SYMBOL).agg(*bounds)


def scaled(series: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Features scaled to [0, 1] per symbol."""
    bounds = [f(c).over(by_symbol()).alias(f"_{n}_{c}") for c in features for n, f in (("low", F.min), ("high", F.max))]
    scale = {c: minmax(F.col(c), F.col(f"_low_{c}"), F.col(f"_high_{c}")) for c in features}
    return series.select("*", *bounds).withColumns(scale).select(*series.columns)


def with_min_history(series: DataFrame, rows: int = 3) -> DataFrame:
    """Rows of symbols that have at least ``rows`` of them."""
    return series.withColumn("_rows", F.count("*").over(by_symbol())).where(F.col("_rows") >= rows).drop("_rows")


def latest(rows: DataFrame, order: str = DAY) -> DataFrame:
    """The last row of every symbol by ``order``, which must not repeat within a symbol.

    A hash aggregate of one value per column, at any number of rows per symbol.
    """
    values = [c for c in rows.columns if c not in (SYMBOL, order)]
    last = rows.groupBy(SYMBOL).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in values])
    return last.select(*rows.columns)


def sequences(series: DataFrame, length: int, features: Sequence[str] = FEATURES) -> DataFrame:
    """Every run of ``length`` consecutive rows (``steps``) with the next row's price (``label``)."""
    before = by_day().rowsBetween(-length, -1)
    rows = series.select(
        SYMBOL,
        F.col(DAY).alias("label_date"),
        F.collect_list(F.struct(*features)).over(before).alias("steps"),
        F.col(features[0]).alias("label"),
    )
    return rows.where(F.size("steps") == length)


def labels(series: DataFrame, length: int, price: str = FEATURES[0]) -> DataFrame:
    """Date and price of every row that has ``length`` rows before it."""
    numbered = series.select(
        SYMBOL, F.col(DAY).alias("label_date"), F.col(price).alias("label"), F.row_number().over(by_day()).alias("_n")
    )
    return numbered.where(F.col("_n") > length).drop("_n")


def scoring_sequence(series: DataFrame, length: int, features: Sequence[str] = FEATURES) -> DataFrame:
    """The last ``length`` rows of every symbol that has as many."""
    back = by_symbol().orderBy(F.col(DAY).desc())
    recent = series.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= length)
    step = F.struct(-F.col("_back"), *features)
    runs = recent.groupBy(SYMBOL).agg(F.max(DAY).alias(DAY), F.sort_array(F.collect_list(step)).alias("steps"))
    bare = lambda s: F.struct(*[s[c].alias(c) for c in features])
    return runs.where(F.size("steps") == length).select(SYMBOL, DAY, F.transform("steps", bare).alias("steps"))


def step_columns(rows: DataFrame, length: int, features: Sequence[str] = FEATURES) -> list[Column]:
    """The steps as flat columns ``feature_1`` (oldest) to ``feature_length``."""
    return [F.col("steps")[i][c].alias(f"{c}_{i + 1}") for i in range(length) for c in features]


def chrono_split(rows: DataFrame, order: str, share: float = 0.8) -> DataFrame:
    """Mark the first ``share`` of every symbol's rows as training rows."""
    number = F.row_number().over(by_symbol().orderBy(order))
    cut = F.floor(F.count("*").over(by_symbol()) * F.lit(share))
    return rows.withColumn("is_train", number <= cut)


def newer_than(rows: DataFrame, marks: DataFrame, day: str = DAY) -> DataFrame:
    """Rows after their symbol's mark ``last_train_date``; all rows where there is no mark."""
    marked = lookup(rows, marks, {SYMBOL: SYMBOL}, [F.col("last_train_date").alias("_mark")])
    return marked.where(F.col("_mark").isNull() | (F.col(day) > F.col("_mark"))).drop("_mark")


def incremental_sequences(
    series: DataFrame, marks: DataFrame, length: int, features: Sequence[str] = FEATURES
) -> DataFrame:
    """Sequences that lie wholly after the mark of their symbol."""
    return sequences(newer_than(series, marks), length, features)
