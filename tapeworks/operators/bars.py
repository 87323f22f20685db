"""Open-high-low-close-volume bars; the same function serves tables and streams."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tick_order(ts: Column, tick_id: Column | None, price: Column) -> Column:
    """Order of ticks: by time, then by id, or by price in ten-thousandths where there is no id.

    Both parts are packed in one DECIMAL(38), which Spark can keep in a hash aggregate (a struct
    would force a sort). 16 digits of microseconds and 20 of the second part fit without overlap.
    """
    micros = F.unix_micros(ts).cast("decimal(18,0)")
    second = tick_id.cast("decimal(19,0)") if tick_id is not None else F.round(price * 10_000).try_cast("decimal(19,0)")
    return (micros * F.lit(Decimal(10**19)) + F.coalesce(second, F.lit(Decimal(0)))).cast("decimal(38,0)")


def bars(
    ticks: DataFrame,
    interval: str = "1 minute",
    symbol: str = "symbol",
    ts: str = "event_ts",
    tick_id: str | None = None,
) -> DataFrame:
    """One row per symbol and ``interval`` that holds a tick.

    ``ticks`` needs ``symbol``, a timestamp ``ts``, ``price`` and ``volume``. Ticks of one instant
    are ordered by ``tick_id``, or by price where there is none. Partial aggregation reduces a
    busy symbol before the shuffle.
    """
    id_column = F.col(tick_id) if tick_id else None
    ordered = ticks.withColumn("_order", tick_order(F.col(ts), id_column, F.col("price")))
    grouped = ordered.groupBy(F.window(ts, interval).alias("_window"), symbol).agg(
        F.min_by("price", "_order").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_order").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum(F.col("price") * F.col("volume")).alias("value"),
        F.unix_millis(F.min(ts)).alias("timestamp"),
        F.count("*").alias("ticks"),
    )
    return grouped.select(
        symbol,
        F.col("_window.start").alias("bar_start"),
        F.col("_window.end").alias("bar_end"),
        "open", "high", "low", "close", "volume", "value", "timestamp", "ticks",
    )


def candles(bar_rows: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Bars in the seven-field form of the candle topic."""
    return bar_rows.select(symbol, "open", "close", "high", "low", "volume", "timestamp")


def daily_bars(ticks: DataFrame, symbol: str = "symbol", ts: str = "event_ts", tick_id: str | None = None) -> DataFrame:
    """Bars per calendar day with the volume-weighted average price."""
    average = F.col("value") / F.nullif(F.col("volume"), F.lit(0.0))
    return bars(ticks, "1 day", symbol, ts, tick_id).withColumn("avg", average)
