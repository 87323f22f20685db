"""Decoding of wire messages into typed rows, with the rejected messages kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.text import number
from tapeworks.functions.times import ms_to_moment, trading_date

Fields = list[tuple[str, str, str]]
BROKEN = "_broken"


def text_struct(json: Column, names: list[str]) -> Column:
    """Parse a JSON object with every field as text, plus a column that holds unparseable input."""
    schema = ", ".join(f"`{name}` string" for name in [*names, BROKEN])
    return F.from_json(json, schema, {"columnNameOfCorruptRecord": BROKEN})


def with_record(df: DataFrame, json: str, names: list[str]) -> DataFrame:
    """Add ``_record``, the ``text_struct`` of a JSON column.

    The one-element explode keeps Spark from moving a later filter, and with it a second parse of
    the text, below the parse.
    """
    return df.select("*", F.explode(F.array(text_struct(F.col(json), names))).alias("_record"))


def is_object(json: Column, record: Column) -> Column:
    """Whether the text was one JSON object, given its ``text_struct``."""
    text = F.trim(json)
    whole = text.startswith("{") & text.endswith("}")
    return F.coalesce(whole & record[BROKEN].isNull(), F.lit(False))


def typed(text: Column, kind: str) -> Column:
    if kind == "string":
        return text
    if kind == "date":
        return trading_date(text)
    return number(text, kind)


def typed_columns(record: str, fields: Fields) -> list[Column]:
    return [typed(F.col(record)[wire], kind).alias(column) for wire, column, kind in fields]


def decode_envelopes(messages: DataFrame, fields: Fields, value: str = "value", *keep: str) -> DataFrame:
    """Typed fields of ``{"Content": "<JSON text>"}`` messages and the ``reject_reason`` of bad ones."""
    content = F.get_json_object(F.col(value), "$.Content")
    opened = with_record(messages.withColumn("_content", content), "_content", [wire for wire, _, _ in fields])
    reason = F.when(F.col("_content").isNull(), "no content").when(
        ~is_object(F.col("_content"), F.col("_record")), "content is not a JSON object"
    )
    return opened.select(
        *keep, F.col(value).alias("_message"), *typed_columns("_record", fields), reason.alias("reject_reason")
    )


def good(decoded: DataFrame) -> DataFrame:
    return decoded.where("reject_reason is null").drop("_message", "reject_reason")


def quarantine(decoded: DataFrame) -> DataFrame:
    return decoded.where("reject_reason is not null").select(
        F.col("_message").alias("message"), "reject_reason"
    )


def decode_ticks(messages: DataFrame, value: str = "value", *keep: str) -> DataFrame:
    """Ticks ``{"symbol", "price", "volume", "timestamp"}`` of epoch milliseconds.

    A missing number counts as 0, a number that cannot be read rejects the message, and so does a
    missing symbol.
    """
    names = ["symbol", "price", "volume", "timestamp"]
    kinds = {"price": "double", "volume": "double", "timestamp": "bigint"}
    opened = with_record(messages, value, names)
    text = {name: F.col("_record")[name] for name in names}
    unread = F.lit(False)
    for name, kind in kinds.items():
        unread = unread | (text[name].isNotNull() & number(text[name], kind).isNull())
    read = {name: F.coalesce(number(text[name], kind), F.lit(0).cast(kind)) for name, kind in kinds.items()}
    event_ts = ms_to_moment(read["timestamp"])
    reason = (
        F.when(~is_object(F.col(value), F.col("_record")), "not a JSON object")
        .when(text["symbol"].isNull(), "no symbol")
        .when(unread | event_ts.isNull(), "bad number")
    )
    return opened.select(
        *keep,
        F.col(value).alias("_message"),
        F.trim(text["symbol"]).alias("symbol"),
        *[column.alias(name) for name, column in read.items()],
        event_ts.alias("event_ts"),
        reason.alias("reject_reason"),
    )


def trades_as_ticks(trades: DataFrame, *keep: str) -> DataFrame:
    """Ticks from decoded trade rows: last price and volume at trading date and time."""
    moment = F.concat_ws(" ", F.date_format("trading_date", "yyyy-MM-dd"), F.trim("time"))
    event_ts = F.try_to_timestamp(moment, F.lit("yyyy-MM-dd HH:mm:ss"))
    ticks = trades.select(
        *keep,
        F.trim("symbol").alias("symbol"),
        F.col("last_price").alias("price"),
        F.col("last_vol").alias("volume"),
        F.unix_millis(event_ts).alias("timestamp"),
        event_ts.alias("event_ts"),
    )
    return ticks.where("symbol is not null and event_ts is not null and price is not null")
