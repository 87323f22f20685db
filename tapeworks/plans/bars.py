"""Queries: bars in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.operators.bars import bars, candles, daily_bars
from tapeworks.plans import oracle as o
from tapeworks.plans.catalog import query
from tapeworks.plans.inputs import Inputs
from tapeworks.session import scratch_path
from tapeworks.sources.message_log import read_log, write_log
from tapeworks.sources.messages import trades_as_ticks
from tapeworks.streaming.jobs import candle_stream, rocksdb_state, sent_once, to_table
from tapeworks.streaming.revised import last_revisions, late_ticks, revised_bars


def _bars_sql(bucket: str, extra: str = "", having: str = "") -> str:
    return o.with_(o.TICK) + f"""SELECT symbol, strftime({bucket}, '%Y-%m-%d %H:%M:%S') AS bar_start,
  arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close,
  sum(volume) AS volume, round(sum(price * volume), 4) AS value, epoch_us(min(ts)) // 1000 AS timestamp,
  count(*) AS ticks{extra}
FROM tick GROUP BY symbol, {bucket}{having}"""


def _shown(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select(
        "symbol", "bar_start", "open", "high", "low", "close", "volume", F.round("value", 4).alias("value"),
        "timestamp", "ticks", *extra,
    )


MINUTE = "date_trunc('minute', ts)"


@query("ohlcv_1m", _bars_sql(MINUTE))
def ohlcv_1m(t: Inputs) -> DataFrame:
    return _shown(bars(t.ticks(), "1 minute", tick_id="event_id"))


@query("ohlcv_5m", _bars_sql("time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01')"))
def ohlcv_5m(t: Inputs) -> DataFrame:
    return _shown(bars(t.ticks(), "5 minutes", tick_id="event_id"))


@query("ohlcv_1h", _bars_sql("date_trunc('hour', ts)"))
def ohlcv_1h(t: Inputs) -> DataFrame:
    return _shown(bars(t.ticks(), "1 hour", tick_id="event_id"))


@query("ohlc_daily", _bars_sql("date_trunc('day', ts)", ", round(sum(price * volume) / nullif(sum(volume), 0), 8) AS avg"))
def ohlc_daily(t: Inputs) -> DataFrame:
    days = daily_bars(t.ticks(), tick_id="event_id")
    return _shown(days.withColumn("avg", F.round("avg", 8)), "avg")


@query(
    "candle_messages",
    o.with_(o.TICK) + f"""SELECT symbol, arg_min(price, (ts, event_id)) AS open, arg_max(price, (ts, event_id)) AS close,
  max(price) AS high, min(price) AS low, sum(volume) AS volume, epoch_us(min(ts)) // 1000 AS timestamp
FROM tick GROUP BY symbol, {MINUTE}""",
)
def candle_messages(t: Inputs) -> DataFrame:
    """The seven fields of the candle topic, written to JSON text and read back."""
    sent = candles(bars(t.ticks(), "1 minute", tick_id="event_id")).select(F.to_json(F.struct("*")).alias("value"))
    schema = "symbol string, open double, close double, high double, low double, volume double, timestamp bigint"
    return sent.select(F.explode(F.array(F.from_json("value", schema))).alias("r")).select("r.*")


@query(
    "trade_candles",
    o.with_(o.TRADE) + f"""SELECT symbol, strftime(bar, '%Y-%m-%d %H:%M:%S') AS bar_start, max(last_price) AS high,
  min(last_price) AS low, sum(last_vol) AS volume, count(*) AS ticks,
  min({{'t': sod, 'p': last_price}}).p AS open, max({{'t': sod, 'p': last_price}}).p AS close,
  round(sum(last_price * last_vol), 2) AS value
FROM (SELECT *, date_trunc('minute', trading_date + to_seconds(sod)) AS bar FROM (
  SELECT *, (tk // 10000) * 3600 + ((tk // 100) % 100) * 60 + tk % 100 AS sod FROM trade) AS x) AS y
GROUP BY symbol, bar""",
)
def trade_candles(t: Inputs) -> DataFrame:
    """Bars of decoded trade rows, the other form a tick can arrive in."""
    rows = bars(trades_as_ticks(t.trades())).withColumn("value", F.round("value", 2))
    return rows.select("symbol", "bar_start", "open", "high", "low", "close", "volume", "value", "ticks")


@query("ohlcv_1m_stream", _bars_sql(
    MINUTE, having=f"\nHAVING {MINUTE} + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM tick)"))
def ohlcv_1m_stream(t: Inputs) -> DataFrame:
    """The bars a stream over the events has closed when the backlog is worked off."""
    path = scratch_path(t.spark, "candles")
    closed = candle_stream(Inputs.as_ticks(t.event_stream()), tick_id="event_id")
    with rocksdb_state(t.spark):
        to_table(closed, path, f"{path}-checkpoint", once=True).start().awaitTermination()
    return _shown(t.spark.read.schema(closed.schema).parquet(path))


@query("stream_map", "SELECT event_id, round(value * 10, 4) AS value FROM events WHERE event_type <> 'error'")
def stream_map(t: Inputs) -> DataFrame:
    """A stateless map and filter over a stream."""
    path = scratch_path(t.spark, "mapped")
    mapped = t.event_stream().where("event_type <> 'error'").select("event_id", F.round(F.col("value") * 10, 4).alias("value"))
    to_table(mapped, path, f"{path}-checkpoint", once=True).start().awaitTermination()
    return t.spark.read.schema(mapped.schema).parquet(path)


@query("stream_message_log", "SELECT event_id, event_type, 'events' AS partition FROM events")
def stream_message_log(t: Inputs) -> DataFrame:
    """Events sent to a message log by one stream, and what another one reads from it."""
    path = scratch_path(t.spark, "log")
    sent = t.event_stream().select(F.to_json(F.struct("event_id", "event_type")).alias("value"))
    write_log(sent, f"{path}/log", "events", f"{path}/sent").trigger(availableNow=True).start().awaitTermination()
    read = read_log(t.spark, f"{path}/log")
    rows = read.select(F.from_json("value", "event_id bigint, event_type string").alias("m"), "partition").select("m.*", "partition")
    to_table(rows, f"{path}/out", f"{path}/received", once=True).start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(f"{path}/out")


@query("stream_sent_once", "SELECT event_id, event_type FROM events")
def stream_sent_once(t: Inputs) -> DataFrame:
    """A stream in which every message is sent twice, each stored once."""
    path = scratch_path(t.spark, "sent")
    sent = t.event_stream().select(F.to_json(F.struct("event_id", "event_type")).alias("value"))
    once = sent_once(sent.select(F.explode(F.array("value", "value")).alias("value")))
    rows = once.select(F.from_json("value", "event_id bigint, event_type string").alias("m")).select("m.*")
    with rocksdb_state(t.spark):
        to_table(rows, path, f"{path}-checkpoint", once=True).start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(path)


# ticks of even ids come first; those of odd ids are late where the bar ended by the watermark, 3 days behind
_LATE = f"""({MINUTE} + INTERVAL 1 MINUTE
  <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 3 DAY FROM tick WHERE event_id % 2 = 0))"""


def _revised(t: Inputs) -> DataFrame:
    """All that a stream of revised bars gives for the even events, and after a restart for the odd ones."""
    path = scratch_path(t.spark, "revised")
    for rest in (0, 1):
        t.table("events").where(F.col("event_id") % 2 == rest).write.mode("append").parquet(f"{path}/events")
        events = t.spark.readStream.schema(t.table("events").schema).parquet(f"{path}/events")
        rows = revised_bars(t.as_ticks(events), delay="3 days", tick_id="event_id")
        with rocksdb_state(t.spark):
            to_table(rows, f"{path}/bars", f"{path}/checkpoint", once=True).start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(f"{path}/bars")


@query("stream_revised_bars", _bars_sql(MINUTE).replace("FROM tick GROUP BY", f"FROM tick WHERE event_id % 2 = 0 OR NOT {_LATE} GROUP BY"))
def stream_revised_bars(t: Inputs) -> DataFrame:
    """The last revision of every bar over two runs of a stream."""
    newest = last_revisions(_revised(t)).withColumn("timestamp", F.unix_millis("begun"))
    return _shown(newest)


@query(
    "stream_late_ticks",
    o.with_(o.TICK) + f"""SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_ts, price, volume, event_id AS tick_id
FROM tick WHERE event_id % 2 = 1 AND {_LATE}""",
)
def stream_late_ticks(t: Inputs) -> DataFrame:
    """The ticks that came after their bar was closed, as rows."""
    return late_ticks(_revised(t))
