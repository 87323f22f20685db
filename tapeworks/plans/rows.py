"""Queries: filters, records, schema changes, parsing, times, ingestion and loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions import text, times
from tapeworks.functions.scaling import finite
from tapeworks.operators import merge, records, star
from tapeworks.plans import oracle as o
from tapeworks.plans.catalog import query
from tapeworks.plans.inputs import Inputs, envelopes
from tapeworks.schemas import CHANNELS, DAILY_INDEX, DAILY_PRICE
from tapeworks.session import scratch_path, staged
from tapeworks.sources import kafka, messages, responses
from tapeworks.sources.files import read_csv, read_landed_pages, replace_table, read_table, write_csv
from tapeworks.streaming.jobs import batch_writer, compact, raw_table

NOW_MS = 1_735_689_600_000  # 2025-01-01 00:00:00

# Filters


@query(
    "day_slice",
    o.with_(o.TRADE)
    + "SELECT symbol, time, last_price, last_vol, total_val FROM trade WHERE trade.trading_date = '1998-06-01'",
)
def day_slice(t: Inputs) -> DataFrame:
    day = t.trades(dealt_out=False, since="1998-06-01", before="1998-06-02")
    return day.select(F.trim("symbol").alias("symbol"), "time", "last_price", "last_vol", "total_val")


@query(
    "recent_trades",
    o.with_(o.TRADE)
    + f"""SELECT symbol, {o.day_text('trading_date')} AS trading_date, time, last_price, last_vol
FROM trade WHERE trade.trading_date >= DATE '2001-11-04' - INTERVAL 5 DAY""",
)
def recent_trades(t: Inputs) -> DataFrame:
    rows = star.recent(t.trades(dealt_out=False, since="2001-10-30"), "2001-11-04", 5)
    return rows.select(F.trim("symbol").alias("symbol"), "trading_date", "time", "last_price", "last_vol")


@query(
    "entity_series",
    o.with_(o.INDEX)
    + f"""SELECT {o.day_text('trading_date')} AS trading_date, time, index_value.index_value, change
FROM index_value WHERE index_name = '1-URGENT' ORDER BY index_value.trading_date, time""",
)
def entity_series(t: Inputs) -> DataFrame:
    rows = t.index_values().where(F.trim("index_name") == "1-URGENT")
    return rows.select("trading_date", "time", "index_value", "change").orderBy("trading_date", "time")


def _records(t: Inputs) -> DataFrame:
    return t.table("events").select(
        F.col("event_id").alias("id"), "event_type", "user_id", "value",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("create_time"),
    )


_RECORDS_SQL = "SELECT event_id AS id, event_type, user_id, value, epoch_us(ts) // 1000 AS create_time FROM events WHERE "


@query("filter_eq", _RECORDS_SQL + "event_type = 'click' AND user_id = 7")
def filter_eq(t: Inputs) -> DataFrame:
    return records.filter_records(_records(t), event_type="click", user_id=7, unknown=1, value=None)


@query("filter_in", _RECORDS_SQL + "event_type IN ('view', 'error')")
def filter_in(t: Inputs) -> DataFrame:
    return records.filter_records(_records(t), event_type=["view", "error"])


@query(
    "filter_between",
    _RECORDS_SQL + "value BETWEEN 10 AND 20 AND ts >= '2024-01-10 00:00:00' AND ts < '2024-01-20 00:00:00.001'",
)
def filter_between(t: Inputs) -> DataFrame:
    wanted = ["2024-01-10 00:00:00", "2024-01-20 00:00:00"]
    return records.filter_records(_records(t), value=[10, 20], create_time=wanted)


@query("filter_ge", _RECORDS_SQL + "value >= 150")
def filter_ge(t: Inputs) -> DataFrame:
    return records.filter_records(_records(t), value=[150, None])


@query("filter_le", _RECORDS_SQL + "value <= 5.5")
def filter_le(t: Inputs) -> DataFrame:
    return records.filter_records(_records(t), value=[None, 5.5])


@query("filter_none_is_empty", _RECORDS_SQL + "event_type = 'purchase'")
def filter_none_is_empty(t: Inputs) -> DataFrame:
    """Rows that meet a condition, and those that meet none of three that say nothing: no more rows."""
    wanted = records.filter_records(_records(t), event_type="purchase")
    return wanted.unionByName(records.filter_records(_records(t), unknown=3, user_id=None, value=[1, 2, 3]))


@query("filter_ordered", _RECORDS_SQL + "event_type = 'signup' ORDER BY create_time DESC")
def filter_ordered(t: Inputs) -> DataFrame:
    return records.filter_records(_records(t), reverse=True, order_by="no_such_field", event_type="signup")


@query("preview_limit", _RECORDS_SQL + "true ORDER BY value DESC, event_id LIMIT 5")
def preview_limit(t: Inputs) -> DataFrame:
    return _records(t).orderBy(F.col("value").desc(), "id").limit(5)


@query("human_view", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def human_view(t: Inputs) -> DataFrame:
    stored = t.table("customer").select(
        F.col("c_custkey").alias("f_id"), F.col("c_name").alias("f_name"), F.col("c_acctbal").alias("f_balance"),
        F.col("c_mktsegment").alias("f_segment"),
    )
    return records.human_view(stored, keys=["f_id"], only=["name", "balance"])


@query(
    "nonfinite_count",
    """SELECT count(*) FILTER (l_discount = 0) AS nonfinite, count(*) FILTER (l_discount <> 0) AS finite FROM lineitem""",
)
def nonfinite_count(t: Inputs) -> DataFrame:
    """Ratios with a zero base are infinite; the guard makes them NULL."""
    base = F.col("l_discount")
    ratio = F.when(base == 0, F.lit(float("inf"))).otherwise(F.col("l_tax") / F.nullif(base, F.lit(0.0)))
    rows = t.table("lineitem").select(finite(ratio).alias("ratio"))
    missing = F.col("ratio").isNull()
    return rows.agg(F.count_if(missing).alias("nonfinite"), F.count_if(~missing).alias("finite"))


# Schema changes and audit columns


@query("evolve_add", "SELECT s_suppkey, s_name, 'new' AS state FROM supplier")
def evolve_add(t: Inputs) -> DataFrame:
    rows = t.table("supplier").select("s_suppkey", "s_name")
    return records.add_column(records.add_column(rows, "state", "string", "new"), "s_name", "string", "not used")


@query(
    "evolve_type",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS code,
  (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0) AS values_lost FROM orders""",
)
def evolve_type(t: Inputs) -> DataFrame:
    """A text column made a number, with the count of values that are none."""
    code = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string"))
    rows = t.table("orders").select("o_orderkey", code.alias("code"))
    lost = records.values_lost(rows, "code", "bigint").first()[0]
    return records.change_type(rows, "code", "bigint").withColumn("values_lost", F.lit(lost).cast("bigint"))


@query("evolve_rename", "SELECT p_partkey, p_name AS symbol_name, p_brand FROM part")
def evolve_rename(t: Inputs) -> DataFrame:
    rows = t.table("part").select("p_partkey", "p_name", "p_brand")
    renamed = records.rename_column(rows, "p_name", "symbol_name")
    return records.rename_column(records.rename_column(renamed, "missing", "x"), "p_brand", "p_partkey")


@query(
    "audit_columns",
    f"""SELECT event_id, epoch_us(ts) // 1000 AS start_time, strftime(ts, '%Y-%m-%d %H:%M:%S') AS start_date,
  {NOW_MS} AS create_time, '2025-01-01 00:00:00' AS create_date, {NOW_MS} AS update_time,
  '2025-01-01 00:00:00' AS update_date FROM events""",
)
def audit_columns(t: Inputs) -> DataFrame:
    rows = t.table("events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("start_time"))
    return records.with_audit(rows, NOW_MS)


# Times


@query(
    "ms_to_string",
    "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS moment FROM events",
)
def ms_to_string(t: Inputs) -> DataFrame:
    ms = F.when(F.col("event_id") % 5 != 0, F.unix_millis(F.col("ts").cast("timestamp")))
    return t.table("events").select("event_id", times.ms_to_text(ms).alias("moment"))


@query("string_to_ms", "SELECT event_id, (epoch_us(ts) // 1000000) * 1000 AS ms FROM events")
def string_to_ms(t: Inputs) -> DataFrame:
    return t.table("events").select("event_id", times.text_to_ms(F.date_format("ts", times.TEXT_TIMESTAMP)).alias("ms"))


@query("trunc_second", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.000000' AS moment FROM events")
def trunc_second(t: Inputs) -> DataFrame:
    moment = F.date_format(times.to_second(F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return t.table("events").select("event_id", moment.alias("moment"))


@query(
    "delta_seconds",
    "SELECT event_id, epoch(TIMESTAMP '2024-02-01' - date_trunc('second', ts))::DOUBLE AS seconds FROM events",
)
def delta_seconds(t: Inputs) -> DataFrame:
    moment, as_of = F.date_format("ts", times.TEXT_TIMESTAMP), F.lit("2024-02-01 00:00:00").cast("timestamp")
    return t.table("events").select("event_id", times.seconds_since(moment, as_of).alias("seconds"))


# Parsing


@query(
    "parse_trading_date",
    f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE {o.day_text('o_orderdate')} END
  AS trading_date FROM orders""",
)
def parse_trading_date(t: Inputs) -> DataFrame:
    """Two-digit and one-digit forms are read; impossible dates and other text are not."""
    return t.table("orders").select("o_orderkey", times.trading_date(_date_text()).alias("trading_date"))


def _date_text() -> Column:
    date, form = F.col("o_orderdate"), F.col("o_orderkey") % 4
    return (
        F.when(form == 0, F.date_format(date, "dd/MM/yyyy"))
        .when(form == 1, F.date_format(date, "d/M/yyyy"))
        .when(form == 2, F.concat(F.lit("31/02/"), F.date_format(date, "yyyy")))
        .otherwise(F.date_format(date, "yyyy-MM-dd"))
    )


@query("trim_keys", "SELECT o_orderkey, o_orderpriority AS index_name, o_orderstatus AS exchange FROM orders")
def trim_keys(t: Inputs) -> DataFrame:
    padded = t.table("orders").select(
        "o_orderkey", F.rpad("o_orderpriority", 20, " ").alias("index_name"),
        F.concat(F.lit(" "), "o_orderstatus").alias("exchange"),
    )
    return padded.select("o_orderkey", F.trim("index_name").alias("index_name"), F.trim("exchange").alias("exchange"))


@query(
    "coalesce_blank",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE c_mktsegment END AS label
FROM customer""",
)
def coalesce_blank(t: Inputs) -> DataFrame:
    form = F.col("c_custkey") % 3
    name = F.when(form == 0, F.concat(F.lit(" "), "c_name")).when(form == 1, F.lit("  "))
    return t.table("customer").select("c_custkey", text.or_blank(name, F.col("c_mktsegment")).alias("label"))


def _tick_text(t: Inputs) -> DataFrame:
    """Events as tick messages; some of them are broken in one of four ways."""
    form = F.col("event_id") % 11
    good = F.to_json(F.struct(
        F.col("event_type").alias("symbol"),
        F.col("value").cast("string").alias("price"),
        F.when(form != 6, F.get_json_object("props", "$.k").cast("int")).alias("volume"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
    ))
    message = (
        F.when(form == 1, F.concat(good, F.lit(" tail")))
        .when(form == 2, F.concat(F.lit("["), good, F.lit("]")))
        .when(form == 3, F.replace(good, F.lit('"symbol"'), F.lit('"sym"')))
        .when(form == 4, F.replace(good, F.lit('"price":"'), F.lit('"price":"x')))
        .otherwise(good)
    )
    return t.table("events").select("event_id", message.alias("value"))


@query(
    "parse_good",
    """SELECT event_id, event_type AS symbol, value AS price,
  CASE WHEN event_id % 11 = 6 THEN 0.0 ELSE json_extract_string(props, '$.k')::DOUBLE END AS volume,
  epoch_us(ts) // 1000 AS timestamp FROM events WHERE event_id % 11 NOT IN (1, 2, 3, 4)""",
)
def parse_good(t: Inputs) -> DataFrame:
    return messages.good(messages.decode_ticks(_tick_text(t), "value", "event_id")).drop("event_ts")


@query(
    "parse_bad",
    """SELECT event_id, CASE event_id % 11 WHEN 3 THEN 'no symbol' WHEN 4 THEN 'bad number' ELSE 'not a JSON object' END
  AS reject_reason FROM events WHERE event_id % 11 IN (1, 2, 3, 4)""",
)
def parse_bad(t: Inputs) -> DataFrame:
    decoded = messages.decode_ticks(_tick_text(t), "value", "event_id")
    return decoded.where("reject_reason is not null").select("event_id", "reject_reason")


@query(
    "decode_envelope",
    f"""SELECT event_type AS symbol, value AS last_price, json_extract_string(props, '$.k')::DOUBLE AS last_vol,
  {o.day_text('ts')} AS trading_date, strftime(ts, '%H:%M:%S') AS time FROM events WHERE event_id % 13 <> 0""",
)
def decode_envelope(t: Inputs) -> DataFrame:
    """Trades in doubly encoded messages; a part of the messages has no readable content."""
    inner = F.to_json(F.struct(
        F.col("event_type").alias("Symbol"),
        F.col("value").cast("string").alias("LastPrice"),
        F.get_json_object("props", "$.k").cast("int").alias("LastVol"),
        F.date_format("ts", "dd/MM/yyyy").alias("TradingDate"),
        F.date_format("ts", "HH:mm:ss").alias("Time"),
    ))
    content = F.when(F.col("event_id") % 26 == 0, F.lit("no json")).when(F.col("event_id") % 13 != 0, inner)
    sent = t.table("events").select(F.to_json(F.struct(content.alias("Content"))).alias("value"))
    rows = messages.good(messages.decode_envelopes(sent, CHANNELS["trade"]))
    return rows.select("symbol", "last_price", "last_vol", "trading_date", "time")


@query(
    "json_defaults",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props ELSE '{}' END AS detail,
  CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') END AS k, '[]' AS tags FROM events""",
)
def json_defaults(t: Inputs) -> DataFrame:
    form = F.col("event_id") % 3
    stored = F.when(form == 0, F.col("props")).when(form == 1, F.lit(""))
    detail = text.json_or("{}", stored)
    return t.table("events").select(
        "event_id", detail.alias("detail"), F.from_json(detail, "map<string,string>")["k"].alias("k"),
        text.json_or("[]", F.lit(None).cast("string")).alias("tags"),
    )


@query(
    "json_encode",
    """SELECT o_orderkey, '{"key":' || o_orderkey || ',"status":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' ||
  o_orderstatus || '"' END || ',"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","at":"' ||
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '","tags":["' || o_orderpriority || '"]}' AS body FROM orders""",
)
def json_encode(t: Inputs) -> DataFrame:
    return t.table("orders").select("o_orderkey", text.json_record(
        F.col("o_orderkey").alias("key"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
        F.array("o_orderpriority").alias("tags"),
    ).alias("body"))


@query(
    "detail_json",
    """SELECT c_custkey::VARCHAR AS symbol_id, '{"Symbol":"' || c_custkey || '","Market":"' || c_mktsegment ||
  '","Nation":' || c_nationkey || '}' AS detail_json FROM customer WHERE c_nationkey >= 10""",
)
def detail_json(t: Inputs) -> DataFrame:
    """Security details as JSON text, for symbols that have no details yet."""
    item = F.struct(
        F.col("c_custkey").cast("string").alias("Symbol"), F.col("c_mktsegment").alias("Market"),
        F.col("c_nationkey").alias("Nation"),
    )
    rows = t.table("customer").select(
        F.col("c_custkey").cast("string").alias("symbol_id"), F.to_json(item).alias("detail_json"),
        F.col("c_custkey").alias("arrival"), "c_nationkey",
    )
    stored = rows.where("c_nationkey < 10").select("symbol_id", "detail_json")
    return merge.insert_ignore(stored, rows.drop("c_nationkey"), "symbol_id", "arrival").drop("arrival")


@query(
    "response_normalise",
    """SELECT c_custkey AS request, c_name AS "Symbol", c_mktsegment AS "Market" FROM customer WHERE c_custkey % 7 < 5
UNION ALL SELECT c_custkey, c_name || 'b', 'other' FROM customer WHERE c_custkey % 7 < 5""",
)
def response_normalise(t: Inputs) -> DataFrame:
    """Two records per response, in each of the response forms; two forms hold nothing."""
    record = lambda name, market: F.struct(name.alias("Symbol"), market.alias("Market"))
    rows = F.array(
        record(F.col("c_name"), F.col("c_mktsegment")), record(F.concat("c_name", F.lit("b")), F.lit("other"))
    )
    form = F.col("c_custkey") % 7
    body = (
        F.when(form == 0, F.to_json(rows))
        .when(form == 1, F.to_json(F.struct(rows.alias("dataList"))))
        .when(form == 2, F.to_json(F.struct(F.array().cast("array<string>").alias("dataList"), rows.alias("data"))))
        .when(form == 3, F.to_json(F.struct(F.struct(rows.alias("dataList")).alias("data"))))
        .when(form == 4, F.to_json(F.struct(rows.alias("RepeatedInfo"))))
        .when(form == 5, F.lit('{"dataList":[]}'))
        .otherwise(F.lit('{"message":"none"}'))
    )
    sent = t.table("customer").select(F.col("c_custkey").alias("request"), body.alias("body"))
    return responses.response_rows(sent, "body", "Symbol string, Market string", "request")


@query(
    "landed_pages_flatten",
    """SELECT c_mktsegment AS market, c_custkey::VARCHAR AS "Symbol", c_name AS "StockName", upper(c_name) AS "StockEnName"
FROM customer""",
)
def landed_pages_flatten(t: Inputs) -> DataFrame:
    """Pages of up to 100 securities per market, landed as JSON files and read back."""
    record = F.struct(
        F.col("c_custkey").cast("string").alias("Symbol"), F.col("c_name").alias("StockName"),
        F.upper("c_name").alias("StockEnName"),
    )
    page = t.table("customer").groupBy(
        F.col("c_mktsegment").alias("market"), F.floor(F.col("c_custkey") / 100).alias("page")
    ).agg(F.to_json(F.struct(F.collect_list(record).alias("data"))).alias("value"))
    path = scratch_path(t.spark, "landed_pages")
    page.select("market", "value").write.partitionBy("market").text(path)
    return read_landed_pages(t.spark, path, "Symbol string, StockName string, StockEnName string")


_CELL = "trim(regexp_replace(regexp_replace(cells[{0}], '(?s)^<li(?:\\s[^>]*)?>|</li>$', '', 'g'), '(?s)<[^>]*>', '', 'g'))"
_UNESCAPED = _CELL
for _entity, _char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]:
    _UNESCAPED = f"replace({_UNESCAPED}, '{_entity}', '{_char}')"


@query(
    "html_rows_extract",
    f"""WITH lists AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<ul(?:\\s[^>]*)?>.*?</ul>')) AS body,
  generate_subscripts(regexp_extract_all(html, '(?s)<ul(?:\\s[^>]*)?>.*?</ul>'), 1) - 1 AS row_no FROM pages),
rows AS (SELECT page_id, row_no, regexp_extract_all(body, '(?s)<li(?:\\s[^>]*)?>.*?</li>') AS cells FROM lists)
SELECT page_id, row_no, {', '.join(_UNESCAPED.format(i) + f' AS cell_{i}' for i in range(1, 7))}
FROM rows WHERE len(cells) >= 6""",
)
def html_rows_extract(t: Inputs) -> DataFrame:
    """Lists of the crawled pages as table rows of six cells."""
    names = [f"cell_{i}" for i in range(1, 7)]
    return responses.html_rows(t.table("pages"), "html", names, "ul", "li", "page_id")


_CHANNEL_OF = {"view": "X-TRADE:ALL", "click": "X-QUOTE:ALL", "signup": "MI:ALL", "error": "B:ALL", "purchase": "ZZ"}


@query(
    "route_channels",
    """SELECT CASE event_type WHEN 'view' THEN 'market_data_trade' WHEN 'click' THEN 'market_data_quote'
  WHEN 'signup' THEN 'index_data' ELSE 'bars' END AS topic, '{"id":' || event_id || '}' AS value
FROM events WHERE event_type <> 'purchase'""",
)
def route_channels(t: Inputs) -> DataFrame:
    """Messages with the topic of their channel; those of an unknown channel are set aside."""
    channel = F.lit(None).cast("string")
    for kind, code in _CHANNEL_OF.items():
        channel = F.when(F.col("event_type") == kind, code).otherwise(channel)
    sent = t.table("events").select(
        channel.alias("channel"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("value")
    )
    routed, _ = kafka.route(sent)
    return routed.select("topic", "value")


# Ingestion: raw rows sent as messages and decoded again


def _ingested(rows: DataFrame, channel: str) -> DataFrame:
    return messages.good(messages.decode_envelopes(envelopes(rows, channel), CHANNELS[channel]))


def _columns(channel: str, **changed: str) -> str:
    return ", ".join(
        f"{changed[c]} AS {c}" if c in changed else f"{o.day_text('src.' + c)} AS {c}" if kind == "date" else f"src.{c}"
        for _, c, kind in CHANNELS[channel]
    )


_PAD10 = {"symbol": "rpad(symbol, 10, ' ')", "exchange": "rpad(exchange, 5, ' ')",
          "trading_session": "rpad(src.trading_session, 5, ' ')"}


@query("ingest_trade", o.with_(o.TRADE) + f"SELECT {_columns('trade', **_PAD10)} FROM trade AS src")
def ingest_trade(t: Inputs) -> DataFrame:
    return _ingested(t.trades(), "trade")


@query("ingest_quote", o.with_(o.QUOTE) + f"SELECT {_columns('quote', symbol_id=_PAD10['symbol'].replace('symbol', 'symbol_id'))}"
       " FROM quote AS src")
def ingest_quote(t: Inputs) -> DataFrame:
    return _ingested(t.quotes(), "quote")


@query("raw_compacted", o.with_(o.QUOTE) + f"SELECT {_columns('quote', symbol_id=_PAD10['symbol'].replace('symbol', 'symbol_id'))}"
       " FROM quote AS src")
def raw_compacted(t: Inputs) -> DataFrame:
    """The raw table after batches, one of them handed over twice, a compaction of the first half, and one more batch."""
    path = f"{scratch_path(t.spark, 'raw')}/quote"
    sent = staged(envelopes(t.quotes().withColumn("_part", F.pmod(F.xxhash64("symbol_id", "time"), F.lit(3))), "quote", "_part"), "sent")
    write = batch_writer("quote", path, "feed")
    for number in (0, 1, 1):
        write(sent.where(F.col("_part") == number).drop("_part"), number)
    compact(t.spark, "quote", path, "2024-01-16")
    write(sent.where("_part = 2").drop("_part"), 2)
    return raw_table(t.spark, "quote", path)


@query(
    "ingest_index",
    o.with_(o.INDEX)
    + f"SELECT {_columns('index', index_name='''rpad(index_name, 20, ' ')''', exchange=_PAD10['exchange'])} FROM index_value AS src",
)
def ingest_index(t: Inputs) -> DataFrame:
    return _ingested(t.index_values(), "index")


@query(
    "ingest_foreign_room",
    f"""WITH p AS (SELECT *, round(o_totalprice * 100)::BIGINT AS c, (o_orderkey * 37) % 86400 AS sod FROM orders)
SELECT 'R' AS rtype, {o.day_text('o_orderdate')} AS trading_date, {o.CLOCK.format('sod')} AS time, 'VN' || o_orderkey AS isin,
  o_custkey::VARCHAR AS symbol, o_totalprice AS total_room, (c - 100) / 100 AS current_room,
  (o_orderkey % 19)::DOUBLE AS buy_vol, (o_orderkey % 23)::DOUBLE AS sell_vol, (c % 1009) / 100 AS buy_val,
  (c % 2003) / 100 AS sell_val, o_orderstatus AS market_id, o_orderpriority AS exchange FROM p""",
)
def ingest_foreign_room(t: Inputs) -> DataFrame:
    return _ingested(t.foreign_room(), "foreign_room")


@query(
    "ingest_status",
    f"""SELECT 'F' AS rtype, 'M1' AS market_id, {o.day_text('ts')} AS trading_date, strftime(ts, '%H:%M:%S') AS time,
  user_id::VARCHAR AS symbol_id, upper(event_type) AS trading_session,
  CASE WHEN value > 50 THEN 'A' ELSE 'H' END AS trading_status, substr(event_type, 1, 2) AS exchange,
  'OL' AS trading_ol_session FROM events""",
)
def ingest_status(t: Inputs) -> DataFrame:
    return _ingested(t.security_status(), "status")


# Loads of response records


def _filled(fields: messages.Fields, given: set[str], ours: bool) -> dict[str, str]:
    """SQL for the fields that are not ``given``, from the whole numbers ``c`` and ``k`` of a row: for Spark
    (``ours``) by wire name as text with spaces around, else by column name for the oracle."""
    values = {}
    for i, (wire, column, kind) in enumerate(fields):
        if wire not in given:
            text = f"concat(' {wire} ', (k + {i}) % 13)" if ours else f"'{wire} ' || ((k + {i}) % 13)"
            values[wire if ours else column] = (
                f"((c + {i}) % 9973) / 100" if kind == "double" else f"(k + {i}) % 97" if kind == "int" else text
            )
    return values


_INDEX_GIVEN = {"IndexId", "TradingDate", "TotalMatchVal", "TotalTrade", "Advances", "Change", "TradingSession"}
_PRICE_GIVEN = {
    "Symbol", "TradingDate", "ClosePrice", "AveragePrice", "CeilingPrice", "FloorPrice", "RefPrice", "PriceChange",
    "TotalMatchVol", "TotalMatchVal", "Time",
}


def _as_text(rows: DataFrame, fields: messages.Fields, given: dict[str, Column]) -> DataFrame:
    """Records with every wire field as text, ``given`` or missing."""
    return rows.select(*[given.get(wire, F.lit(None)).cast("string").alias(wire) for wire, _, _ in fields])


def _daily_index(t: Inputs) -> DataFrame:
    code = F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit(" "), "o_orderpriority"))
    given = {
        "IndexId": code, "TradingDate": _date_text(), "TotalMatchVal": F.col("o_totalprice"),
        "TotalTrade": F.col("o_custkey"), "Advances": F.col("o_orderkey") % 50, "Change": F.lit(""),
        "TradingSession": F.rpad("o_orderstatus", 3, " "),
    }
    orders = t.table("orders").withColumns({"c": F.round(F.col("o_totalprice") * 100).cast("bigint"), "k": F.col("o_orderkey")})
    filled = {wire: F.expr(sql) for wire, sql in _filled(DAILY_INDEX, _INDEX_GIVEN, True).items()}
    return responses.load_rows(_as_text(orders, DAILY_INDEX, given | filled), DAILY_INDEX, "IndexId")


def _null_columns(fields: messages.Fields, **given: str) -> str:
    return ", ".join(f"{given.get(c, 'NULL')} AS {c}" for _, c, _ in fields)


@query(
    "load_daily_index",
    "SELECT "
    + _null_columns(
        DAILY_INDEX, indexlist_id="o_orderpriority", trading_date=o.day_text("o_orderdate"), total_match_val="o_totalprice",
        total_trade="o_custkey", advances="o_orderkey % 50", trading_session="o_orderstatus",
        **_filled(DAILY_INDEX, _INDEX_GIVEN, False),
    )
    + " FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS c, o_orderkey AS k FROM orders) AS x"
    " WHERE o_orderkey % 9 <> 0 AND o_orderkey % 4 IN (0, 1)",
)
def load_daily_index(t: Inputs) -> DataFrame:
    return responses.accepted(_daily_index(t))


@query(
    "reject_reasons",
    """SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'no code' ELSE 'bad date' END AS reject_reason, count(*) AS rows
FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 4 IN (2, 3) GROUP BY 1""",
)
def reject_reasons(t: Inputs) -> DataFrame:
    rejected = _daily_index(t).where("reject_reason is not null")
    return rejected.groupBy("reject_reason").agg(F.count("*").alias("rows"))


@query(
    "load_daily_price",
    o.with_(o.TRADE)
    + "SELECT "
    + _null_columns(
        DAILY_PRICE, symbol_id="symbol", trading_date=o.day_text("src.trading_date"), close_price="last_price",
        average_price="avg_price", ceiling_price="ceiling", floor_price="floor", ref_price="ref_price",
        price_change="change", total_match_vol="last_vol", total_match_val="total_val", time="time",
        **(_filled(DAILY_PRICE, _PRICE_GIVEN, False) | {"net_buy_sell_vol": "NULL"}),
    )
    + " FROM (SELECT *, round(total_val * 100)::BIGINT AS c, last_vol::BIGINT AS k FROM trade) AS src",
)
def load_daily_price(t: Inputs) -> DataFrame:
    given = {
        "Symbol": F.col("symbol"), "TradingDate": F.date_format("trading_date", "dd/MM/yyyy"),
        "ClosePrice": F.col("last_price"), "AveragePrice": F.col("avg_price"), "CeilingPrice": F.col("ceiling"),
        "FloorPrice": F.col("floor"), "RefPrice": F.col("ref_price"), "PriceChange": F.col("change"),
        "TotalMatchVol": F.col("last_vol"), "TotalMatchVal": F.col("total_val"), "Time": F.col("time"),
        "NetBuySellVol": F.lit(" "),
    }
    trades = t.trades().withColumns({"c": F.round(F.col("total_val") * 100).cast("bigint"), "k": F.col("last_vol").cast("bigint")})
    filled = {wire: F.expr(sql) for wire, sql in _filled(DAILY_PRICE, _PRICE_GIVEN, True).items()}
    records_ = _as_text(trades, DAILY_PRICE, filled | given)
    return responses.accepted(responses.load_rows(records_, DAILY_PRICE, "Symbol"))


@query(
    "load_sector_csv",
    """SELECT n_name AS sector_name, s_name AS symbol_id, CASE WHEN s_acctbal > 0 THEN 'HOSE' ELSE 'HNX' END AS market_name
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def load_sector_csv(t: Inputs) -> DataFrame:
    """Sector rows exported to CSV under the crawler's header and loaded from there."""
    named = t.table("supplier").join(t.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    crawled = named.select(
        F.col("s_suppkey").alias("NO"), F.concat(F.lit(" "), "s_name").alias("Symbol"),
        F.concat("s_name", F.lit(", Inc. \"A\"")).alias("Name"), F.concat("n_name", F.lit("  ")).alias("Sector"),
        F.when(F.col("s_acctbal") > 0, "HOSE").otherwise("HNX").alias("Market"),
    )
    path = write_csv(crawled, scratch_path(t.spark, "sectors"))
    return responses.load_sectors(
        read_csv(t.spark, path, "NO string, Symbol string, Name string, Sector string, Market string")
    )


@query("csv_export", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def csv_export(t: Inputs) -> DataFrame:
    rows = t.table("part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    path = write_csv(rows, scratch_path(t.spark, "parts"))
    return read_csv(t.spark, path, "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double")


@query("table_replace", "SELECT s_suppkey, upper(s_name) AS s_name FROM supplier")
def table_replace(t: Inputs) -> DataFrame:
    """A table overwritten by rows computed from itself."""
    path, schema = scratch_path(t.spark, "suppliers"), "s_suppkey bigint, s_name string"
    t.table("supplier").select("s_suppkey", "s_name").write.parquet(path)
    replace_table(read_table(t.spark, path, schema).withColumn("s_name", F.upper("s_name")), path)
    return read_table(t.spark, path, schema)
