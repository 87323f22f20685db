"""The test tables, and the market tables and messages that are read out of them.

``lineitem`` plays the trades, ``events`` the quotes and ticks, ``orders`` the index values,
``supplier`` and ``nation`` the corporations and sectors. Prices are computed in whole cents.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.numbers import rounded
from tapeworks.functions.times import clock_text
from tapeworks.operators.merge import surrogate_keys
from tapeworks.operators.star import date_members, name_members, symbol_members, time_members
from tapeworks.schemas import CHANNELS
from tapeworks.session import staged
from tapeworks.sources.files import spread

# The declared schemas of the test tables used.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
}


def cents(column: str) -> Column:
    return rounded(F.col(column) * 100, 0).cast("bigint")


def money(amount: Column) -> Column:
    """Whole cents to a price."""
    return amount / F.lit(100)


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))

    # Raw market tables

    def trades(self, dealt_out: bool = True, since: str | None = None, before: str | None = None) -> DataFrame:
        """Trades; ``dealt_out`` where heavy work per row follows, not for the scan of a column.

        ``since`` and ``before`` bound the date by the stored column, so that the scan can skip rows.
        """
        quantity = F.col("l_quantity").cast("bigint")
        rows, day = self.table("lineitem"), F.col("l_shipdate")
        if since:
            rows = rows.where(day >= F.lit(since).cast("timestamp_ntz"))
        if before:
            rows = rows.where(day < F.lit(before).cast("timestamp_ntz"))
        rows = spread(rows) if dealt_out else rows
        rows = rows.withColumn("_total", cents("l_extendedprice")).withColumns(
            {
                "_px": F.expr("(2 * _total + cast(l_quantity as bigint)) div (2 * cast(l_quantity as bigint))"),
                "_at": (F.col("l_orderkey") * 60 + F.col("l_linenumber")) % 86400,
            }
        )
        px, line = F.col("_px"), F.col("l_linenumber")
        return rows.select(
            F.lit("X").alias("rtype"),
            F.col("l_shipdate").cast("date").alias("trading_date"),
            clock_text(F.col("_at")).alias("time"),
            F.concat(F.lit("VN"), F.col("l_partkey").cast("string")).alias("isin"),
            F.rpad(F.col("l_suppkey").cast("string"), 10, " ").alias("symbol"),
            money(px + 700).alias("ceiling"),
            money(px - 700).alias("floor"),
            money(px - 10 * line).alias("ref_price"),
            money(px + line).alias("avg_price"),
            money(px - 5).alias("prior_val"),
            money(px).alias("last_price"),
            F.col("l_quantity").alias("last_vol"),
            F.col("l_extendedprice").alias("total_val"),
            (quantity * 10).cast("double").alias("total_vol"),
            F.lit("M1").alias("market_id"),
            F.rpad("l_linestatus", 5, " ").alias("exchange"),
            F.rpad("l_returnflag", 5, " ").alias("trading_session"),
            F.lit("N").alias("trading_status"),
            F.col("l_tax").alias("change"),
            F.col("l_discount").alias("ratio_change"),
            money(px).alias("est_matched_price"),
            money(px + 50).alias("highest"),
            money(px - 50).alias("lowest"),
            F.when(line % 2 == 0, "B").otherwise("S").alias("side"),
        )

    def quotes(self) -> DataFrame:
        rows = self.table("events").withColumns(
            {"_px": cents("value"), "_k": F.get_json_object("props", "$.k").cast("bigint")}
        )
        px, k, kind = F.col("_px"), F.col("_k"), F.col("event_type")
        book = []
        for n in range(1, 11):
            book += [money(px + (n - 1)).alias(f"ask_price{n}"), (k + n).cast("double").alias(f"ask_vol{n}")]
        for n in range(1, 11):
            book += [money(px - n).alias(f"bid_price{n}"), (k + 2 * n).cast("double").alias(f"bid_vol{n}")]
        return rows.select(
            F.col("ts").cast("date").alias("trading_date"),
            F.date_format("ts", "HH:mm:ss").alias("time"),
            F.when(kind.isin("view", "click"), "O").when(kind == "signup", "F").otherwise(F.upper(kind)).alias("exchange"),
            F.rpad(F.col("user_id").cast("string"), 10, " ").alias("symbol_id"),
            F.lit("Q").alias("rtype"),
            F.when(kind == "purchase", "A").when(kind == "view", "R").otherwise("N").alias("trading_session"),
            *book,
        )

    def index_values(self) -> DataFrame:
        rows = self.table("orders").withColumn("_c", cents("o_totalprice"))
        c, key, status = F.col("_c"), F.col("o_orderkey"), F.col("o_orderstatus")
        value = {
            "index_id": F.substring("o_orderpriority", 1, 1),
            "index_value": F.col("o_totalprice"),
            "prior_index_value": money(c - 100),
            "trading_date": F.col("o_orderdate").cast("date"),
            "time": clock_text((key * 37) % 86400),
            "total_trade": F.col("o_custkey").cast("double"),
            "total_qtty": F.col("o_custkey").cast("double"),
            "total_value": money(c * 2),
            "index_name": F.rpad("o_orderpriority", 20, " "),
            "advances": (key % 50).cast("double"),
            "nochanges": (key % 7).cast("int"),
            "declines": (key % 11).cast("int"),
            "ceilings": (key % 3).cast("int"),
            "floors": (key % 5).cast("int"),
            "change": money(c % 300),
            "ratio_change": money(c % 70),
            "total_qtty_pt": (F.col("o_custkey") % 97).cast("double"),
            "total_value_pt": money(c % 10007),
            "exchange": F.rpad(status, 5, " "),
            "all_qtty": (F.col("o_custkey") * 2).cast("double"),
            "all_value": money(c * 3),
            "index_type": F.lit("Main"),
            "trading_session": F.when(status == "F", "A").when(status == "O", "N").otherwise("Z"),
            "market_id": F.lit("M1"),
            "rtype": F.lit("MI"),
            "total_qtty_od": (key % 13).cast("double"),
            "total_value_od": money(c % 501),
        }
        return rows.select(*[value[column].alias(column) for _, column, _ in CHANNELS["index"]])

    def foreign_room(self) -> DataFrame:
        c, key = cents("o_totalprice"), F.col("o_orderkey")
        return self.table("orders").select(
            F.lit("R").alias("rtype"),
            F.col("o_orderdate").cast("date").alias("trading_date"),
            clock_text((key * 37) % 86400).alias("time"),
            F.concat(F.lit("VN"), key.cast("string")).alias("isin"),
            F.col("o_custkey").cast("string").alias("symbol"),
            F.col("o_totalprice").alias("total_room"),
            money(c - 100).alias("current_room"),
            (key % 19).cast("double").alias("buy_vol"),
            (key % 23).cast("double").alias("sell_vol"),
            money(c % 1009).alias("buy_val"),
            money(c % 2003).alias("sell_val"),
            F.col("o_orderstatus").alias("market_id"),
            F.col("o_orderpriority").alias("exchange"),
        )

    def security_status(self) -> DataFrame:
        return self.table("events").select(
            F.lit("F").alias("rtype"),
            F.lit("M1").alias("market_id"),
            F.col("ts").cast("date").alias("trading_date"),
            F.date_format("ts", "HH:mm:ss").alias("time"),
            F.col("user_id").cast("string").alias("symbol_id"),
            F.upper("event_type").alias("trading_session"),
            F.when(F.col("value") > 50, "A").otherwise("H").alias("trading_status"),
            F.substring("event_type", 1, 2).alias("exchange"),
            F.lit("OL").alias("trading_ol_session"),
        )

    def corporations(self) -> DataFrame:
        return self.table("supplier").select(
            F.rpad(F.col("s_suppkey").cast("string"), 10, " ").alias("symbol_id"),
            F.col("s_nationkey").alias("sector_id"),
            F.col("s_name").alias("symbol_name"),
            F.upper("s_name").alias("symbol_en_name"),
        )

    def sectors(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias("sector_id"), F.col("n_name").alias("sector_name"))

    # Ticks and messages

    def ticks(self) -> DataFrame:
        return self.as_ticks(self.table("events"))

    @staticmethod
    def as_ticks(events: DataFrame) -> DataFrame:
        """Event rows as ticks; used on the table and on its stream."""
        return events.select(
            F.col("event_type").alias("symbol"),
            F.col("ts").cast("timestamp").alias("event_ts"),
            F.col("value").alias("price"),
            F.get_json_object("props", "$.k").cast("double").alias("volume"),
            "event_id",
        )

    def event_stream(self) -> DataFrame:
        # a glob serves a single file as well as a folder of files
        return self.spark.readStream.schema(SCHEMAS["events"]).parquet(f"{self.sf_dir}/{{events}}.parquet")

    # Dimensions, written as tables the way the warehouse holds them

    def members(self, name: str) -> DataFrame:
        if name == "dim_date":
            return date_members(self.trades(dealt_out=False))
        if name == "dim_time":
            return time_members(self.quotes())
        if name == "dim_symbol":
            return surrogate_keys(symbol_members(self.corporations(), self.sectors()), "symbol", "symbol_key")
        source, column, member, key = {
            "dim_exchange": (self.index_values, "exchange", "exchange_name", "exchange_key"),
            "dim_index": (self.index_values, "index_name", "index_name", "index_key"),
            "dim_session": (
                lambda: self.trades(dealt_out=False), "trading_session", "trading_session", "trading_session_key"
            ),
        }[name]
        return surrogate_keys(name_members(source(), column, member), member, key)

    def dims(self, *names: str) -> dict[str, DataFrame]:
        """The named dimensions; the writes are independent and run side by side."""
        with ThreadPoolExecutor(len(names)) as pool:
            return dict(zip(names, pool.map(lambda name: staged(self.members(name), name), names)))


def envelopes(rows: DataFrame, channel: str, *beside: str) -> DataFrame:
    """Raw rows as the messages they would have arrived in, with the columns ``beside``."""
    inner = [
        (F.date_format(column, "dd/MM/yyyy") if kind == "date" else F.col(column)).alias(wire)
        for wire, column, kind in CHANNELS[channel]
    ]
    content = F.to_json(F.struct(*inner)).alias("Content")
    return rows.select(F.to_json(F.struct(content)).alias("value"), *beside)
