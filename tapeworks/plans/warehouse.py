"""Queries: dimensions, facts, de-duplication and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.etl import JOBS, load_facts
from tapeworks.functions.text import row_hash
from tapeworks.functions.times import clock_key, date_key
from tapeworks.operators import merge, star
from tapeworks.operators.joins import lookup
from tapeworks.plans import oracle as o
from tapeworks.plans.catalog import query
from tapeworks.plans.inputs import Inputs
from tapeworks.runs import RunBroken, run_jobs
from tapeworks.schemas import NATURAL_KEYS
from tapeworks.session import scratch_path, staged
from tapeworks.sources.bucketed import BucketedStore
from tapeworks.sources.responses import index_list_rows
from tapeworks.sources.stores import ParquetStore

CUTOFF = "1998-01-01"
CUTOFF_KEY = 19980101
TRADE_DIMS = ["dim_date", "dim_time", "dim_symbol", "dim_exchange", "dim_session"]
FACT_DIMS = ["dim_symbol", "dim_exchange", "dim_session"]
INDEX_DIMS = ["dim_date", "dim_time", "dim_index", "dim_exchange", "dim_session"]
TRADE_SQL = o.with_(o.TRADE, o.DIMS, o.FACT_TRADE)


# Dimensions


@query(
    "dim_date",
    f"""SELECT DISTINCT {o.day_key('d')} AS tradingdate_key, {o.day_text('d')} AS tradingdate, year(d)::INT AS year,
  quarter(d)::INT AS quarter, month(d)::INT AS month, day(d)::INT AS day, (dayofweek(d) + 1)::INT AS weekday
FROM (SELECT l_shipdate AS d FROM lineitem WHERE l_shipdate IS NOT NULL) AS x""",
)
def dim_date(t: Inputs) -> DataFrame:
    return t.members("dim_date")


@query(
    "dim_time",
    """SELECT DISTINCT strftime(ts, '%H%M%S')::INT AS time_key, strftime(ts, '%H:%M:%S') AS time_hh_mm_ss,
  hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second FROM events""",
)
def dim_time(t: Inputs) -> DataFrame:
    return t.members("dim_time")


@query("dim_exchange", o.with_(o.DIMS) + "SELECT exchange_key, exchange_name FROM dim_exchange")
def dim_exchange(t: Inputs) -> DataFrame:
    return t.members("dim_exchange")


@query("dim_index", o.with_(o.DIMS) + "SELECT index_key, index_name FROM dim_index")
def dim_index(t: Inputs) -> DataFrame:
    return t.members("dim_index")


@query("dim_session", o.with_(o.DIMS) + "SELECT trading_session_key, trading_session FROM dim_session")
def dim_session(t: Inputs) -> DataFrame:
    return t.members("dim_session")


@query("dim_symbol", o.with_(o.DIMS) + "SELECT symbol_key, symbol, symbol_name, symbol_en_name, sector FROM dim_symbol")
def dim_symbol(t: Inputs) -> DataFrame:
    return t.members("dim_symbol")


@query(
    "dim_new_members",
    f"""SELECT DISTINCT {o.day_key('o_orderdate')} AS tradingdate_key, {o.day_text('o_orderdate')} AS tradingdate FROM orders
WHERE o_orderdate NOT IN (SELECT l_shipdate FROM lineitem)""",
)
def dim_new_members(t: Inputs) -> DataFrame:
    """Days of index values that the date dimension, fed by trades, does not hold."""
    candidates = star.date_members(t.index_values())
    fresh = star.new_members(candidates, t.members("dim_date"), NATURAL_KEYS["dim_date"])
    return fresh.select("tradingdate_key", "tradingdate")


@query(
    "surrogate_keys",
    """WITH s AS (SELECT s_suppkey::VARCHAR AS symbol, s_nationkey < 12 AS old FROM supplier),
kept AS (SELECT row_number() OVER (ORDER BY md5(symbol), symbol) AS symbol_key, symbol FROM s WHERE old)
SELECT symbol_key, symbol FROM kept UNION ALL
SELECT row_number() OVER (ORDER BY md5(symbol), symbol) + (SELECT coalesce(max(symbol_key), 0) FROM kept) AS symbol_key, symbol
FROM s WHERE NOT old""",
)
def surrogate_key_query(t: Inputs) -> DataFrame:
    """The symbol dimension after a first load of some sectors and a second load of all."""
    everyone = t.corporations().select(F.trim("symbol_id").alias("symbol"), "sector_id")
    first = everyone.where("sector_id < 12").select("symbol")
    stored = staged(merge.surrogate_keys(first, "symbol", "symbol_key"), "dim_symbol")
    return stored.unionByName(star.number_members(everyone.select("symbol"), stored, "symbol", "symbol_key"))


# Facts


@query(
    "star_left_lookup",
    o.with_(o.TRADE, o.DIMS)
    + """SELECT symbol, tradingdate_key, time_key, last_price, last_vol
FROM trade LEFT JOIN dim_date ON tradingdate = trading_date LEFT JOIN dim_time ON time_key = tk""",
)
def star_left_lookup(t: Inputs) -> DataFrame:
    rows = t.trades().select(
        F.trim("symbol").alias("symbol"),
        date_key(F.col("trading_date")).alias("_date_key"),
        clock_key(F.col("time")).alias("_time_key"),
        "last_price", "last_vol",
    )
    return star.star_lookup(rows, t.dims("dim_date", "dim_time"), [star.DATE, star.TIME])


@query(
    "symbol_inner_lookup",
    o.with_(o.QUOTE, o.DIMS)
    + "SELECT symbol_key, symbol_name, time, ask_price1, bid_price1 FROM quote JOIN dim_symbol ON symbol = symbol_id",
)
def symbol_inner_lookup(t: Inputs) -> DataFrame:
    rows = t.quotes().select(F.trim("symbol_id").alias("_symbol"), "time", "ask_price1", "bid_price1")
    dim = t.dims("dim_symbol")["dim_symbol"]
    return lookup(rows, dim, {"_symbol": "symbol"}, ["symbol_key", "symbol_name"], "inner").drop("_symbol")


@query("fact_trade", TRADE_SQL + "SELECT * FROM fact_trade")
def fact_trade(t: Inputs) -> DataFrame:
    return star.trade_facts(t.trades(), t.dims(*FACT_DIMS))


@query("fact_quote", o.with_(o.QUOTE, o.DIMS, o.FACT_QUOTE) + "SELECT * FROM fact_quote")
def fact_quote(t: Inputs) -> DataFrame:
    return star.quote_facts(t.quotes(), t.dims(*FACT_DIMS))


@query("fact_market_index", o.with_(o.INDEX, o.DIMS, o.FACT_INDEX) + "SELECT * FROM fact_market_index")
def fact_market_index(t: Inputs) -> DataFrame:
    return star.index_facts(t.index_values(), t.dims("dim_index", "dim_exchange", "dim_session"))


def _date_keys(raw: DataFrame) -> DataFrame:
    """The date keys of a raw batch."""
    return star.dated(raw).select(date_key(F.col("trading_date")).alias("tradingdate_key"))


def _fresh_trades(t: Inputs) -> DataFrame:
    """Facts of all trades against a warehouse that holds the trades before the cutoff."""
    trades, dims = t.trades(), t.dims(*FACT_DIMS)
    stored = star.trade_facts(t.trades(before=CUTOFF), dims)
    dates = _date_keys(t.trades(dealt_out=False))
    return star.new_rows(star.trade_facts(trades, dims), stored, NATURAL_KEYS["fact_trade"], dates, star.MEET["fact_trade"])


@query("fact_new_rows", TRADE_SQL + f"SELECT * FROM fact_trade WHERE tradingdate_key >= {CUTOFF_KEY}")
def fact_new_rows(t: Inputs) -> DataFrame:
    return _fresh_trades(t)


@query(
    "new_rows_per_day",
    TRADE_SQL + f"""SELECT tradingdate_key, count(*) AS new_rows FROM fact_trade
WHERE tradingdate_key >= {CUTOFF_KEY} GROUP BY tradingdate_key""",
)
def new_rows_per_day(t: Inputs) -> DataFrame:
    return star.rows_per_day(_fresh_trades(t))


@query("incremental_by_date", TRADE_SQL + "SELECT * FROM fact_trade")
def incremental_by_date(t: Inputs) -> DataFrame:
    """The stored table after a load of early trades and a second load of all trades."""
    dims, warehouse = t.dims(*FACT_DIMS), ParquetStore(t.spark, scratch_path(t.spark, "warehouse"))
    for before in (CUTOFF, None):
        dates = _date_keys(t.trades(dealt_out=False, before=before))
        load_facts("fact_trade", star.trade_facts(t.trades(before=before), dims), dates, warehouse)
    return warehouse.read("fact_trade")


@query("incremental_in_buckets", TRADE_SQL + "SELECT * FROM fact_trade")
def incremental_in_buckets(t: Inputs) -> DataFrame:
    """As ``incremental_by_date``, into a table in buckets of the natural key; the second load leaves stored rows in place."""
    dims, root = t.dims(*FACT_DIMS), scratch_path(t.spark, "buckets")
    warehouse = BucketedStore(t.spark, root, "w" + root.rpartition("-")[2], buckets=8)
    for before in (CUTOFF, None):
        dates = _date_keys(t.trades(dealt_out=False, before=before))
        load_facts("fact_trade", star.trade_facts(t.trades(before=before), dims), dates, warehouse)
    return warehouse.read("fact_trade")


@query("late_time_members", TRADE_SQL + """SELECT fact_trade.*, dim_time.time_key IS NOT NULL AS time_known
FROM fact_trade LEFT JOIN dim_time USING (time_key)""")
def late_time_members(t: Inputs) -> DataFrame:
    """All trades loaded before and after half of the time dimension arrives: one row per trade, known times marked."""
    source, warehouse = (ParquetStore(t.spark, scratch_path(t.spark, name)) for name in ("source", "warehouse"))
    dims = t.dims(*FACT_DIMS, "dim_time")
    for name in FACT_DIMS:
        warehouse.append(name, dims[name])
    source.append("raw_trade", t.trades())
    for part in (0, 1):
        warehouse.append("dim_time", dims["dim_time"].where(F.col("time_key") % 2 == part))
        JOBS["fact_trade"](source, warehouse)
    known = warehouse.read("dim_time").select("time_key", F.lit(True).alias("_known"))
    facts = lookup(warehouse.read("fact_trade"), known, {"time_key": "time_key"}, ["_known"])
    return facts.withColumn("time_known", F.col("_known").isNotNull()).drop("_known")


class _BrokenOff(Exception):
    """The process ends after the rows were stored and before the log."""


def _breaks_off(source: ParquetStore, warehouse: ParquetStore) -> int:
    JOBS["fact_trade"](source, warehouse)
    raise _BrokenOff


@query("resumed_run", TRADE_SQL + "SELECT * FROM fact_trade")
def resumed_run(t: Inputs) -> DataFrame:
    """The facts after a run of jobs that broke off when they were stored, and was started again.

    No other failure passes: neither of another job or kind in the first run, nor any in the second.
    """
    source, warehouse = (ParquetStore(t.spark, scratch_path(t.spark, name)) for name in ("source", "warehouse"))
    log, wanted = scratch_path(t.spark, "run-log"), [*FACT_DIMS, "dim_date", "fact_trade"]
    source.append("raw_trade", t.trades())
    source.append("raw_index", t.index_values())
    source.append("corporation", t.corporations())
    source.append("corporation_sector", t.sectors())
    try:
        run_jobs(t.spark, source, warehouse, log, "day", wanted, jobs=JOBS | {"fact_trade": _breaks_off})
    except RunBroken as broken:
        if [type(error) for error in broken.errors.values()] != [_BrokenOff]:
            raise
    run_jobs(t.spark, source, warehouse, log, "day", wanted)
    return warehouse.read("fact_trade")


@query("batch_dates", f"SELECT DISTINCT {o.day_key('ts')} AS tradingdate_key FROM events")
def batch_dates(t: Inputs) -> DataFrame:
    """The date keys of a whole batch."""
    return _date_keys(t.quotes()).distinct()


@query(
    "fk_orphans",
    TRADE_SQL
    + "\nUNION ALL ".join(
        f"SELECT '{dim}' AS dimension, count(*) FILTER ({key} IS NULL) AS null_keys,"
        f" count(*) FILTER ({key} IS NOT NULL AND {key} NOT IN (SELECT {key} FROM {dim}{kept})) AS orphan_keys"
        " FROM fact_trade"
        for dim, key, kept in [
            ("dim_date", "tradingdate_key", f" WHERE tradingdate_key < {CUTOFF_KEY}"),
            ("dim_time", "time_key", ""),
            ("dim_symbol", "symbol_key", " WHERE sector <> 'NATION_3'"),
            ("dim_exchange", "exchange_key", ""),
            ("dim_session", "trading_session_key", ""),
        ]
    ),
)
def fk_orphans(t: Inputs) -> DataFrame:
    """Integrity of the trade facts against dimensions that have lost some members."""
    dims = t.dims(*TRADE_DIMS)
    facts = star.trade_facts(t.trades(), dims)
    damaged = dims | {
        "dim_date": dims["dim_date"].where(F.col("tradingdate_key") < CUTOFF_KEY),
        "dim_symbol": dims["dim_symbol"].where("sector <> 'NATION_3'"),
    }
    return star.fk_report(facts, damaged, [star.DATE, star.TIME, star.SYMBOL, star.EXCHANGE, star.SESSION])


@query(
    "index_wide",
    o.with_(o.INDEX, o.DIMS)
    + f"""SELECT DISTINCT {o.day_text('tradingdate')} AS tradingdate, time_hh_mm_ss, dim_index.index_name,
  {o.INDEX_MEASURES}, exchange_key, trading_session_key FROM {o.INDEX_JOINS}
  LEFT JOIN dim_date ON tradingdate = trading_date LEFT JOIN dim_time ON time_key = tk""",
)
def index_wide(t: Inputs) -> DataFrame:
    return star.index_rows(t.index_values(), t.dims(*INDEX_DIMS))


@query(
    "feature_data",
    TRADE_SQL
    + f"""SELECT symbol, {o.day_text('tradingdate')} AS tradingdate, last_price, avg_price, ref_price, total_val, change,
  ratio_change, highest, lowest
FROM fact_trade LEFT JOIN dim_symbol USING (symbol_key) LEFT JOIN dim_date USING (tradingdate_key)""",
)
def feature_data(t: Inputs) -> DataFrame:
    dims = t.dims(*TRADE_DIMS)
    return star.feature_rows(star.trade_facts(t.trades(), dims), dims)


# De-duplication and hashes

DEDUPE_COLUMNS = ["symbol", "trading_date", "time", "last_vol", "total_val", "last_price", "avg_price", "change",
                  "ratio_change", "exchange", "trading_session"]


def _trade_rows(t: Inputs) -> DataFrame:
    names = {"symbol", "exchange", "trading_session"}
    return t.trades().select(*[F.trim(c).alias(c) if c in names else F.col(c) for c in DEDUPE_COLUMNS])


_DEDUPE_SQL = ", ".join(o.day_text(c) + f" AS {c}" if c == "trading_date" else c for c in DEDUPE_COLUMNS)


@query(
    "dedupe_by_key",
    o.with_(o.TRADE)
    + f"""SELECT {_DEDUPE_SQL} FROM trade QUALIFY row_number() OVER (
  PARTITION BY trade.trading_date, time, symbol, last_vol, total_val
  ORDER BY last_price, avg_price, change, ratio_change, exchange, trade.trading_session) = 1""",
)
def dedupe_by_key(t: Inputs) -> DataFrame:
    return merge.first_by_key(_trade_rows(t), ["trading_date", "time", "symbol", "last_vol", "total_val"])


@query("dedupe_by_hash", o.with_(o.TRADE) + f"SELECT DISTINCT {_DEDUPE_SQL} FROM trade")
def dedupe_by_hash(t: Inputs) -> DataFrame:
    return merge.distinct_by_hash(_trade_rows(t))


@query(
    "row_hash",
    """SELECT o_orderkey, md5(concat_ws('||', o_orderkey::VARCHAR, coalesce(nullif(o_orderstatus, 'P'), '∅'),
  o_orderpriority, o_custkey::VARCHAR)) AS row_hash FROM orders""",
)
def row_hash_query(t: Inputs) -> DataFrame:
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return t.table("orders").select(
        "o_orderkey", row_hash([F.col("o_orderkey"), status, F.col("o_orderpriority"), F.col("o_custkey")]).alias("row_hash")
    )


@query("hash128", "SELECT page_id, md5(html) AS digest FROM pages")
def hash128(t: Inputs) -> DataFrame:
    return t.table("pages").select("page_id", F.md5("html").alias("digest"))


# Merges on a key


def _securities(t: Inputs, nations: str) -> DataFrame:
    return t.table("customer").where(nations).select(
        F.col("c_custkey").cast("string").alias("symbol_id"), F.col("c_name").alias("symbol_name")
    )


def _listed(t: Inputs) -> DataFrame:
    """Security records in order of arrival; a symbol can come many times."""
    return t.table("orders").select(
        F.col("o_custkey").cast("string").alias("symbol_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("symbol_name"),
        F.col("o_orderkey").alias("arrival"),
    )


_MERGE_SQL = """WITH old AS (SELECT c_custkey::VARCHAR AS symbol_id, c_name AS symbol_name FROM customer WHERE c_nationkey < 10),
batch AS (SELECT o_custkey::VARCHAR AS symbol_id, 'Order ' || o_orderkey AS symbol_name FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey {order}) = 1)
"""


@query(
    "insert_ignore",
    _MERGE_SQL.format(order="")
    + "SELECT * FROM old UNION ALL SELECT * FROM batch WHERE symbol_id NOT IN (SELECT symbol_id FROM old)",
)
def insert_ignore(t: Inputs) -> DataFrame:
    """The securities table after an insert that leaves known symbols alone."""
    stored = _securities(t, "c_nationkey < 10")
    return stored.unionByName(merge.insert_ignore(stored, _listed(t), "symbol_id", "arrival").drop("arrival"))


@query(
    "upsert_latest",
    _MERGE_SQL.format(order="DESC")
    + "SELECT * FROM batch UNION ALL SELECT * FROM old WHERE symbol_id NOT IN (SELECT symbol_id FROM batch)",
)
def upsert_latest(t: Inputs) -> DataFrame:
    return merge.upsert(_securities(t, "c_nationkey < 10"), _listed(t), "symbol_id", "arrival")


@query(
    "upsert_buckets",
    """WITH sent AS (SELECT o_custkey::VARCHAR AS code, o_orderkey AS k, o_orderkey % 3 AS part FROM orders)
SELECT code AS indexlist_id, 7 AS market_id, 'Order ' || k AS index_name, code AS index_code FROM sent
QUALIFY row_number() OVER (PARTITION BY code ORDER BY part DESC, k DESC) = 1""",
)
def upsert_buckets(t: Inputs) -> DataFrame:
    """A table kept in buckets of its key after three upserts; the last record of the last batch of each key."""
    store, code = ParquetStore(t.spark, scratch_path(t.spark, "warehouse")), F.col("o_custkey").cast("string")
    rows = t.table("orders").select(
        code.alias("indexlist_id"), F.lit(7).alias("market_id"), F.concat(F.lit("Order "), "o_orderkey").alias("index_name"),
        code.alias("index_code"), "o_orderkey",
    )
    for part in range(3):
        store.upsert("index_list", rows.where(F.col("o_orderkey") % 3 == part), "o_orderkey")
    return store.read("index_list")


@query(
    "resume_append",
    """SELECT c_custkey::VARCHAR AS symbol_id, CASE WHEN c_nationkey < 10 THEN c_name ELSE upper(c_name) END AS symbol_name
FROM customer""",
)
def resume_append(t: Inputs) -> DataFrame:
    """Rows of an earlier run followed by all rows collected again."""
    again = _securities(t, "true").withColumn("symbol_name", F.upper("symbol_name"))
    return merge.append_new(_securities(t, "c_nationkey < 10"), again, "symbol_id")


@query(
    "union_markets",
    """SELECT 'customer' AS market, c_custkey::VARCHAR AS symbol, c_name AS name, NULL::VARCHAR AS brand FROM customer
UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_name, NULL FROM supplier
UNION ALL SELECT 'part', p_partkey::VARCHAR, p_name, p_brand FROM part""",
)
def union_markets(t: Inputs) -> DataFrame:
    """Securities of three markets in one table; a column only one market has is NULL elsewhere."""
    parts = []
    for market, letter, key in [("customer", "c", "custkey"), ("supplier", "s", "suppkey"), ("part", "p", "partkey")]:
        extra = ["p_brand as brand"] if market == "part" else []
        parts.append(t.table(market).selectExpr(
            f"'{market}' as market", f"cast({letter}_{key} as string) as symbol", f"{letter}_name as name", *extra))
    customers, suppliers, goods = parts
    return customers.unionByName(suppliers).unionByName(goods, allowMissingColumns=True)


@query(
    "market_lookup",
    """SELECT n_nationkey AS market_id, c_custkey::VARCHAR AS indexlist_id, c_custkey::VARCHAR AS index_code,
  CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR ELSE c_name END AS index_name
FROM customer JOIN nation ON n_name = 'NATION_' || (c_nationkey + 3)
WHERE c_custkey % 10 <> 0""",
)
def market_lookup(t: Inputs) -> DataFrame:
    """Index list records with the id of their market; unknown markets and missing codes drop out."""
    code = F.when(F.col("c_custkey") % 10 != 0, F.concat(F.lit(" "), F.col("c_custkey").cast("string")))
    items = t.table("customer").select(
        F.concat(F.lit("NATION_"), (F.col("c_nationkey") + 3).cast("string"), F.lit("  ")).alias("Exchange"),
        code.alias("IndexCode"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("IndexName"),
    )
    markets = t.table("nation").select(F.trim("n_name").alias("market_name"), F.col("n_nationkey").alias("market_id"))
    found = lookup(index_list_rows(items), markets, {"exchange": "market_name"}, ["market_id"], "inner")
    return found.select("indexlist_id", "market_id", "index_name", "index_code")
