"""Queries: tables read back after the jobs that load landed reference data, each run twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.etl import JOBS
from tapeworks.plans import oracle as o
from tapeworks.plans.catalog import query
from tapeworks.plans.inputs import Inputs
from tapeworks.plans.rows import _as_text, _filled, _null_columns
from tapeworks.schemas import DAILY_INDEX, DAILY_PRICE, TABLES
from tapeworks.session import scratch_path
from tapeworks.sources.files import read_csv
from tapeworks.sources.stores import ParquetStore


def _loaded(t: Inputs, job: str, **landed: DataFrame) -> ParquetStore:
    """A store after two runs of ``job`` over the landed tables."""
    store = ParquetStore(t.spark, scratch_path(t.spark, job))
    for name, rows in landed.items():
        store.append(name, rows)
    for _ in range(2):
        JOBS[job](store, store)
    return store


def _exported(t: Inputs, job: str, rows: DataFrame) -> DataFrame:
    store = _loaded(t, job, **{f"landed_{job}": rows})
    return read_csv(t.spark, f"{store.root}/export/{job}", TABLES[f"landed_{job}"])


@query(
    "job_securities",
    """SELECT (c_custkey % 700)::VARCHAR AS symbol_id, c_name AS symbol_name, upper(c_name) AS symbol_en_name FROM customer
QUALIFY row_number() OVER (PARTITION BY c_custkey % 700 ORDER BY c_mktsegment, c_name) = 1""",
)
def job_securities(t: Inputs) -> DataFrame:
    """Securities of all markets; the first market of a symbol names it."""
    landed = t.table("customer").select(
        F.col("c_mktsegment").alias("market"),
        F.concat(F.lit(" "), (F.col("c_custkey") % 700).cast("string")).alias("Symbol"),
        F.col("c_name").alias("StockName"), F.upper("c_name").alias("StockEnName"),
    )
    return _loaded(t, "securities", landed_securities=landed).read("securities")


@query(
    "job_security_detail",
    """SELECT p_partkey::VARCHAR AS symbol_id,
  '{"Symbol":"' || p_partkey || '","Detail":' || coalesce('"' || p_brand || '"', 'null') || '}' AS detail_json FROM part""",
)
def job_security_detail(t: Inputs) -> DataFrame:
    landed = t.table("part").select(F.col("p_partkey").cast("string").alias("Symbol"), F.col("p_brand").alias("Detail"))
    return _loaded(t, "security_detail", landed_security_details=landed).read("security_detail")


@query(
    "job_index_list",
    """SELECT o_custkey::VARCHAR AS indexlist_id, n_nationkey AS market_id, 'Index ' || o_orderkey AS index_name,
  o_custkey::VARCHAR AS index_code
FROM orders JOIN nation ON n_name = 'NATION_' || (o_custkey % 30)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""",
)
def job_index_list(t: Inputs) -> DataFrame:
    """The last record of each index code; unknown markets drop out."""
    landed = t.table("orders").select(
        F.concat(F.lit("NATION_"), (F.col("o_custkey") % 30).cast("string"), F.lit(" ")).alias("Exchange"),
        F.col("o_custkey").cast("string").alias("IndexCode"),
        F.concat(F.lit("Index "), F.col("o_orderkey").cast("string")).alias("IndexName"),
        F.col("o_orderkey").alias("arrival"),
    )
    markets = t.table("nation").select(F.col("n_nationkey").alias("market_id"), F.col("n_name").alias("market_name"))
    return _loaded(t, "index_list", landed_index_list=landed, markets=markets).read("index_list")


@query(
    "job_sector",
    """SELECT n_name AS sector_name, s_name AS symbol_id, 'HOSE' AS market_name
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def job_sector(t: Inputs) -> DataFrame:
    named = t.table("supplier").join(t.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    landed = named.select(
        F.concat("n_name", F.lit(" ")).alias("Sector"), F.col("s_name").alias("Symbol"), F.lit("HOSE").alias("Market")
    )
    return _loaded(t, "sector", landed_sectors=landed).read("sector")


_NUMBERED = "(SELECT *, round(o_totalprice * 100)::BIGINT AS c, o_orderkey AS k FROM orders) AS x"


def _numbered(t: Inputs) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return t.table("orders").withColumns({"c": cents, "k": F.col("o_orderkey")})


def _landed_daily(t: Inputs, fields, code: str, **given) -> DataFrame:
    filled = {wire: F.expr(sql) for wire, sql in _filled(fields, {code, "TradingDate", *given}, True).items()}
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    return _as_text(_numbered(t), fields, {code: F.col("k"), "TradingDate": day, **filled, **given})


@query(
    "job_daily_index",
    "SELECT " + _null_columns(
        DAILY_INDEX, indexlist_id="k::VARCHAR", trading_date=o.day_text("o_orderdate"),
        **_filled(DAILY_INDEX, {"IndexId", "TradingDate"}, False),
    ) + f" FROM {_NUMBERED}",
)
def job_daily_index(t: Inputs) -> DataFrame:
    landed = _landed_daily(t, DAILY_INDEX, "IndexId")
    return _loaded(t, "daily_index", landed_daily_index=landed).read("daily_index")


@query(
    "job_daily_price",
    "SELECT " + _null_columns(
        DAILY_PRICE, symbol_id="k::VARCHAR", trading_date=o.day_text("o_orderdate"),
        **_filled(DAILY_PRICE, {"Symbol", "TradingDate"}, False),
    ) + f" FROM {_NUMBERED}",
)
def job_daily_price(t: Inputs) -> DataFrame:
    landed = _landed_daily(t, DAILY_PRICE, "Symbol")
    return _loaded(t, "daily_price", landed_daily_price=landed).read("daily_price")


@query(
    "job_index_components",
    """SELECT o_orderpriority AS "IndexCode", o_custkey::VARCHAR AS "StockSymbol", 'VN' || o_orderkey AS "Isin" FROM orders
WHERE o_orderkey % 5 <> 0""",
)
def job_index_components(t: Inputs) -> DataFrame:
    """Components of indices exported to CSV; records without a symbol are left out."""
    return _exported(t, "index_components", t.table("orders").select(
        F.col("o_orderpriority").alias("IndexCode"),
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).alias("StockSymbol"),
        F.concat(F.lit("VN"), F.col("o_orderkey").cast("string")).alias("Isin"),
    ))


def _bar_texts(*, time: bool) -> list:
    columns = [F.col("k").cast("string").alias("Symbol"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("TradingDate")]
    columns += [F.lit("09:00:00").alias("Time")] if time else []
    return columns + [(F.col("c") + i).cast("string").alias(name) for i, name in enumerate(_BAR_FIELDS)]


_BAR_FIELDS = ["Open", "High", "Low", "Close", "Volume", "Value"]
_BAR_SQL = ", ".join(f'(c + {i})::VARCHAR AS "{name}"' for i, name in enumerate(_BAR_FIELDS))
_BAR_KEYS = """k::VARCHAR AS "Symbol", strftime(o_orderdate, '%d/%m/%Y') AS "TradingDate\""""


@query("job_daily_bars", f"SELECT {_BAR_KEYS}, {_BAR_SQL} FROM {_NUMBERED}")
def job_daily_bars(t: Inputs) -> DataFrame:
    return _exported(t, "daily_bars", _numbered(t).select(*_bar_texts(time=False)))


@query("job_intraday_bars", f"SELECT {_BAR_KEYS}, '09:00:00' AS \"Time\", {_BAR_SQL} FROM {_NUMBERED}")
def job_intraday_bars(t: Inputs) -> DataFrame:
    return _exported(t, "intraday_bars", _numbered(t).select(*_bar_texts(time=True)))
