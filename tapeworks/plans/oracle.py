"""SQL forms of the inputs, shared by the oracle queries."""

from __future__ import annotations

CLOCK = "printf('%02d:%02d:%02d', {0} // 3600, ({0} // 60) % 60, {0} % 60)"
CLOCK_KEY = "(({0} // 3600) * 10000 + (({0} // 60) % 60) * 100 + {0} % 60)::INT"


def day_key(column: str) -> str:
    return f"strftime({column}, '%Y%m%d')::INT"


def day_text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


TRADE = f"""
priced AS (
  SELECT *, (2 * round(l_extendedprice * 100)::BIGINT + l_quantity::BIGINT) // (2 * l_quantity::BIGINT) AS px,
    (l_orderkey * 60 + l_linenumber) % 86400 AS sod
  FROM lineitem),
trade AS (
  SELECT 'X' AS rtype, l_shipdate::DATE AS trading_date, {CLOCK.format('sod')} AS time,
    {CLOCK_KEY.format('sod')} AS tk, 'VN' || l_partkey AS isin, l_suppkey::VARCHAR AS symbol,
    (px + 700) / 100 AS ceiling, (px - 700) / 100 AS floor, (px - 10 * l_linenumber) / 100 AS ref_price,
    (px + l_linenumber) / 100 AS avg_price, (px - 5) / 100 AS prior_val, px / 100 AS last_price,
    l_quantity AS last_vol, l_extendedprice AS total_val, l_quantity * 10 AS total_vol, 'M1' AS market_id,
    l_linestatus AS exchange, l_returnflag AS trading_session, 'N' AS trading_status, l_tax AS change,
    l_discount AS ratio_change, px / 100 AS est_matched_price, (px + 50) / 100 AS highest,
    (px - 50) / 100 AS lowest, CASE WHEN l_linenumber % 2 = 0 THEN 'B' ELSE 'S' END AS side
  FROM priced)"""

_ASKS = ", ".join(f"(px + {n - 1}) / 100 AS ask_price{n}, (k + {n})::DOUBLE AS ask_vol{n}" for n in range(1, 11))
_BIDS = ", ".join(f"(px - {n}) / 100 AS bid_price{n}, (k + {2 * n})::DOUBLE AS bid_vol{n}" for n in range(1, 11))
QUOTE = f"""
quoted AS (
  SELECT *, round(value * 100)::BIGINT AS px, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
quote AS (
  SELECT ts::DATE AS trading_date, strftime(ts, '%H:%M:%S') AS time, strftime(ts, '%H%M%S')::INT AS tk,
    CASE WHEN event_type IN ('view', 'click') THEN 'O' WHEN event_type = 'signup' THEN 'F'
      ELSE upper(event_type) END AS exchange,
    user_id::VARCHAR AS symbol_id, 'Q' AS rtype,
    CASE event_type WHEN 'purchase' THEN 'A' WHEN 'view' THEN 'R' ELSE 'N' END AS trading_session,
    {_ASKS}, {_BIDS}
  FROM quoted)"""

INDEX = f"""
priced_index AS (SELECT *, round(o_totalprice * 100)::BIGINT AS c, (o_orderkey * 37) % 86400 AS sod FROM orders),
index_value AS (
  SELECT substr(o_orderpriority, 1, 1) AS index_id, o_totalprice AS index_value, (c - 100) / 100 AS prior_index_value,
    o_orderdate::DATE AS trading_date, {CLOCK.format('sod')} AS time, {CLOCK_KEY.format('sod')} AS tk,
    o_custkey::DOUBLE AS total_trade, o_custkey::DOUBLE AS total_qtty, (c * 2) / 100 AS total_value,
    o_orderpriority AS index_name, (o_orderkey % 50)::DOUBLE AS advances, (o_orderkey % 7)::INT AS nochanges,
    (o_orderkey % 11)::INT AS declines, (o_orderkey % 3)::INT AS ceilings, (o_orderkey % 5)::INT AS floors,
    (c % 300) / 100 AS change, (c % 70) / 100 AS ratio_change, (o_custkey % 97)::DOUBLE AS total_qtty_pt,
    (c % 10007) / 100 AS total_value_pt, o_orderstatus AS exchange, (o_custkey * 2)::DOUBLE AS all_qtty,
    (c * 3) / 100 AS all_value, 'Main' AS index_type,
    CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'Z' END AS trading_session,
    'M1' AS market_id, 'MI' AS rtype, (o_orderkey % 13)::DOUBLE AS total_qtty_od, (c % 501) / 100 AS total_value_od
  FROM priced_index)"""


def numbered(members: str, name: str, key: str) -> str:
    """Members with the surrogate keys of a first load."""
    return f"SELECT row_number() OVER (ORDER BY md5({name}), {name}) AS {key}, * FROM ({members}) AS m"


DIMS = f"""
dim_date AS (SELECT DISTINCT l_shipdate::DATE AS tradingdate, {day_key('l_shipdate')} AS tradingdate_key
  FROM lineitem WHERE l_shipdate IS NOT NULL),
dim_time AS (SELECT DISTINCT strftime(ts, '%H%M%S')::INT AS time_key, strftime(ts, '%H:%M:%S') AS time_hh_mm_ss FROM events),
dim_exchange AS ({numbered("SELECT DISTINCT o_orderstatus AS exchange_name FROM orders", "exchange_name", "exchange_key")}),
dim_index AS ({numbered("SELECT DISTINCT o_orderpriority AS index_name FROM orders", "index_name", "index_key")}),
dim_session AS ({numbered("SELECT DISTINCT l_returnflag AS trading_session FROM lineitem", "trading_session",
                          "trading_session_key")}),
dim_symbol AS ({numbered('''SELECT s_suppkey::VARCHAR AS symbol, s_name AS symbol_name, upper(s_name) AS symbol_en_name,
  n_name AS sector FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey''', "symbol", "symbol_key")})"""

STAR_KEYS = day_key("trading_date") + " AS tradingdate_key, tk AS time_key, {entity}_key, exchange_key, trading_session_key"

FACT_TRADE = f"""
trade_star AS (
  SELECT {STAR_KEYS.format(entity='symbol')}, last_price, avg_price, ceiling, floor, ref_price, prior_val AS prio_val,
    last_vol, total_val, change, ratio_change, highest, lowest
  FROM trade JOIN dim_symbol USING (symbol) LEFT JOIN dim_exchange ON exchange_name = exchange
    LEFT JOIN dim_session ON dim_session.trading_session = trade.trading_session),
fact_trade AS (
  SELECT * FROM trade_star QUALIFY row_number() OVER (
    PARTITION BY tradingdate_key, time_key, symbol_key, last_vol, total_val
    ORDER BY exchange_key NULLS FIRST, trading_session_key NULLS FIRST, last_price, avg_price, ceiling, floor,
      ref_price, prio_val, change, ratio_change, highest, lowest) = 1)"""

_BOOK = ", ".join(f"{side}_price{n}, {side}_vol{n}" for side in ("ask", "bid") for n in (1, 2, 3))
FACT_QUOTE = f"""
quote_star AS (
  SELECT {STAR_KEYS.format(entity='symbol')}, {_BOOK}
  FROM quote JOIN dim_symbol ON symbol = symbol_id LEFT JOIN dim_exchange ON exchange_name = exchange
    LEFT JOIN dim_session ON dim_session.trading_session = quote.trading_session),
fact_quote AS (
  SELECT * FROM quote_star QUALIFY row_number() OVER (
    PARTITION BY tradingdate_key, time_key, symbol_key, ask_price1, ask_vol1
    ORDER BY exchange_key NULLS FIRST, trading_session_key NULLS FIRST, ask_price2, ask_vol2, ask_price3, ask_vol3,
      bid_price1, bid_vol1, bid_price2, bid_vol2, bid_price3, bid_vol3) = 1)"""

INDEX_MEASURES = """index_value.index_value, prior_index_value AS prio_index_value, change, ratio_change, total_qtty,
    total_value, total_qtty_pt, total_value_pt, advances, nochanges, declines, ceilings, floors"""
INDEX_JOINS = """index_value LEFT JOIN dim_index ON dim_index.index_name = index_value.index_name
    LEFT JOIN dim_exchange ON exchange_name = exchange
    LEFT JOIN dim_session ON dim_session.trading_session = index_value.trading_session"""
FACT_INDEX = f"""
fact_market_index AS (
  SELECT DISTINCT {STAR_KEYS.format(entity='index')}, {INDEX_MEASURES} FROM {INDEX_JOINS})"""

TICK = """
tick AS (
  SELECT event_type AS symbol, ts, value AS price, json_extract_string(props, '$.k')::DOUBLE AS volume, event_id
  FROM events)"""

SERIES = """
series AS (
  SELECT symbol, trading_date AS tradingdate, s.last_price AS last_price, s.avg_price AS avg_price,
    s.ref_price AS ref_price, total_val, s.change AS change, s.ratio_change AS ratio_change, highest, lowest
  FROM (
    SELECT symbol, trading_date, sum(total_val) AS total_val, max(highest) AS highest, min(lowest) AS lowest,
      max({'at': tk, 'last_price': last_price, 'avg_price': avg_price, 'ref_price': ref_price, 'change': change,
        'ratio_change': ratio_change}) AS s
    FROM trade GROUP BY symbol, trading_date) AS days)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"
