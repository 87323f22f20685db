"""Wire fields, table schemas and natural keys. Nothing in the library infers a schema."""

from __future__ import annotations

import re

KINDS = {
    "s": "string",
    "d": "double",
    "i": "int",
    "date": "date",
    "money": "decimal(18,2)",
    "key": "int",
    "id": "bigint",
}


def _column(wire_name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", wire_name).lower()


def wire_fields(text: str, **renamed: str) -> list[tuple[str, str, str]]:
    """``"RType s, Symbol s"`` to (wire name, column, Spark type) triples."""
    fields = []
    for item in text.split(","):
        name, kind = item.split()
        fields.append((name, renamed.get(name, _column(name)), KINDS[kind]))
    return fields


def table(text: str) -> str:
    """``"symbol s, volume d"`` to a DDL schema."""
    pairs = [item.split() for item in text.split(",")]
    return ", ".join(f"`{name}` {KINDS[kind]}" for name, kind in pairs)


def table_of(fields: list[tuple[str, str, str]]) -> str:
    """DDL schema of the columns of wire fields."""
    return ", ".join(f"`{column}` {kind}" for _, column, kind in fields)


def columns_of(schema: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a DDL schema made by ``table``."""
    return re.findall(r"`(\w+)` ([a-z]+(?:\(\d+,\d+\))?)", schema)


def book_levels(depth: int, text: str = "{side}Price{n} d, {side}Vol{n} d") -> str:
    return ", ".join(text.format(side=side, n=n) for side in ("Ask", "Bid") for n in range(1, depth + 1))


# Field names and order of the five market channels.
CHANNELS = {
    "trade": wire_fields(
        "RType s, TradingDate date, Time s, Isin s, Symbol s, Ceiling d, Floor d, RefPrice d, AvgPrice d,"
        "PriorVal d, LastPrice d, LastVol d, TotalVal d, TotalVol d, MarketId s, Exchange s, TradingSession s,"
        "TradingStatus s, Change d, RatioChange d, EstMatchedPrice d, Highest d, Lowest d, Side s",
        RType="rtype",
    ),
    "quote": wire_fields(
        "TradingDate date, Time s, Exchange s, Symbol s, RType s, TradingSession s," + book_levels(10),
        RType="rtype", Symbol="symbol_id",
    ),
    "foreign_room": wire_fields(
        "RType s, TradingDate date, Time s, Isin s, Symbol s, TotalRoom d, CurrentRoom d, BuyVol d, SellVol d,"
        "BuyVal d, SellVal d, MarketId s, Exchange s",
        RType="rtype",
    ),
    "index": wire_fields(
        "IndexId s, IndexValue d, PriorIndexValue d, TradingDate date, Time s, TotalTrade d, TotalQtty d,"
        "TotalValue d, IndexName s, Advances d, NoChanges i, Declines i, Ceilings i, Floors i, Change d,"
        "RatioChange d, TotalQttyPt d, TotalValuePt d, Exchange s, AllQty d, AllValue d, IndexType s,"
        "TradingSession s, MarketId s, RType s, TotalQttyOd d, TotalValueOd d",
        RType="rtype", NoChanges="nochanges", AllQty="all_qtty",
    ),
    "status": wire_fields(
        "RType s, MarketId s, TradingDate date, Time s, Symbol s, TradingSession s, TradingStatus s, Exchange s,"
        "TradingOlSession s",
        RType="rtype", Symbol="symbol_id",
    ),
}

# Channel code to topic.
TOPICS = {
    "F:ALL": "securities_status",
    "X-TRADE:ALL": "market_data_trade",
    "X-QUOTE:ALL": "market_data_quote",
    "R:ALL": "foreign_room_data",
    "MI:ALL": "index_data",
    "B:ALL": "bars",
}
CHANNEL_TOPICS = {
    "trade": "market_data_trade",
    "quote": "market_data_quote",
    "foreign_room": "foreign_room_data",
    "index": "index_data",
    "status": "securities_status",
}

# Fields of the daily index and daily price responses.
DAILY_INDEX = wire_fields(
    "IndexId s, TradingDate date, Time s, Change d, RatioChange d, TotalTrade d, TotalMatchVol d, TotalMatchVal d,"
    "TypeIndex s, IndexName s, Advances i, NoChanges i, Declines i, Ceilings i, Floors i, TotalDealVol d,"
    "TotalDealVal d, TotalVol d, TotalVal d, TradingSession s",
    IndexId="indexlist_id",
)
DAILY_PRICE = wire_fields(
    "Symbol s, TradingDate date, PriceChange d, PerPriceChange d, CeilingPrice d, FloorPrice d, RefPrice d,"
    "OpenPrice d, HighestPrice d, LowestPrice d, ClosePrice d, AveragePrice d, ClosePriceAdjusted d,"
    "TotalMatchVol d, TotalMatchVal d, TotalDealVal d, TotalDealVol d, ForeignBuyVolTotal d,"
    "ForeignCurrentRoom d, ForeignSellVolTotal d, ForeignBuyValTotal d, ForeignSellValTotal d, TotalBuyTrade d,"
    "TotalBuyTradeVol d, TotalSellTrade d, TotalSellTradeVol d, NetBuySellVol d, NetBuySellVal d,"
    "TotalTradedVol d, TotalTradedValue d, Time s",
    Symbol="symbol_id",
)

# The features of the model, and the measures of the facts.
FEATURES = [
    "last_price", "avg_price", "ref_price", "total_val", "change", "ratio_change", "highest", "lowest",
]

TRADE_MEASURES = [
    "last_price", "avg_price", "ceiling", "floor", "ref_price", "prio_val", "last_vol", "total_val", "change",
    "ratio_change", "highest", "lowest",
]
INDEX_MEASURES = [
    "index_value", "prio_index_value", "change", "ratio_change", "total_qtty", "total_value", "total_qtty_pt",
    "total_value_pt", "advances", "nochanges", "declines", "ceilings", "floors",
]

# The columns of the warehouse and result tables.
STAR_KEYS = "tradingdate_key key, time_key key, {entity}_key id, exchange_key id, trading_session_key id,"
TABLES = {
    "dim_date": table("tradingdate_key key, tradingdate date, year i, quarter i, month i, day i, weekday i"),
    "dim_time": table("time_key key, time_hh_mm_ss s, hour i, minute i, second i"),
    "dim_exchange": table("exchange_key id, exchange_name s"),
    "dim_index": table("index_key id, index_name s"),
    "dim_session": table("trading_session_key id, trading_session s"),
    "dim_symbol": table("symbol_key id, symbol s, symbol_name s, symbol_en_name s, sector s"),
    "fact_trade": table(STAR_KEYS.format(entity="symbol") + ",".join(f"{c} money" for c in TRADE_MEASURES)),
    "fact_quote": table(
        STAR_KEYS.format(entity="symbol") + book_levels(3, "{side}_price{n} money, {side}_vol{n} money").lower()
    ),
    "fact_market_index": table(
        STAR_KEYS.format(entity="index")
        + "index_value money, prio_index_value money, change money, ratio_change d, total_qtty money,"
        "total_value money, total_qtty_pt money, total_value_pt money, advances money, nochanges i, declines i,"
        "ceilings i, floors i"
    ),
    "feature_data": table("symbol s, tradingdate date," + ",".join(f"{c} d" for c in FEATURES)),
    "target_data": table("symbol s, tradingdate date, target_next_day_price d"),
    "prediction_log": table(
        "symbol s, tradingdate date, last_price d, predicted_next_day_price d, model_name s, model_type s"
    ),
    "daily_features": table("symbol s, tradingdate date," + ",".join(f"{c} d" for c in FEATURES)),
    "model_state": table(
        "symbol s, n id, sx d, sy d, sxx d, sxy d, lo d, hi d, last_train_date date, last_x d"
    ),
    "model_info": table(
        "symbol s, model_name s, model_type s, model_path s, last_train_date date, mse d, mae d, r2 d, lo d, hi d, slope d,"
        "intercept d"
    ),
    "corporation": table("symbol_id s, sector_id i, symbol_name s, symbol_en_name s"),
    "corporation_sector": table("sector_id i, sector_name s"),
    "securities": table("symbol_id s, symbol_name s, symbol_en_name s"),
    "security_detail": table("symbol_id s, detail_json s"),
    "index_list": table("indexlist_id s, market_id i, index_name s, index_code s"),
    "sector": table("sector_name s, symbol_id s, market_name s"),
    **{f"raw_{channel}": table_of(fields) for channel, fields in CHANNELS.items()},
    # responses as they were landed, every field as text
    "landed_securities": "market string, Symbol string, StockName string, StockEnName string",
    "landed_security_details": "Symbol string, Detail string",
    "landed_index_list": "Exchange string, IndexCode string, IndexName string, arrival bigint",
    "landed_index_components": "IndexCode string, StockSymbol string, Isin string",
    "landed_daily_bars": "Symbol string, TradingDate string, Open string, High string, Low string, Close string,"
                         " Volume string, Value string",
    "landed_intraday_bars": "Symbol string, TradingDate string, Time string, Open string, High string, Low string,"
                            " Close string, Volume string, Value string",
    "landed_sectors": "Sector string, Symbol string, Market string",
    "landed_daily_index": ", ".join(f"{wire} string" for wire, _, _ in DAILY_INDEX),
    "landed_daily_price": ", ".join(f"{wire} string" for wire, _, _ in DAILY_PRICE),
    "markets": "market_id int, market_name string",
    "daily_index": table_of(DAILY_INDEX),
    "daily_price": table_of(DAILY_PRICE),
}

# What makes a stored row the same as a new one, and two raw rows the same fact.
NATURAL_KEYS = {
    "dim_date": ["tradingdate_key"],
    "dim_time": ["time_key"],
    "dim_exchange": ["exchange_name"],
    "dim_index": ["index_name"],
    "dim_session": ["trading_session"],
    "dim_symbol": ["symbol"],
    "fact_trade": [
        "tradingdate_key", "time_key", "symbol_key", "last_price", "avg_price", "last_vol", "change",
    ],
    "fact_quote": ["tradingdate_key", "time_key", "symbol_key", "ask_price1", "ask_vol1"],
    "fact_market_index": ["tradingdate_key", "time_key", "index_key"],
    "securities": ["symbol_id"],
    "security_detail": ["symbol_id"],
    "index_list": ["index_code"],
    "daily_index": ["indexlist_id", "trading_date", "time", "trading_session"],
    "daily_price": ["symbol_id", "trading_date"],
    "sector": ["symbol_id"],
    "target_data": ["symbol", "tradingdate"],
    "prediction_log": ["symbol", "tradingdate"],
}
DEDUPE_KEYS = {
    "fact_trade": ["tradingdate_key", "time_key", "symbol_key", "last_vol", "total_val"],
    "fact_quote": ["tradingdate_key", "time_key", "symbol_key", "ask_price1", "ask_vol1"],
}
