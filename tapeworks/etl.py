"""The jobs by name: each reads raw or warehouse tables, writes one table, and may be run again.

``JOBS["fact_trade"](source, warehouse)`` loads what is new and returns the number of rows added.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.text import json_record
from tapeworks.functions.times import date_key
from tapeworks.operators import forecast, merge, series, star
from tapeworks.operators.joins import lookup, not_in
from tapeworks.schemas import DAILY_INDEX, DAILY_PRICE, NATURAL_KEYS
from tapeworks.session import staged, temporary_scratch
from tapeworks.sources.responses import accepted, index_list_rows, load_rows, load_sectors
from tapeworks.sources.stores import Store, month_of

TRADE_DIMS = ("dim_symbol", "dim_exchange", "dim_session")
INDEX_DIMS = ("dim_index", "dim_exchange", "dim_session")
# Days of raw rows each incremental load looks back over.
LOOK_BACK = {"fact_trade": 5, "fact_quote": 2}


def load_dim(table: str, members: Callable[[Store], DataFrame]) -> Callable[[Store, Store], int]:
    """Dimension whose key is part of its members (dates, times)."""

    def job(source: Store, warehouse: Store) -> int:
        fresh = star.new_members(members(source), warehouse.read(table), NATURAL_KEYS[table])
        return warehouse.append(table, fresh)

    return job


def load_numbered_dim(table: str, key: str, members: Callable[[Store], DataFrame]) -> Callable[[Store, Store], int]:
    """Dimension of names with surrogate keys."""

    def job(source: Store, warehouse: Store) -> int:
        fresh = star.number_members(members(source), warehouse.read(table), NATURAL_KEYS[table][0], key)
        return warehouse.append(table, fresh)

    return job


def load_facts(table: str, facts: DataFrame, batch_dates: DataFrame, warehouse: Store) -> int:
    """Append the fact rows that are not stored yet, for all dates of the batch in one pass.

    Only the months of the batch are read back. ``batch_dates`` holds the date keys of the raw rows.
    """
    days = staged(batch_dates.select(star.DATE_KEY).distinct(), "batch_dates")
    # a literal list prunes partitions when the plan is made; it holds one entry per calendar month
    months = [row[0] for row in days.select(month_of(F.col(star.DATE_KEY))).distinct().collect()]
    return warehouse.append(table, warehouse.unstored(table, facts, months, days))


def fact_job(table: str, raw: str, build: Callable, dims: tuple[str, ...]) -> Callable[..., int]:
    def job(source: Store, warehouse: Store, as_of: str | None = None) -> int:
        """Load from the raw rows of the days before ``as_of``, or from all of them."""
        rows = source.read(raw)
        if as_of and table in LOOK_BACK:
            rows = star.recent(rows, as_of, LOOK_BACK[table])
        dates = star.dated(rows).select(date_key(F.col("trading_date")).alias(star.DATE_KEY))
        return load_facts(table, build(rows, {d: warehouse.read(d) for d in dims}), dates, warehouse)

    return job


def load_features(source: Store, warehouse: Store) -> int:
    """Trade facts with symbol and date in place of their keys; replaces the feature table."""
    dims = {name: warehouse.read(name) for name in ("dim_symbol", "dim_date")}
    warehouse.replace("feature_data", star.feature_rows(warehouse.read("fact_trade"), dims))
    return warehouse.read("feature_data").count()


def load_daily_features(source: Store, warehouse: Store) -> int:
    """The daily series of every symbol, from the raw trades; replaces the table that is trained on."""
    warehouse.replace("daily_features", series.daily_series(source.read("raw_trade")))
    return warehouse.read("daily_features").count()


def append_unknown(warehouse: Store, table: str, rows: DataFrame) -> int:
    """Append the rows whose natural key is not stored yet, one of each."""
    keys = NATURAL_KEYS[table]
    return warehouse.append(table, not_in(merge.first_by_key(rows, keys, meet=keys), warehouse.read(table), keys, keys))


def train(source: Store, warehouse: Store) -> int:
    """Train on what is new, predict the next price of every trained symbol, and log it.

    The state keeps the training sums and the last price of each symbol, so that training goes on from them;
    symbols without new rows keep their model. Predictions are stored once per symbol and day, and the state,
    which moves the mark, is written last: a run that broke off is simply run again. Returns the number of
    symbols trained.
    """
    features, stored = warehouse.read("daily_features"), warehouse.read("model_state")
    enough = series.with_min_history(features, 3)
    fresh = staged(forecast.new_sums(enough, stored), "new_sums")
    # symbols without new rows keep their model and state: only the others are merged and stored
    known = stored.join(fresh.select("symbol"), "symbol", "left_semi")
    merged = staged(forecast.merge_states(known, fresh), "model_state")
    lines = forecast.line_of(merged).join(fresh.select("symbol"), "symbol", "left_semi")
    predictions = staged(forecast.predict_line(lines, features), "predictions")
    append_unknown(warehouse, "target_data", forecast.target_rows(predictions))
    append_unknown(warehouse, "prediction_log", forecast.prediction_rows(predictions))
    trained = enough.join(fresh.select("symbol"), "symbol", "left_semi")
    warehouse.upsert("model_info", forecast.model_rows(merged, forecast.evaluate(trained)))
    warehouse.upsert("model_state", merged)
    return fresh.count()


# Reference data from landed responses


def load_securities(landed: DataFrame, warehouse: Store) -> int:
    """Securities of all markets (``market, Symbol, StockName, StockEnName``); known symbols are left alone."""
    batch = landed.select(
        F.trim("Symbol").alias("symbol_id"), F.col("StockName").alias("symbol_name"),
        F.col("StockEnName").alias("symbol_en_name"), "market",
    ).dropna(subset=["symbol_id"])
    fresh = merge.insert_ignore(warehouse.read("securities"), batch, "symbol_id", "market")
    return warehouse.append("securities", fresh.drop("market"))


def load_security_details(items: DataFrame, warehouse: Store) -> int:
    """Detail records with their ``Symbol``, stored whole as JSON text."""
    batch = items.select(
        F.trim("Symbol").alias("symbol_id"), json_record(*items.columns).alias("detail_json")
    ).dropna(subset=["symbol_id"])
    fresh = merge.insert_ignore(warehouse.read("security_detail"), batch, "symbol_id", "detail_json")
    return warehouse.append("security_detail", fresh)


def load_index_list(items: DataFrame, markets: DataFrame, sequence: str, warehouse: Store) -> int:
    """Index records of known markets (``market_id, market_name``); the last of each code is stored."""
    named = markets.select("market_id", F.trim("market_name").alias("market_name"))
    found = lookup(index_list_rows(items, sequence), named, {"exchange": "market_name"}, ["market_id"], "inner")
    return warehouse.upsert("index_list", found, sequence)


def load_daily(table: str, records: DataFrame, warehouse: Store) -> int:
    """Append the accepted records of ``daily_index`` or ``daily_price`` responses that are not stored yet."""
    fields, code = {"daily_index": (DAILY_INDEX, "IndexId"), "daily_price": (DAILY_PRICE, "Symbol")}[table]
    return append_unknown(warehouse, table, accepted(load_rows(records, fields, code)))


def load_sector_file(rows: DataFrame, warehouse: Store) -> int:
    return append_unknown(warehouse, "sector", load_sectors(rows).dropna(subset=["symbol_id"]))


def _index_list_job(source: Store, warehouse: Store) -> int:
    return load_index_list(source.read("landed_index_list"), source.read("markets"), "arrival", warehouse)


def export_csv(table: str, code: str) -> Callable[[Store, Store], int]:
    """Landed records that have their code, as a CSV folder with a header; replaces the last export."""

    def job(source: Store, warehouse: Store) -> int:
        rows = source.read(f"landed_{table}")
        trimmed = rows.select(*[F.trim(c).alias(c) for c in rows.columns])
        return warehouse.export(table, trimmed.where((F.col(code) != "") & F.col(code).isNotNull()))

    return job


def _names(raw: str, column: str, name: str) -> Callable[[Store], DataFrame]:
    return lambda source: star.name_members(source.read(raw), column, name)


def cleaned(job: Callable[..., int]) -> Callable[..., int]:
    """The job, after which its intermediate tables are deleted."""

    @wraps(job)
    def run(source: Store, warehouse: Store, **given) -> int:
        with temporary_scratch():
            return job(source, warehouse, **given)

    return run


_LOADS: dict[str, Callable[..., int]] = {
    "dim_date": load_dim("dim_date", lambda source: star.date_members(source.read("raw_trade"))),
    "dim_time": load_dim("dim_time", lambda source: star.time_members(source.read("raw_quote"))),
    "dim_exchange": load_numbered_dim("dim_exchange", "exchange_key", _names("raw_index", "exchange", "exchange_name")),
    "dim_index": load_numbered_dim("dim_index", "index_key", _names("raw_index", "index_name", "index_name")),
    "dim_session": load_numbered_dim(
        "dim_session", "trading_session_key", _names("raw_trade", "trading_session", "trading_session")
    ),
    "dim_symbol": load_numbered_dim(
        "dim_symbol", "symbol_key",
        lambda source: star.symbol_members(source.read("corporation"), source.read("corporation_sector")),
    ),
    "fact_trade": fact_job("fact_trade", "raw_trade", star.trade_facts, TRADE_DIMS),
    "fact_quote": fact_job("fact_quote", "raw_quote", star.quote_facts, TRADE_DIMS),
    "fact_market_index": fact_job("fact_market_index", "raw_index", star.index_facts, INDEX_DIMS),
    "features": load_features,
    "daily_features": load_daily_features,
    "train": train,
    "securities": lambda source, warehouse: load_securities(source.read("landed_securities"), warehouse),
    "security_detail": lambda source, warehouse: load_security_details(source.read("landed_security_details"), warehouse),
    "index_list": _index_list_job,
    "daily_index": lambda source, warehouse: load_daily("daily_index", source.read("landed_daily_index"), warehouse),
    "daily_price": lambda source, warehouse: load_daily("daily_price", source.read("landed_daily_price"), warehouse),
    "sector": lambda source, warehouse: load_sector_file(source.read("landed_sectors"), warehouse),
    "index_components": export_csv("index_components", "StockSymbol"),
    "daily_bars": export_csv("daily_bars", "Symbol"),
    "intraday_bars": export_csv("intraday_bars", "Symbol"),
}
JOBS = {name: cleaned(job) for name, job in _LOADS.items()}
