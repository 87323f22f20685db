"""Star schema: dimension members, fact rows and incremental loads."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.times import clock_key, date_key
from tapeworks.operators.joins import lookup, not_in
from tapeworks.operators.merge import first_by_key, surrogate_keys
from tapeworks.schemas import (
    DEDUPE_KEYS, FEATURES, INDEX_MEASURES, NATURAL_KEYS, TABLES, TRADE_MEASURES, columns_of,
)

MONEY = "decimal(18,2)"
DATE_KEY = "tradingdate_key"
#: Columns of both the key that facts are made single by and the key they are stored by: one exchange serves both.
MEET = {table: [k for k in NATURAL_KEYS[table] if k in keys] for table, keys in DEDUPE_KEYS.items()}


class Link(NamedTuple):
    """How a fact finds one dimension: its own column, the dimension's column and key."""

    column: str
    dimension: str
    match: str
    key: str
    how: str = "left"


DATE = Link("_date_key", "dim_date", "tradingdate_key", "tradingdate_key")
TIME = Link("_time_key", "dim_time", "time_key", "time_key")
EXCHANGE = Link("_exchange", "dim_exchange", "exchange_name", "exchange_key")
SESSION = Link("_session", "dim_session", "trading_session", "trading_session_key")
SYMBOL = Link("_symbol", "dim_symbol", "symbol", "symbol_key", "inner")
INDEX = Link("_index", "dim_index", "index_name", "index_key")


# Dimensions


def date_members(raw: DataFrame, column: str = "trading_date") -> DataFrame:
    date = F.col("tradingdate")
    return (
        raw.select(F.col(column).alias("tradingdate"))
        .where(date.isNotNull())
        .distinct()
        .select(
            date_key(date).alias("tradingdate_key"),
            date,
            F.year(date).alias("year"),
            F.quarter(date).alias("quarter"),
            F.month(date).alias("month"),
            F.dayofmonth(date).alias("day"),
            F.dayofweek(date).alias("weekday"),
        )
    )


def time_members(raw: DataFrame, column: str = "time") -> DataFrame:
    key = F.col("time_key")
    two = lambda part: F.lpad(part.cast("string"), 2, "0")
    hour, minute, second = F.floor(key / 10000), F.floor(key / 100) % 100, key % 100
    return (
        raw.select(F.col(column).alias("_text"))
        .distinct()
        .select(clock_key(F.col("_text")).alias("time_key"))
        .where(key.isNotNull())
        .distinct()
        .select(
            key,
            F.concat_ws(":", two(hour), two(minute), two(second)).alias("time_hh_mm_ss"),
            hour.cast("int").alias("hour"),
            minute.cast("int").alias("minute"),
            second.cast("int").alias("second"),
        )
    )


def name_members(raw: DataFrame, column: str, name: str) -> DataFrame:
    return raw.select(F.trim(F.col(column)).alias(name)).where(F.col(name).isNotNull()).distinct()


def symbol_members(corporations: DataFrame, sectors: DataFrame) -> DataFrame:
    named = lookup(corporations, sectors, {"sector_id": "sector_id"}, ["sector_name"])
    return named.select(
        F.trim("symbol_id").alias("symbol"),
        "symbol_name",
        "symbol_en_name",
        F.col("sector_name").alias("sector"),
    ).distinct()


def new_members(candidates: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members not yet in the dimension. NULL natural keys never become members."""
    return not_in(candidates.dropna(subset=list(keys)), existing, keys)


def number_members(candidates: DataFrame, existing: DataFrame, name: str, key: str) -> DataFrame:
    """New members, one per name, with surrogate keys that follow the largest key in use."""
    used = existing.agg(F.max(key)).first()[0] or 0
    return surrogate_keys(first_by_key(new_members(candidates, existing, [name]), [name]), name, key, used)


# Facts


def star_lookup(raw: DataFrame, dims: dict[str, DataFrame], links: Sequence[Link]) -> DataFrame:
    """Attach the key of every linked dimension."""
    for link in links:
        taken = F.col(link.key).alias(f"_found_{link.key}")
        raw = lookup(raw, dims[link.dimension], {link.column: link.match}, [taken], link.how)
        raw = raw.drop(link.column).withColumnRenamed(f"_found_{link.key}", link.key)
    return raw


def _keys(**names: str) -> list[Column]:
    """Key columns of a raw row: its date and time keys, and the trimmed names to look up.

    Date and time keys are functions of the row and do not wait for their dimension: a member that comes later
    neither merges two trades before it nor makes a stored trade look new afterwards. The report on
    orphans tells which members are missing.
    """
    return [
        date_key(F.col("trading_date")).alias("tradingdate_key"),
        clock_key(F.col("time")).alias("time_key"),
        *[F.trim(F.col(column)).alias(f"_{alias}") for alias, column in names.items()],
    ]


def _fact_columns(table: str) -> list[Column]:
    """The declared columns of a fact table, cast before any comparison with stored rows; a value that
    does not fit its column becomes NULL rather than ending the load."""
    return [F.col(name).try_cast(kind).alias(name) for name, kind in columns_of(TABLES[table])]


def dated(raw: DataFrame) -> DataFrame:
    """Raw rows that can enter a fact: those with a trading date."""
    return raw.where(F.col("trading_date").isNotNull())


def undated(raw: DataFrame) -> DataFrame:
    """Raw rows that are kept out of the facts."""
    return raw.where(F.col("trading_date").isNull())


def recent(raw: DataFrame, as_of: str, days: int, column: str = "trading_date") -> DataFrame:
    """Rows dated from ``days`` before ``as_of`` on."""
    return raw.where(F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days))


def trade_star(raw: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    measures = [F.col("prior_val" if m == "prio_val" else m).try_cast(MONEY).alias(m) for m in TRADE_MEASURES]
    keyed = dated(raw).select(
        *_keys(symbol="symbol", exchange="exchange", session="trading_session"), *measures
    )
    linked = star_lookup(keyed, dims, [SYMBOL, EXCHANGE, SESSION])
    return linked.select(*_fact_columns("fact_trade"))


def trade_facts(raw: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    return first_by_key(trade_star(raw, dims), DEDUPE_KEYS["fact_trade"], meet=MEET["fact_trade"])


def quote_star(raw: DataFrame, dims: dict[str, DataFrame], levels: int = 3) -> DataFrame:
    """The first ``levels`` of the order book with star keys."""
    book = [
        F.col(f"{side}_{part}{n}").try_cast(MONEY).alias(f"{side}_{part}{n}")
        for side in ("ask", "bid") for n in range(1, levels + 1) for part in ("price", "vol")
    ]
    keyed = dated(raw).select(
        *_keys(symbol="symbol_id", exchange="exchange", session="trading_session"), *book
    )
    return star_lookup(keyed, dims, [SYMBOL, EXCHANGE, SESSION])


def quote_facts(raw: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    star = quote_star(raw, dims).select(*_fact_columns("fact_quote"))
    return first_by_key(star, DEDUPE_KEYS["fact_quote"], meet=MEET["fact_quote"])


def index_star(raw: DataFrame, dims: dict[str, DataFrame], *carry: str) -> DataFrame:
    measures = [F.col("prior_index_value" if m == "prio_index_value" else m).alias(m) for m in INDEX_MEASURES]
    keyed = dated(raw).select(
        *_keys(index="index_name", exchange="exchange", session="trading_session"), *measures, *carry
    )
    return star_lookup(keyed, dims, [INDEX, EXCHANGE, SESSION])


def index_facts(raw: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    return index_star(raw, dims).select(*_fact_columns("fact_market_index")).distinct()


# New rows


def new_rows(
    facts: DataFrame, existing: DataFrame, keys: Sequence[str], batch_dates: DataFrame, meet: Sequence[str] = ()
) -> DataFrame:
    """Fact rows not yet stored, over all dates of the batch in one pass.

    Stored rows of other dates are left out before the anti join. ``batch_dates`` holds the date
    keys of the batch: at most one row per calendar day once made distinct. ``meet`` is as in ``not_in``.
    """
    days = batch_dates.select(F.col(DATE_KEY).alias("_day")).distinct()
    touched = existing.join(days, F.col(DATE_KEY).eqNullSafe(F.col("_day")), "left_semi")
    return not_in(facts, touched, keys, meet)


def rows_per_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy(DATE_KEY).agg(F.count("*").alias("new_rows"))


# Reads of the star


def fk_report(facts: DataFrame, dims: dict[str, DataFrame], links: Sequence[Link]) -> DataFrame:
    """Per dimension: fact rows without a key, and rows whose key is not in the dimension."""
    sums = []
    for link in links:
        flag = f"_has_{link.key}"
        facts = lookup(facts, dims[link.dimension], {link.key: link.key}, [F.lit(True).alias(flag)])
        missing = F.col(link.key).isNull()
        sums.append(F.count_if(missing).alias(f"null_{link.key}"))
        sums.append(F.count_if(~missing & F.col(flag).isNull()).alias(f"orphan_{link.key}"))
    stacked = ", ".join(f"'{l.dimension}', null_{l.key}, orphan_{l.key}" for l in links)
    return facts.agg(*sums).selectExpr(f"stack({len(links)}, {stacked}) as (dimension, null_keys, orphan_keys)")


def feature_rows(facts: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Trade facts with symbol and date in place of their keys, and the eight features."""
    named = lookup(facts, dims["dim_symbol"], {"symbol_key": "symbol_key"}, ["symbol"])
    named = lookup(named, dims["dim_date"], {"tradingdate_key": "tradingdate_key"}, ["tradingdate"])
    return named.select("symbol", "tradingdate", *[F.col(c).cast("double").alias(c) for c in FEATURES])


def index_rows(raw: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Index rows with dimension texts in place of keys."""
    star = index_star(raw, dims)
    star = lookup(star, dims["dim_date"], {"tradingdate_key": "tradingdate_key"}, ["tradingdate"])
    star = lookup(star, dims["dim_time"], {"time_key": "time_key"}, ["time_hh_mm_ss"])
    star = lookup(star, dims["dim_index"], {"index_key": "index_key"}, ["index_name"])
    return star.select(
        "tradingdate", "time_hh_mm_ss", "index_name", *INDEX_MEASURES, "exchange_key", "trading_session_key"
    ).distinct()
