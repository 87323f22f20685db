import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tapeworks import etl, schemas
from tapeworks.etl import JOBS, load_facts
from tapeworks.functions.times import date_key
from tapeworks.operators import joins, merge, star
from tapeworks.plans.inputs import Inputs
from tapeworks.session import scratch_dir, scratch_path
from tapeworks.sources import stores
from tapeworks.sources.stores import ParquetStore

DAY1, DAY2 = dt.date(2025, 1, 6), dt.date(2025, 1, 7)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def trade(spark, *given):
    """Trade rows from (date, time, symbol, last price, last vol, total val)."""
    full = []
    for date, time, symbol, price, volume, value in given:
        row = dict.fromkeys(c for _, c, _ in schemas.CHANNELS["trade"])
        row.update(trading_date=date, time=time, symbol=symbol, last_price=price, last_vol=volume, total_val=value,
                   avg_price=price, change=0.0, exchange="HOSE ", trading_session="LO")
        full.append(tuple(row.values()))
    return spark.createDataFrame(full, schemas.TABLES["raw_trade"])


def load_batch(raw, dims, store):
    dates = star.dated(raw).select(date_key(F.col("trading_date")).alias("tradingdate_key"))
    return load_facts("fact_trade", star.trade_facts(raw, dims), dates, store)


@pytest.fixture
def dims(spark):
    make = lambda name, *members: spark.createDataFrame(list(members), schemas.TABLES[name])
    return {
        "dim_date": star.date_members(spark.createDataFrame([(DAY1,), (DAY2,)], "trading_date date")),
        "dim_time": make("dim_time", (93000, "09:30:00", 9, 30, 0)),
        "dim_symbol": make("dim_symbol", (1, "VCB", "n", "e", "s"), (2, "ACB", "n", "e", "s")),
        "dim_exchange": make("dim_exchange", (7, "HOSE")),
        "dim_session": make("dim_session", (8, "LO")),
    }


def test_anti_join_treats_null_as_equal(spark):
    keys = spark.createDataFrame([(1,), (None,)], "k int")
    assert joins.not_in(keys, keys, ["k"]).count() == 0


def test_null_names_never_become_members(spark):
    raw = spark.createDataFrame([("a ",), ("a",), (None,)], "x string")
    assert rows(star.name_members(raw, "x", "name")) == [("a",)]


def test_trimmed_symbol_matches(spark, dims):
    facts = star.trade_facts(trade(spark, (DAY1, "09:30:00", "VCB       ", 10.0, 1.0, 10.0)), dims)
    assert [r.symbol_key for r in facts.collect()] == [1]
    padded = spark.createDataFrame([("VCB       ",)], "symbol string").select(F.trim("symbol").alias("symbol"))
    assert star.new_members(padded, dims["dim_symbol"], ["symbol"]).count() == 0


def test_unknown_symbol_is_dropped_and_other_misses_stay(spark, dims):
    raw = trade(
        spark, (DAY1, "10:00:00", "VCB", 10.0, 1.0, 10.0), (DAY1, "09:30:00", "ZZZ", 10.0, 1.0, 10.0),
        (dt.date(2030, 1, 1), "09:30:00", "ACB", 10.0, 1.0, 10.0), (None, "09:30:00", "ACB", 10.0, 1.0, 10.0),
    )
    got = star.trade_facts(raw, dims).select("tradingdate_key", "time_key", "symbol_key")
    assert rows(got) == [(20250106, 100000, 1), (20300101, 93000, 2)]
    assert star.undated(raw).count() == 1


def test_a_value_that_does_not_fit_becomes_null(spark, dims):
    facts = star.trade_facts(trade(spark, (DAY1, "09:30:00", "VCB", 1e300, 1.0, 10.005)), dims).first()
    assert facts.last_price is None and str(facts.total_val) == "10.01"


def test_load_is_idempotent_over_several_dates(spark, dims):
    raw = trade(
        spark, (DAY1, "09:30:00", "VCB", 10.0, 1.0, 10.0), (DAY1, "09:30:00", "ACB", 11.0, 1.0, 11.0),
        (DAY2, "09:30:00", "VCB", 12.0, 1.0, 12.0), (DAY2, "11:11:11", "VCB", 12.0, 2.0, 24.0),
        (dt.date(2031, 1, 1), "09:30:00", "VCB", 9.0, 1.0, 9.0),
    )
    store = ParquetStore(spark, scratch_path(spark, "test_facts"))
    load = lambda batch: load_batch(batch, dims, store)
    assert load(raw) == 5
    assert load(raw) == 0
    more = raw.unionByName(trade(spark, (DAY2, "09:30:00", "ACB", 12.0, 1.0, 12.0)))
    assert load(more) == 1
    assert store.read("fact_trade").count() == 6


def test_prices_are_decimals_before_the_comparison(spark):
    stored = spark.createDataFrame([(20250106, 10.12)], "tradingdate_key int, p double").select(
        "tradingdate_key", F.col("p").cast(star.MONEY).alias("p"))
    new = spark.createDataFrame([(20250106, 10.1234)], "tradingdate_key int, p double").select(
        "tradingdate_key", F.col("p").cast(star.MONEY).alias("p"))
    assert star.new_rows(new, stored, ["tradingdate_key", "p"], new).count() == 0


def test_survivor_does_not_depend_on_input_order(spark):
    data = [(1, x, y) for x in (3, 1, None) for y in (5, 4)]
    for seed in range(3):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "k int, x int, y int").repartition(3)
        assert rows(merge.first_by_key(df, ["k"])) == [(1, None, 4)]


def test_insert_ignore(spark):
    old = spark.createDataFrame([("S", "old")], "id string, v string")
    batch = spark.createDataFrame([("S", "new", 1), ("T", "first", 2), ("T", "second", 3)], "id string, v string, seq int")
    assert rows(merge.insert_ignore(old, batch, "id", "seq").drop("seq")) == [("T", "first")]


def test_upsert(spark):
    old = spark.createDataFrame([("X", "old"), ("Z", None)], "id string, v string")
    batch = spark.createDataFrame([("X", "a", 1), ("X", "new", 2), ("Y", None, 3)], "id string, v string, seq int")
    assert rows(merge.upsert(old, batch, "id", "seq")) == [("X", "new"), ("Y", None), ("Z", None)]


def test_resumed_rows_win(spark):
    old = spark.createDataFrame([("A", "old")], "id string, v string")
    new = spark.createDataFrame([("A", "new"), ("B", "new")], "id string, v string")
    assert rows(merge.append_new(old, new, "id")) == [("A", "old"), ("B", "new")]


def test_surrogate_keys_are_dense_and_stable(spark):
    names = spark.createDataFrame([(f"n{i}",) for i in range(500)], "name string")
    once = rows(merge.surrogate_keys(names, "name", "key", 10))
    again = rows(merge.surrogate_keys(names.repartition(7), "name", "key", 10))
    assert once == again
    assert sorted(k for k, _ in once) == list(range(11, 511))


def test_trades_at_unknown_times_stay_apart_and_are_stored_once(spark, dims):
    raw = trade(spark, (DAY1, "10:00:05", "VCB", 10.0, 1.0, 10.0), (DAY1, "11:00:00", "VCB", 10.0, 1.0, 10.0))
    store = ParquetStore(spark, scratch_path(spark, "test_facts"))
    assert load_batch(raw, dims, store) == 2
    later = dims | {"dim_time": star.time_members(raw)}
    assert load_batch(raw, later, store) == 0
    assert rows(store.read("fact_trade").select("time_key")) == [(100005,), (110000,)]


def jobs_run(spark):
    return spark.sparkContext.statusTracker().getJobIdsForGroup(None)


def test_building_a_star_runs_no_job(spark, dims):
    stored = {}
    for name, members in dims.items():
        path = scratch_path(spark, name)
        members.write.parquet(path)
        stored[name] = spark.read.schema(members.schema).parquet(path)
    raw = trade(spark, (DAY1, "09:30:00", "VCB", 10.0, 1.0, 10.0))
    before = jobs_run(spark)
    star.trade_facts(raw, stored)
    assert jobs_run(spark) == before


def test_hot_keys_of_a_large_lookup_are_split(spark):
    facts = spark.range(400_000).select(
        "id", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("k"))
    dim = spark.range(0, 200_000, 2).select(F.col("id").cast("string").alias("m"), "id").unionByName(
        spark.createDataFrame([("hot", -1)], "m string, id bigint"))
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "64k",
                "adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.{k}", v)
        found = joins.lookup(facts, dim, {"k": "m"}, [F.col("id").alias("found")])
        assert found.where("found = -1").count() == facts.where("k = 'hot'").count()
        whole = found.groupBy().agg(F.sum(F.hash("id", "found")))
        whole.collect()
        assert "skew=true" in whole._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_shuffled_lookup_equals_broadcast_lookup(spark, how):
    facts = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("k"))
    dim = spark.range(0, 2000, 2).select(F.col("id").cast("string").alias("m"), "id").unionByName(
        spark.createDataFrame([("hot", -1), (None, -2)], "m string, id bigint"))
    find = lambda ref: joins.lookup(facts, ref, {"k": "m"}, [F.col("id").alias("found")], how)
    assert rows(find(dim.hint("merge"))) == rows(find(F.broadcast(dim)))


def test_orphan_report(spark, dims):
    facts = spark.createDataFrame([(20250106, 93000, 1), (20990101, None, 1)], "tradingdate_key int, time_key int, symbol_key bigint")
    report = star.fk_report(facts, dims, [star.DATE, star.TIME])
    assert rows(report) == [("dim_date", 0, 1), ("dim_time", 1, 0)]


def test_only_the_months_of_the_batch_are_read(spark, dims):
    store = ParquetStore(spark, scratch_path(spark, "test_pruning"))
    load_batch(trade(spark, (DAY1, "09:30:00", "VCB", 10.0, 1.0, 10.0)), dims, store)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [trading_month" in plan(store.read("fact_trade", [202501])).replace("isnotnull(", "")
    assert store.read("fact_trade", [202501]).count() == 1
    assert store.read("fact_trade", [202502]).count() == 0


def test_all_jobs_run_again_without_change(spark):
    inputs = Inputs(spark, "/root/testdata/sf0.001")
    source = ParquetStore(spark, scratch_path(spark, "test_source"))
    warehouse = ParquetStore(spark, scratch_path(spark, "test_warehouse"))
    raw = {"raw_trade": inputs.trades(), "raw_quote": inputs.quotes(), "raw_index": inputs.index_values(),
           "corporation": inputs.corporations(), "corporation_sector": inputs.sectors()}
    text = lambda name, *given: spark.createDataFrame(list(given), schemas.TABLES[name])
    blank = lambda fields, **given: tuple({**{wire: None for wire, _, _ in fields}, **given}.values())
    raw |= {
        "markets": text("markets", (1, "HOSE ")),
        "landed_securities": text("landed_securities", ("HOSE", "VCB", "a", "b"), ("HNX", "VCB", "x", "y")),
        "landed_security_details": text("landed_security_details", ("VCB", "{}")),
        "landed_index_list": text("landed_index_list", ("HOSE", "X", "n", 1)),
        "landed_sectors": text("landed_sectors", ("Bank", "VCB", "HOSE")),
        "landed_daily_index": text("landed_daily_index", blank(schemas.DAILY_INDEX, IndexId="X", TradingDate="20/09/2025")),
        "landed_daily_price": text("landed_daily_price", blank(schemas.DAILY_PRICE, Symbol="V", TradingDate="20/09/2025")),
        "landed_index_components": text("landed_index_components", ("X", " VCB", "i"), ("X", None, "i")),
        "landed_daily_bars": text("landed_daily_bars", ("VCB", "20/09/2025", *"123456")),
        "landed_intraday_bars": text("landed_intraday_bars", ("VCB", "20/09/2025", "09:00:00", *"123456")),
    }
    for table, rows_ in raw.items():
        source.append(table, rows_)
    left = lambda: sorted(os.listdir(scratch_dir(spark).removeprefix("file://")))
    before = left()
    first = {name: job(source, warehouse) for name, job in JOBS.items()}
    assert all(first.values())
    assert {entry.rpartition("-")[0] for entry in set(left()) - set(before)} <= {"test_warehouse"}
    assert first["fact_trade"] == warehouse.read("fact_trade").count()
    facts = warehouse.read("fact_trade").join(warehouse.read("dim_symbol"), "symbol_key", "left_anti")
    assert facts.count() == 0
    again = {name: job(source, warehouse) for name, job in JOBS.items()}
    replaced = {"features", "daily_features", "index_list", "index_components", "daily_bars", "intraday_bars"}
    assert {name for name, n in again.items() if n} == replaced
    assert all(again[name] == first[name] for name in replaced)
    assert spark.read.option("header", True).csv(f"{warehouse.root}/export/index_components").first().StockSymbol == "VCB"
    assert warehouse.read("feature_data").count() == first["fact_trade"]
    assert warehouse.read("model_info").count() == first["train"]
    assert warehouse.read("model_state").count() == first["train"]
    assert warehouse.read("prediction_log").where("predicted_next_day_price is null").count() == 0
    assert JOBS["fact_trade"](source, warehouse, as_of="2001-11-04") == 0


def test_reference_data_loads(spark):
    store = ParquetStore(spark, scratch_path(spark, "test_loads"))
    pages = spark.createDataFrame(
        [("HOSE", "VCB ", "a", "b"), ("UPCOM", "VCB", "x", "y"), ("HNX", "ACB", "c", "d"), ("HNX", None, "c", "d")],
        "market string, Symbol string, StockName string, StockEnName string")
    assert etl.load_securities(pages, store) == 2
    assert etl.load_securities(pages, store) == 0
    assert rows(store.read("securities")) == [("ACB", "c", "d"), ("VCB", "a", "b")]
    details = spark.createDataFrame([("VCB", 5, None)], "Symbol string, Lot int, Note string")
    assert etl.load_security_details(details, store) == 1
    assert etl.load_security_details(details, store) == 0
    assert rows(store.read("security_detail")) == [("VCB", '{"Symbol":"VCB","Lot":5,"Note":null}')]
    markets = spark.createDataFrame([(1, "HOSE  "), (2, "HNX")], "market_id int, market_name string")
    items = lambda *given: spark.createDataFrame(list(given), "Exchange string, IndexCode string, IndexName string, seq int")
    etl.load_index_list(items(("HOSE", "X", "old", 1), ("HOSE", " ", "n", 2), ("NYSE", "Z", "n", 3)), markets, "seq", store)
    etl.load_index_list(items(("HOSE ", "X ", "new", 1), ("HNX", "Y", "", 2)), markets, "seq", store)
    assert rows(store.read("index_list")) == [("X", 1, "new", "X"), ("Y", 2, "Y", "Y")]
    blank = {wire: None for wire, _, _ in schemas.DAILY_PRICE}
    price = lambda **given: tuple({**blank, **given}.values())
    daily = spark.createDataFrame(
        [price(Symbol="VCB ", TradingDate="20/09/2025", ClosePrice="1.5"), price(Symbol="ACB", TradingDate="x")],
        ", ".join(f"{wire} string" for wire in blank))
    assert etl.load_daily("daily_price", daily, store) == 1
    assert [(r.symbol_id, r.close_price) for r in store.read("daily_price").collect()] == [("VCB", 1.5)]
    sectors = spark.createDataFrame([("Bank", "VCB", "HOSE")], "Brand string, Symbol string, Market string")
    assert etl.load_daily("daily_price", daily, store) == 0
    assert etl.load_sector_file(sectors, store) == 1
    assert etl.load_sector_file(sectors, store) == 0


def test_upsert_rewrites_only_touched_buckets(spark):
    root = scratch_path(spark, "test_upsert")
    store = stores.ParquetStore(spark, root, {"index_list": "index_code string, name string, create_time timestamp"})
    day = lambda d: dt.datetime(2025, 1, d)
    frame = lambda *given: spark.createDataFrame(list(given), "index_code string, name string, create_time timestamp, at int")
    assert store.upsert("index_list", frame(*[(f"S{i}", "old", day(1), 1) for i in range(300)], (None, "none", day(1), 1)), "at") == 301
    files = lambda: set(store.read("index_list").inputFiles())
    before = files()
    assert store.upsert("index_list", frame(("S7", "mid", day(2), 1), ("S7", "new", day(2), 2), ("T", "t", day(3), 1), (None, "again", day(4), 1)), "at") == 3
    kept = {r["index_code"]: (r["name"], r["create_time"].day) for r in store.read("index_list").collect()}
    assert len(kept) == 302 and kept["S7"] == ("new", 1) and kept["T"] == ("t", 3) and kept[None] == ("again", 1)
    assert kept["S8"] == ("old", 1)
    # files of other buckets keep their names
    assert 0 < len(before - files()) <= 3 and len(before & files()) >= stores.BUCKETS - 3 - 2
    assert store.upsert("index_list", frame().where("false"), "at") == 0
    opened = store.read("index_list")
    store.replace("index_list", opened.where("index_code = 'T'"))
    assert store.read("index_list").count() == 1 and opened.count() == 302  # the version it was opened at


def test_writers_of_one_bucket_take_turns(spark, monkeypatch):
    root = scratch_path(spark, "test_upsert")
    store = stores.ParquetStore(spark, root)
    batch = lambda code, name: spark.createDataFrame([(code, 1, name, code)], "indexlist_id string, market_id int, index_name string, index_code string")
    store.upsert("index_list", batch("A", "first"))
    write, late = store._write_buckets, [("A", "other")]

    def beaten(versions, table, rows):
        added = write(versions, table, rows)
        if late:
            stores.ParquetStore(spark, root).upsert("index_list", batch(*late.pop()))
        return added

    monkeypatch.setattr(store, "_write_buckets", beaten)
    store.upsert("index_list", batch("A", "mine"))
    assert [r["index_name"] for r in store.read("index_list").collect()] == ["mine"]
    assert not late


@pytest.mark.parametrize("table", ["fact_trade", "daily_price"])
def test_a_load_sends_its_rows_once(spark, dims, table):
    """One exchange makes rows single and brings them to the stored rows; nothing is sorted before it."""
    keys = schemas.NATURAL_KEYS[table]
    if table == "fact_trade":
        raw = trade(spark, (DAY1, "09:30:00", "VCB", 10.0, 1.0, 10.0))
        batch = star.trade_facts(raw, {name: dim.hint("broadcast") for name, dim in dims.items()})
    else:
        batch = spark.createDataFrame([("A", None)], "symbol_id string, trading_date date").transform(
            lambda rows: merge.first_by_key(rows.withColumn("price", F.rand()), keys, meet=keys))
    stored = batch.select(*keys).distinct().hint("merge")
    fresh = joins.not_in(batch, stored, keys, star.MEET.get(table, keys))
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    own = plan[:plan.index("+- Sort [xxhash64(_have")] if "+- Sort [xxhash64(_have" in plan else plan
    assert own.count("Exchange hashpartitioning(") == 1 and "Partial" not in own and fresh.count() == 0


def test_rows_meet_by_a_part_of_their_key(spark):
    have = [(1, None, 5), (1, 2, 5), (None, 2, 7)]
    new = [(1, None, 5), (1, None, 6), (None, 2, 7), (None, None, 7), (1, 2, 5), (1, 2, 5), (3, 3, 3)]
    frame = lambda given: spark.createDataFrame(given, "a int, b int, c int")
    single = merge.first_by_key(frame(new).withColumn("d", F.lit(1)), ["a", "b", "c"], meet=["a", "b"])
    fresh = joins.not_in(single, frame(have), ["a", "b", "c"], ["a", "b"])
    assert {tuple(r)[:3] for r in fresh.collect()} == {(1, None, 6), (None, None, 7), (3, 3, 3)} and fresh.count() == 3
