import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import forecast, merge, series, ticks
from tapeworks.plans.inputs import Inputs
from tapeworks.schemas import FEATURES

DAY0 = dt.date(2025, 1, 1)


def daily(spark, **prices):
    rows = [
        (symbol, DAY0 + dt.timedelta(days=i), *[float(p) + j for j in range(len(FEATURES))])
        for symbol, values in prices.items() for i, p in enumerate(values)
    ]
    return spark.createDataFrame(rows, "symbol string, tradingdate date, " + ", ".join(f"{c} double" for c in FEATURES))


def test_sequences_and_labels(spark):
    got = series.sequences(daily(spark, A=[1, 2, 3, 4, 5], B=[7, 8]), 2).orderBy("label_date").collect()
    assert [(r.symbol, [s.last_price for s in r.steps], r.label) for r in got] == [
        ("A", [1.0, 2.0], 3.0), ("A", [2.0, 3.0], 4.0), ("A", [3.0, 4.0], 5.0)]


def test_scoring_sequence(spark):
    got = series.scoring_sequence(daily(spark, A=[1, 2, 3, 4], B=[7]), 2).collect()
    assert [(r.symbol, str(r.tradingdate), [s.last_price for s in r.steps]) for r in got] == [("A", "2025-01-04", [3.0, 4.0])]


def test_chronological_split(spark):
    runs = series.sequences(daily(spark, A=range(9)), 2)
    split = series.chrono_split(runs, "label_date").orderBy("label_date")
    assert [r.is_train for r in split.collect()] == [True] * 5 + [False] * 2


def test_min_history(spark):
    kept = series.with_min_history(daily(spark, A=[1, 2, 3], B=[1, 2]), 3)
    assert {r.symbol for r in kept.collect()} == {"A"}


def test_incremental_sequences_start_after_the_mark(spark):
    rows = daily(spark, A=[1, 2, 3, 4, 5], B=[1, 2, 3])
    marks = spark.createDataFrame([("A", DAY0 + dt.timedelta(days=1))], "symbol string, last_train_date date")
    got = series.incremental_sequences(rows, marks, 2).collect()
    assert sorted((r.symbol, r.label) for r in got) == [("A", 5.0), ("B", 3.0)]


def tick_rows(spark, keys):
    shuffled = random.Random(5)
    rows = [(key, i // 7, i, float(shuffled.randrange(100))) for key, n in keys.items() for i in range(n)]
    shuffled.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, slot int, at int, price double").repartition(5)


@pytest.mark.parametrize("target", [5, 20, 1000])
@pytest.mark.parametrize("length", [1, 4, 10])
def test_tick_sequences_cross_the_borders_of_segments(spark, target, length):
    rows, df = tick_rows(spark, {"hot": 200, "warm": 30, "cold": 3})
    got = ticks.tick_sequences(df, "k", "slot", ["at"], ["price"], length, target).collect()
    want = {}
    for key in ("hot", "warm", "cold"):
        prices = [r[3] for r in sorted(r for r in rows if r[0] == key)]
        want.update({(key, i): (prices[i - length:i], prices[i]) for i in range(length, len(prices))})
    assert {(r.k, r.at): ([s.price for s in r.steps], r.label) for r in got} == want


@pytest.mark.parametrize("target", [5, 1000])
def test_tick_positions(spark, target):
    _, df = tick_rows(spark, {"hot": 200, "cold": 3})
    got = ticks.tick_positions(df, "k", "slot", ["at"], target).collect()
    assert {(r.k, r.at): (r.position, r.total) for r in got} == {
        (k, i): (i + 1, n) for k, n in (("hot", 200), ("cold", 3)) for i in range(n)}


def test_busy_keys_are_cut_into_even_segments(spark):
    _, df = tick_rows(spark, {"hot": 700, "cold": 30})
    cut, form = ticks.cut_segments(df, "k", "slot", 100)
    sizes = cut.groupBy("k", "segment").count().collect()
    assert form == ticks.CUT and max(r["count"] for r in sizes) <= 107
    assert [r.segment for r in sizes if r.k == "cold"] == [0]


@pytest.mark.parametrize("group, joins", [(32, 1), (4, 2), (2, 4)])
def test_rows_are_shuffled_once_for_their_sequences(spark, group, joins, monkeypatch):
    """And compared with few segments on their way: ten segments of a key take a join for each level of groups."""
    monkeypatch.setattr(ticks, "GROUP", group)
    _, df = tick_rows(spark, {"hot": 200, "cold": 3})
    runs = ticks.tick_sequences(df, "k", "slot", ["at"], ["price"], 4, 20)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.count("BroadcastHashJoin") == joins


@pytest.mark.parametrize("group, levels", [(32, 1), (4, 2)])
def test_rows_meet_many_bounds_without_another_shuffle(spark, group, levels, monkeypatch):
    """Bounds too many for a broadcast are sent to the rows: an exchange of theirs, and one of the rows for each level."""
    monkeypatch.setattr(ticks, "GROUP", group)
    _, df = tick_rows(spark, {"hot": 200, "cold": 3})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = ticks.tick_sequences(df, "k", "slot", ["at"], ["price"], 4, 20)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert len([line for line in shuffled if "(k#" in line]) == levels and len(shuffled) == 2 * levels


def test_borders_are_copied_after_the_shuffle(spark):
    """Small segments go to a task together, so the rows that several of them need are sent there once."""
    _, df = tick_rows(spark, {"hot": 200, "cold": 3})
    cut, _ = ticks.cut_segments(df, "k", "slot", 20, ["at"], 60)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.index("BroadcastHashJoin") < plan.index("Exchange hashpartitioning(")
    homes = cut.withColumn("task", F.spark_partition_id()).groupBy("k", "group").agg(F.countDistinct("task").alias("n"))
    assert {r.n for r in homes.collect()} == {1}


@pytest.mark.parametrize("most", [20, 10_000])
def test_large_segments_go_to_tasks_of_their_own(spark, most, monkeypatch):
    monkeypatch.setattr(ticks, "SEGMENT_ROWS", most)
    _, df = tick_rows(spark, {"hot": 700, "cold": 3})
    cut, _ = ticks.cut_segments(df, "k", "slot", 20, ["at"], 4)
    groups = cut.groupBy("k", "group").agg(F.countDistinct("segment").alias("n")).where("k = 'hot'").collect()
    assert max(r.n for r in groups) == (1 if most == 20 else 32)


@pytest.mark.parametrize("target", [20, 1000])
def test_values_are_shuffled_once_for_their_sequences(spark, target):
    """Not as columns and again as the structs that the histories are made of."""
    _, df = tick_rows(spark, {"hot": 200, "cold": 3})
    runs = ticks.tick_sequences(df, "k", "slot", ["at", "price"], ["price"], 4, target)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    _, shuffled = plan.split("Exchange hashpartitioning(")
    assert "struct(price" not in shuffled


@pytest.mark.parametrize("reach", [1, 7, 60])
def test_segments_are_given_whole_pieces_within_reach(spark, reach):
    _, df = tick_rows(spark, {"hot": 200, "cold": 3})
    cut, _ = ticks.cut_segments(df, "k", "slot", 20, ["at"], reach)
    got = {}
    for r in cut.collect():
        got.setdefault((r.k, r.segment), {True: [], False: []})[r.own].append(r["at"])
    cold = got.pop(("cold", 0))
    assert sorted(cold[True]) == [0, 1, 2] and not cold[False]
    assert sorted(i for parts in got.values() for i in parts[True]) == list(range(200))
    for parts in got.values():
        start, lent = min(parts[True]), sorted(parts[False])
        assert lent == list(range(start - len(lent), start))
        assert min(start, reach) <= len(lent) < reach + 7


@pytest.mark.parametrize("broadcast", [-1, 10_000_000])
@pytest.mark.parametrize("target, group", [(1, 32), (1, 4), (6, 2), (30, 32)])
def test_sequences_over_uneven_pieces(spark, target, group, broadcast, monkeypatch):
    """Missing slots, prices that are missing or no number, segments smaller than a history, and joins by sorting."""
    monkeypatch.setattr(ticks, "GROUP", group)
    draw = random.Random(7)
    slots = [None] * 3 + [s for s in range(25) for _ in range(draw.choice([1, 1, 2, 9, 14]))]
    prices = [draw.choice([None, -0.0, 0.0, float("nan"), float("-inf"), 2.5, float(i)]) for i in range(len(slots))]
    given = [("hot", slot, price, i) for i, (slot, price) in enumerate(zip(slots, prices))]
    draw.shuffle(given)
    df = spark.createDataFrame(given, "k string, slot int, price double, id int").repartition(4)
    low, high = -float("inf"), float("inf")
    rank = lambda r: (-1 if r[1] is None else r[1], (0, low) if r[2] is None else (2, high) if r[2] != r[2] else (1, r[2]), r[3])
    ids = [r[3] for r in sorted(given, key=rank)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        order = ["slot", "price", "id"]
        runs = ticks.tick_sequences(df, "k", "slot", order, ["id"], 8, target).collect()
        placed = ticks.tick_positions(df, "k", "slot", order, target).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.label: [s.id for s in r.steps] for r in runs} == {ids[i]: ids[i - 8:i] for i in range(8, len(ids))}
    assert len(runs) == len(ids) - 8
    assert {r.id: r.position for r in placed} == {d: i for i, d in enumerate(ids, 1)}


def copies(spark):
    """A key of which most rows are copies of one row, within a single slot."""
    rows = [("hot", i, i, float(i % 5)) for i in range(40)] + [("hot", 17, 17, 9.0)] * 95 + [("cold", 1, 1, 2.0)] * 4
    random.Random(6).shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, slot int, at int, price double").repartition(4)


@pytest.mark.parametrize("length", [1, 6])
def test_sequences_of_a_slot_full_of_copies(spark, length, monkeypatch):
    monkeypatch.setattr(ticks, "CHUNK_ROWS", 10)
    rows, df = copies(spark)
    assert ticks.cut_segments(df, "k", "slot", 30)[1] == ticks.PACKED
    got = ticks.tick_sequences(df, "k", "slot", ["at", "price"], ["price"], length, 30).collect()
    want = []
    for key in ("hot", "cold"):
        own = sorted((r[2], r[3]) for r in rows if r[0] == key)
        want += [(key, own[i][0], [p for _, p in own[i - length:i]], own[i][1]) for i in range(length, len(own))]
    assert sorted((r.k, r.at, [s.price for s in r.steps], r.label) for r in got) == sorted(want)


def test_positions_in_a_slot_full_of_copies(spark, monkeypatch):
    monkeypatch.setattr(ticks, "CHUNK_ROWS", 10)
    rows, df = copies(spark)
    got = ticks.tick_positions(df, "k", "slot", ["at", "price"], 30).collect()
    want = []
    for key in ("hot", "cold"):
        own = sorted((r[2], r[3]) for r in rows if r[0] == key)
        want += [(key, *row, i + 1, len(own)) for i, row in enumerate(own)]
    assert sorted((r.k, r.at, r.price, r.position, r.total) for r in got) == sorted(want)


def test_lag1_fit_is_least_squares(spark):
    prices = [3, 5, 4, 8, 7, 9, 12, 10]
    model = forecast.fit_lag1(forecast.price_pairs(daily(spark, A=prices))).first()
    scaled = (np.array(prices) - 3) / 9
    slope, intercept = np.polyfit(scaled[:-1], scaled[1:], 1)
    assert model.slope == pytest.approx(slope) and model.intercept == pytest.approx(intercept)
    rows = daily(spark, A=prices)
    predicted = forecast.predict_next(forecast.fit_lag1(forecast.price_pairs(rows)), rows).first()
    assert predicted.predicted_price == pytest.approx((intercept + slope * scaled[-1]) * 9 + 3)


def test_incremental_training_equals_training_at_once(spark):
    prices = [3, 5, 4, 8, 7, 9, 12, 10]
    rows = daily(spark, A=prices, B=[1, 2, 4])
    early = rows.where((F.col("symbol") == "A") & (F.col("tradingdate") < DAY0 + dt.timedelta(days=4)))
    state = forecast.incremental_fit(rows, forecast.pair_sums(early))
    line = {r.symbol: r for r in forecast.line_of(state).collect()}
    pairs = list(zip(prices, prices[1:]))
    slope, intercept = np.polyfit(*zip(*pairs), 1)
    assert line["A"].slope == pytest.approx(slope) and line["A"].intercept == pytest.approx(intercept)
    assert line["B"].n == 2
    assert str(line["A"].last_train_date) == "2025-01-08"
    again = forecast.incremental_fit(rows, state)
    assert {r.symbol: r.n for r in again.collect()} == {"A": 7, "B": 2}


def test_daily_increments_equal_one_training(spark):
    prices = [3, 5, 4, 8, 7, 9]
    rows = daily(spark, A=prices)
    state = forecast.pair_sums(rows.where(F.col("tradingdate") <= DAY0))
    for i in range(1, len(prices)):
        known = rows.where(F.col("tradingdate") <= DAY0 + dt.timedelta(days=i))
        kept = [tuple(r) for r in state.collect()]
        state = forecast.incremental_fit(known, spark.createDataFrame(kept, state.schema))
    got, want = state.first(), forecast.pair_sums(rows).first()
    assert got.asDict() == pytest.approx(want.asDict())


def test_series_use_hash_aggregates(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    trades = Inputs(spark, "/root/testdata/sf0.001").trades()
    for df in (series.daily_series(trades), series.latest(daily(spark, A=[1, 2]))):
        assert "HashAggregate" in plan(df) and "SortAggregate" not in plan(df)
    batch = spark.createDataFrame([("X", "a", 1)], "id string, v string, seq int")
    merged = plan(merge.upsert(spark.createDataFrame([("X", "old")], "id string, v string"), batch, "id", "seq"))
    assert "SortAggregate" not in merged


def test_trades_of_one_second_are_ordered_by_price(spark):
    columns = ["trading_date", "time", "symbol", *FEATURES]
    given = [(DAY0, "09:00:00", "A", 2.5, *range(7)), (DAY0, "09:00:00", "A", 2.4, *range(7)), (DAY0, None, "A", 9.0, *range(7)),
             (DAY0, "08:59:59", "A", 9.0, *range(7)), (DAY0, None, "B", -1.0, *range(7)), (DAY0, "x", "B", None, *range(7))]
    kinds = ["date", "string", "string", *["double"] * len(FEATURES)]
    given = [tuple(float(v) if isinstance(v, int) else v for v in row) for row in given]
    df = spark.createDataFrame(given, ", ".join(f"{c} {k}" for c, k in zip(columns, kinds)))
    got = {r.symbol: r.last_price for r in series.daily_series(df).collect()}
    assert got == {"A": 2.5, "B": -1.0}


@pytest.mark.parametrize("target", [6, 40, 1000])
def test_segments_do_not_change_results(spark, target):
    """Missing and malformed times, and a slot of distinct rows above the target."""
    draw = random.Random(2)
    rows = []
    for i in range(260):
        time = draw.choice([None, None, 93000 + i % 60, 93000, 101500])
        day = draw.choice([None, DAY0, DAY0 + dt.timedelta(days=1)])
        rows.append(("hot", day, time, float(i)))
    df = spark.createDataFrame(rows, "k string, day date, clock int, price double").repartition(4)
    df = df.withColumn("slot", ticks.hour_slot(F.col("day"), F.col("clock")))
    order = ["day", "clock", "price"]
    own = sorted(rows, key=lambda r: (r[1] or dt.date.min, -1 if r[2] is None else r[2], r[3]))
    placed = ticks.tick_positions(df, "k", "slot", order, target).collect()
    assert {r.price: r.position for r in placed} == {r[3]: i + 1 for i, r in enumerate(own)}
    runs = ticks.tick_sequences(df, "k", "slot", order, ["price"], 4, target).collect()
    assert {r.label: [s.price for s in r.steps] for r in runs} == {
        own[i][3]: [r[3] for r in own[i - 4:i]] for i in range(4, len(own))}
    sizes = ticks.cut_segments(df, "k", "slot", target, order)[0].groupBy("segment").count().collect()
    assert max(r["count"] for r in sizes) < 2 * target


def test_scaling_takes_each_bound_once(spark):
    plan = series.scaled(daily(spark, A=[1, 2, 3]), ["last_price"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("windowspecdefinition(") == 2


def test_order_of_trades(spark):
    """Time, then price in ten-thousandths; what can't be told comes first."""
    prices = [None, -1e12, -1.5, 0.0, 0.0001, 2.4, 2.5, 1e9, 1e12]
    times = [None, 0, 1, 235959]
    rows = [(t, p) for t in times for p in prices]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, at int, price double")
    order = series._trade_order(F.col("at"), F.col("price"), ["price"]).alias("order")
    assert [r.i for r in df.select("i", order).orderBy("order").collect()] == list(range(len(rows)))
    odd = spark.createDataFrame([(p,) for p in (float("nan"), float("inf"), 1e300, None)], "price double")
    firsts = odd.withColumn("v", F.lit(1)).select(series._trade_order(F.lit(0), F.col("price"), ["v"]))
    assert firsts.distinct().count() == 1


def test_metrics_without_test_rows_are_null(spark):
    got = {r.symbol: r for r in forecast.evaluate(daily(spark, A=[1, 2], B=[1, 3, 2, 5, 4, 6, 5, 8])).collect()}
    assert got["A"].mse is None or got["A"].test_rows > 0
    assert got["B"].test_rows == 2 and got["B"].mse > 0


def test_last_prediction_is_marked(spark):
    rows = forecast.actual_vs_predicted(daily(spark, A=[1, 3, 2, 5])).orderBy("tradingdate").collect()
    assert [r.is_last for r in rows] == [False, False, True]
    assert [r.actual for r in rows] == [3.0, 2.0, 5.0]


def test_fit_of_columns_of_very_different_size(spark):
    rng = np.random.default_rng(4)
    raw = np.column_stack([rng.random(400) * 1e5 + 1e5, rng.random(400) * 1e-2, np.full(400, 3.0)])
    rows = [("A", DAY0 + dt.timedelta(days=i), *map(float, v)) for i, v in enumerate(raw)]
    df = spark.createDataFrame(rows, "symbol string, tradingdate date, a double, b double, c double")
    names = ["a", "b", "c"]
    model = forecast.fit_sequences(series.sequences(series.scaled(df, names), 2, names), 2, names).first()
    low, spread = raw.min(axis=0), np.ptp(raw, axis=0)
    scaled = np.where(spread > 0, (raw - low) / np.where(spread > 0, spread, 1), 0.0)
    x = np.array([np.r_[1, scaled[i - 2:i].ravel()] for i in range(2, len(scaled))])
    want, *_ = np.linalg.lstsq(x, scaled[2:, 0], rcond=None)
    np.testing.assert_allclose([model.intercept, *model.weights], want, atol=1e-7)
    assert model.train_mse == pytest.approx(np.mean((x @ want - scaled[2:, 0]) ** 2), rel=1e-6)


def test_fit_sequences_is_least_squares(spark):
    rng = np.random.default_rng(3)
    names = ["a", "b"]
    values = {k: rng.normal(size=(n, 2)) for k, n in (("hot", 300), ("small", 20))}
    rows = [(k, DAY0 + dt.timedelta(days=i), *map(float, v)) for k, m in values.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "symbol string, tradingdate date, a double, b double").repartition(4)
    models = {r.symbol: r for r in forecast.fit_sequences(series.sequences(df, 3, names), 3, names).collect()}
    for key, m in values.items():
        x = np.array([np.r_[1, m[i - 3:i].ravel()] for i in range(3, len(m))])
        want, *_ = np.linalg.lstsq(x, m[3:, 0], rcond=None)
        assert models[key].n == len(x)
        np.testing.assert_allclose([models[key].intercept, *models[key].weights], want, atol=1e-8)
        assert models[key].train_mse == pytest.approx(np.mean((x @ want - m[3:, 0]) ** 2))
