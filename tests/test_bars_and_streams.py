import datetime as dt
import json
import pathlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tapeworks import schemas
from tapeworks.operators import star
from tapeworks.operators.bars import bars, candles
from tapeworks.plans.inputs import Inputs
from tapeworks.session import scratch_path
from tapeworks.sources.messages import decode_ticks, good
from tapeworks.sources.stores import RawStore
from tapeworks.sources.versions import Change, Conflict, Versions
from tapeworks.streaming import jobs


def at(minute, second):
    return dt.datetime(2025, 1, 6, 9, minute, second)


def tick_table(spark, *rows):
    return spark.createDataFrame(list(rows), "symbol string, event_ts timestamp, price double, volume double, id bigint")


@pytest.mark.parametrize("tick_id", ["id", None])
def test_candle(spark, tick_id):
    ticks = tick_table(spark, ("A", at(0, 10), 10.0, 1.0, 1), ("A", at(0, 50), 12.0, 2.0, 2), ("A", at(0, 30), 8.0, 3.0, 3),
                       ("B", at(0, 5), 20.0, 1.0, 4))
    got = {r.symbol: r for r in bars(ticks, tick_id=tick_id).collect()}
    a, b = got["A"], got["B"]
    assert (a.open, a.high, a.low, a.close, a.volume, a.value) == (10.0, 12.0, 8.0, 12.0, 6.0, 58.0)
    assert a.timestamp == int(at(0, 10).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert b.open == b.high == b.low == b.close == 20.0
    assert candles(bars(ticks)).columns == ["symbol", "open", "close", "high", "low", "volume", "timestamp"]


def test_ties_follow_the_id(spark):
    ticks = tick_table(spark, ("A", at(0, 1), 5.0, 1.0, 9_000_000_000_000_000_000), ("A", at(0, 1), 7.0, 1.0, -3),
                       ("A", at(0, 1), 6.0, 1.0, 2))
    row = bars(ticks, tick_id="id").first()
    assert (row.open, row.close) == (7.0, 5.0)


def test_bars_keep_volume_and_order_of_prices(spark):
    ticks = Inputs(spark, "/root/testdata/sf0.001").ticks()
    rows = bars(ticks, "1 hour", tick_id="event_id")
    assert rows.where("low > open or low > close or high < open or high < close").count() == 0
    assert rows.agg(F.sum("volume")).first()[0] == ticks.agg(F.sum("volume")).first()[0]


def test_bars_use_a_hash_aggregate(spark):
    ticks = tick_table(spark, ("A", at(0, 1), 5.0, 1.0, 1))
    for tick_id in ("id", None):
        plan = bars(ticks, tick_id=tick_id)._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def land(folder: pathlib.Path, name: str, *messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(m + "\n" for m in messages))


def tick_message(minute, second, price):
    ms = int(at(minute, second).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    return json.dumps({"symbol": "A", "price": price, "volume": 1, "timestamp": ms})


def test_late_tick_does_not_change_a_closed_bar(spark, tmp_path):
    inbox, out = tmp_path / "in", scratch_path(spark, "test_candles")
    late_ticks = jobs.LateTicks()
    spark.streams.addListener(late_ticks)

    def run(name, *messages):
        land(inbox, name, *messages)
        ticks = good(decode_ticks(jobs.read_text_messages(spark, str(inbox))))
        closed = jobs.candle_stream(ticks)
        with jobs.rocksdb_state(spark):
            started = jobs.to_table(closed, out, f"{out}-checkpoint", once=True).start()
            started.awaitTermination()
        rows = spark.read.schema(closed.schema).parquet(out).orderBy("bar_start").collect()
        return [(r.bar_start.minute, r.open, r.close, r.ticks) for r in rows], late_ticks.of(started)

    assert run("1", tick_message(0, 10, 10), tick_message(0, 50, 12)) == ([], 0)
    assert run("2", tick_message(2, 5, 20)) == ([(0, 10.0, 12.0, 2)], 0)
    bars_now, late = run("3", tick_message(0, 55, 99), tick_message(3, 5, 21))
    assert bars_now == [(0, 10.0, 12.0, 2), (2, 20.0, 20.0, 1)]
    assert late == 1
    spark.streams.removeListener(late_ticks)


def test_late_ticks_of_many_batches_are_all_counted():
    late = jobs.LateTicks()
    for _ in range(250):
        operators = [SimpleNamespace(numRowsDroppedByWatermark=2), SimpleNamespace(numRowsDroppedByWatermark=1)]
        late.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(runId="r", stateOperators=operators)))
    assert late.of(SimpleNamespace(runId="r", isActive=True)) == 750


def test_ingest_keeps_good_and_rejected_rows_and_replays_once(spark, tmp_path):
    inbox, raw = tmp_path / "in", scratch_path(spark, "test_raw")
    message = lambda symbol, day="06/01/2025": json.dumps(
        {"Content": json.dumps({"Symbol": symbol, "LastPrice": 1, "TradingDate": day})})
    runs = []

    def run(checkpoint="checkpoint"):
        query = jobs.ingest(
            jobs.read_text_messages(spark, str(inbox)), "trade", raw, f"{raw}-{checkpoint}", once=True).start()
        query.awaitTermination()
        runs.append(query.id)

    land(inbox, "1", message("A"), "broken", message("B"))
    run()
    land(inbox, "2", message("C"))
    run()
    stored = jobs.raw_table(spark, "trade", raw)
    assert stored.columns == [c for _, c, _ in schemas.CHANNELS["trade"]]
    assert sorted(r.symbol for r in stored.collect()) == ["A", "B", "C"]
    assert [(r.message, r.batch_id) for r in jobs.rejected_messages(spark, "trade", raw).collect()] == [("broken", 0)]
    # the last batch handed over again after a failure
    jobs.batch_writer("trade", raw, runs[-1])(spark.createDataFrame([(message("C"),)], "value string"), 1)
    assert jobs.raw_table(spark, "trade", raw).count() == 3 and len(set(runs)) == 1
    # a new checkpoint starts at batch 0 again and destroys nothing
    run("new-checkpoint")
    assert jobs.raw_table(spark, "trade", raw).count() == 6 and len(set(runs)) == 2
    with pytest.raises(ValueError, match="id of its run"):
        jobs.batch_writer("trade", raw)(spark.createDataFrame([("x",)], "value string"), 0)
    assert RawStore(spark, raw).read("dim_date").count() == 0


def test_raw_days_are_pruned_and_compacted(spark, tmp_path):
    root = scratch_path(spark, "test_raw")
    raw = f"{root}/trade"
    message = lambda symbol, day: json.dumps({"Content": json.dumps({"Symbol": symbol, "TradingDate": day})})
    for batch in range(4):
        days = [f"0{d}/01/2025" for d in (6, 7, 8)]
        given = [(message(f"S{batch}", day),) for day in days] + [(message("N", None),), ("broken",)]
        jobs.batch_writer("trade", raw, "r")(spark.createDataFrame(given, "value string"), batch)
    store = RawStore(spark, root)
    rows = lambda: sorted((r.symbol, str(r.trading_date)) for r in store.read("raw_trade").collect())
    before = rows()
    recent = star.recent(store.read("raw_trade"), "2025-01-08", 1)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "trading_date" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert recent.count() == 8
    assert jobs.compact(spark, "trade", raw, "2025-01-08") == 8
    assert rows() == before and jobs.rejected_messages(spark, "trade", raw).count() == 4
    assert jobs.compact(spark, "trade", raw, "2025-01-08") == 0
    assert star.recent(store.read("raw_trade"), "2025-01-08", 1).count() == 8
    files = [f for f in store.read("raw_trade").inputFiles() if "2025-01-06" in f]
    assert len(files) == 1


def _batches(spark, raw, *batches, run="r"):
    for number, symbols in batches:
        given = [(json.dumps({"Content": json.dumps({"Symbol": s, "TradingDate": day})}),)
                 for s in symbols for day in ("06/01/2025", "07/01/2025")]
        jobs.batch_writer("trade", raw, run)(spark.createDataFrame(given, "value string"), number)


def _symbols(rows):
    return sorted(r.symbol for r in rows.collect())


def test_a_reader_in_the_middle_of_a_compaction_sees_every_row_once(spark, monkeypatch):
    raw = f"{scratch_path(spark, 'test_raw')}/trade"
    _batches(spark, raw, (0, "AB"), (1, "C"))
    want = sorted("AABBCC")
    opened, seen, change = jobs.raw_table(spark, "trade", raw), [], Versions.change

    def watched(self, plan):
        # merged rows are written, but do not count yet; a late batch lands before they do
        seen.append(_symbols(jobs.raw_table(spark, "trade", raw)))
        monkeypatch.setattr(Versions, "change", change)
        _batches(spark, raw, (2, "D"))
        return change(self, plan)

    monkeypatch.setattr(Versions, "change", watched)
    assert jobs.compact(spark, "trade", raw, "2025-01-09") == 4
    assert seen == [want] and _symbols(opened) == want
    assert _symbols(jobs.raw_table(spark, "trade", raw)) == want + ["D", "D"]
    # the late batch is merged with the merged days
    assert jobs.compact(spark, "trade", raw, "2025-01-09") == 4
    assert jobs.compact(spark, "trade", raw, "2025-01-09") == 0
    assert _symbols(jobs.raw_table(spark, "trade", raw)) == want + ["D", "D"]
    assert jobs.vacuum_raw(spark, raw) == 0 and _symbols(opened) == want
    assert jobs.vacuum_raw(spark, raw, hours=-1) == 8
    assert _symbols(jobs.raw_table(spark, "trade", raw)) == want + ["D", "D"]
    assert len(jobs.raw_table(spark, "trade", raw).inputFiles()) == 2


@pytest.mark.parametrize("step", ["write", "change", "_publish"])
def test_a_job_that_dies_at_any_step_changes_nothing(spark, monkeypatch, step):
    raw = f"{scratch_path(spark, 'test_raw')}/trade"
    _batches(spark, raw, (0, "AB"), (1, "C"))
    for work in (lambda: jobs.compact(spark, "trade", raw, "2025-01-09"), lambda: _batches(spark, raw, (2, "D"))):
        with monkeypatch.context() as patched:
            own = getattr(Versions, step)

            def dies(self, *given, own=own):
                if step == "write":
                    own(self, *given)
                raise OSError("executor lost")

            patched.setattr(Versions, step, dies)
            with pytest.raises(OSError):
                work()
        assert _symbols(jobs.raw_table(spark, "trade", raw)) == sorted("AABBCC")
        work()
    assert _symbols(jobs.raw_table(spark, "trade", raw)) == sorted("AABBCCDD")
    _batches(spark, raw, (0, "AB"), (2, "D"))  # handed over again, and after a compaction
    assert _symbols(jobs.raw_table(spark, "trade", raw)) == sorted("AABBCCDD")


def test_one_of_two_writers_with_one_number_tries_again(spark):
    path = f"{scratch_path(spark, 'test_versions')}/t"
    one, two = Versions(spark, path), Versions(spark, path)
    late = []

    def plan(now):
        if not late:
            late.append(two.change(lambda _: Change(add=frozenset({"b"}), batches={"y": 1})).version)
        return Change(add=frozenset({"a"}), batches={"x": 3})

    assert one.change(plan).version == 2 and late == [1]
    for i in range(70):
        one.change(lambda now, i=i: Change(add=frozenset({f"n{i}"}), drop=frozenset({f"n{i - 1}"}) & now.folders))
    now = two.snapshot()
    assert now.folders == {"a", "b", "n69"} and now.batches == {"x": 3, "y": 1} and now.version == 72
    assert two.snapshot(2).folders == {"a", "b"}
    with pytest.raises(Conflict):
        two.change(lambda _: Change(drop=frozenset({"n3"})))


def test_messages_sent_again_are_stored_once(spark, tmp_path):
    inbox, out = tmp_path / "in", scratch_path(spark, "test_sent")

    def run(name, *messages):
        land(inbox, name, *messages)
        stream = jobs.sent_once(jobs.read_text_messages(spark, str(inbox)))
        with jobs.rocksdb_state(spark):
            jobs.to_table(stream, out, f"{out}-checkpoint", once=True).start().awaitTermination()
        return sorted(r.value for r in spark.read.schema("value string").parquet(out).collect())

    assert run("1", "a", "b", "a") == ["a", "b"]
    # a later batch after a restart, with messages of the first
    assert run("2", "b", "c", "a", "c") == ["a", "b", "c"]
    assert run("3", "a", "old 01/01/1999") == ["a", "b", "c", "old 01/01/1999"]


def test_side_by_side_streams_report_the_failing_one(spark, tmp_path):
    writers = {}
    for name in ("trade", "quote", "index"):
        land(tmp_path / name, "1", json.dumps({"Content": "{}"}))
        stream = jobs.read_text_messages(spark, str(tmp_path / name))
        if name == "quote":
            stream = stream.select(F.raise_error(F.lit("broken feed")).cast("string").alias("value"))
        path = scratch_path(spark, f"test_{name}")
        writers[name] = jobs.ingest(stream, name, path, f"{path}-checkpoint", once=True)
    errors = jobs.wait_all(jobs.start_all(writers))
    assert list(errors) == ["quote"] and "broken feed" in errors["quote"]


def test_a_failing_stream_is_reported_while_an_endless_one_runs(spark, tmp_path):
    land(tmp_path / "quote", "1", "x")
    broken = jobs.read_text_messages(spark, str(tmp_path / "quote")).select(
        F.raise_error(F.lit("broken feed")).cast("string").alias("value"))
    endless = spark.readStream.format("rate").option("rowsPerSecond", 5).load().select(F.col("value").cast("string"))
    writers = {
        name: stream.writeStream.format("noop").option("checkpointLocation", scratch_path(spark, f"test_{name}"))
        for name, stream in {"endless": endless, "quote": broken}.items()
    }
    queries = jobs.start_all(writers)
    try:
        name, error = next(jobs.as_they_end(queries))
        assert name == "quote" and "broken feed" in error and queries["endless"].isActive
    finally:
        queries["endless"].stop()


def test_stateless_map(spark, tmp_path):
    land(tmp_path / "n", "1", *"12345")
    out = scratch_path(spark, "test_map")
    mapped = jobs.read_text_messages(spark, str(tmp_path / "n")).select((F.col("value").cast("int") * 10).alias("x"))
    jobs.to_table(mapped, out, f"{out}-checkpoint", once=True).start().awaitTermination()
    assert sorted(r.x for r in spark.read.schema("x int").parquet(out).collect()) == [10, 20, 30, 40, 50]
