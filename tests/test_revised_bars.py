"""Revised bars against a plain version, batch by batch and over restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeworks.operators.bars import bars
from tapeworks.session import scratch_path
from tapeworks.streaming.jobs import rocksdb_state, to_table
from tapeworks.streaming.revised import last_revisions, late_ticks, revised_bars

SCHEMA = "symbol string, event_ts timestamp, price double, volume double, tick_id bigint"
START = dt.datetime(2025, 1, 6, 9)


def batches_of_ticks(seed, count=4, size=60):
    """Batches that move on by two minutes each, with ticks up to six minutes old, ties and missing values."""
    rng, number, out = random.Random(seed), 0, []
    for batch in range(count):
        rows = []
        for _ in range(size):
            seconds = 360 + batch * 120 - rng.choice([0, 5, 20, 60, 120, 200, 360]) + rng.randrange(20)
            price = None if rng.random() < 0.05 else float(rng.randrange(90, 110))
            volume = None if rng.random() < 0.05 else float(rng.randrange(1, 9))
            rows.append((rng.choice("AAAB"), START + dt.timedelta(seconds=seconds), price, volume, number))
            number += 1
        rows.append((None, START + dt.timedelta(seconds=360 + batch * 120), 1.0, 1.0, number))
        rows.append(("A", None, 1.0, 1.0, number + 1))
        number += 2
        out.append(rows)
    return out


def streamed(spark, batches, delay):
    path = scratch_path(spark, "revised-test")
    for rows in batches:  # a restart after every batch
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/ticks")
        ticks = spark.readStream.schema(SCHEMA).parquet(f"{path}/ticks")
        with rocksdb_state(spark):
            to_table(revised_bars(ticks, delay=delay), f"{path}/out", f"{path}/checkpoint", once=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def plain(batches, delay):
    """Ids in time, late ids, and the watermark at the end."""
    mark, kept, late = None, set(), set()
    for rows in batches:
        timed = [r for r in rows if r[1] is not None]
        for r in timed:
            end = r[1].replace(second=0) + dt.timedelta(minutes=1)
            (late if mark is not None and end <= mark else kept).add(r[4])
        latest = max(r[1] for r in timed) - delay
        mark = latest if mark is None else max(mark, latest)
    return kept, late, mark


@pytest.mark.parametrize(("seed", "seconds"), [(1, 0), (2, 90)])
def test_revisions_and_late_ticks(spark, seed, seconds):
    batches = batches_of_ticks(seed)
    kept, late, mark = plain(batches, dt.timedelta(seconds=seconds))
    rows = streamed(spark, batches, f"{seconds} seconds").cache()
    assert late and {r.tick_id for r in late_ticks(rows).collect()} == late
    assert late_ticks(rows).count() == len(late)

    ticks = spark.createDataFrame([r for batch in batches for r in batch if r[4] in kept], SCHEMA)
    columns = ["symbol", "bar_start", "bar_end", "open", "high", "low", "close", "volume", "value", "ticks"]
    want = bars(ticks, tick_id="tick_id").select(*columns)
    got = last_revisions(rows)
    assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want.collect()))
    ended = {(r.symbol, r.bar_start) for r in want.collect() if r.bar_end <= mark}
    assert {(r.symbol, r.bar_start) for r in got.where("closed").collect()} == ended
    # each bar is closed once, and its revisions count up from 1
    seen = rows.where("kind = 'revised'").groupBy("symbol", "bar_start").agg(F.sort_array(F.collect_list("revision")).alias("n"))
    assert all(r.n == list(range(1, len(r.n) + 1)) for r in seen.collect()) and seen.where("size(n) > 1").count()
    assert rows.where("kind = 'closed'").count() == len(ended)
