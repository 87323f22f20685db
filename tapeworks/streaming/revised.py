"""Bars that are revised as ticks come, with late ticks as rows: keyed state and event-time timers.

State is keyed by symbol and bar, not by symbol, so a busy symbol spreads over all tasks, and holds one small row for
each open bar. Every micro-batch that brings ticks of a bar gives its next revision; a timer at the bar's end, by the
watermark, closes it and frees its state. Ticks of bars that had ended when the batch began come out one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeworks.operators.bars import tick_order

#: A bar as state keeps it, with the places of its first and last tick in the order of ticks.
_STATE = (
    "open double, high double, low double, close double, volume double, value double, first decimal(38,0), last decimal(38,0),"
    " begun bigint, ticks bigint, revision bigint"
)
KINDS = ("revised", "closed", "late")
#: Times pass through Python as microseconds.
SCHEMA = (
    "symbol string, bar_start bigint, bar_end bigint, kind string, revision bigint, open double, high double,"
    " low double, close double, volume double, value double, begun bigint, ticks bigint,"
    " event_ts bigint, price double, tick_volume double, tick_id bigint"
)
_TIMES = ("bar_start", "bar_end", "begun", "event_ts")
_FIELDS = [part.split()[0] for part in SCHEMA.split(",")]
_NO_TICK, _NO_BAR = (None,) * 4, (None,) * 9


class Revisions(StatefulProcessor):
    """Merges the ticks of one bar into its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        end_ms = key[2] // 1000
        if end_ms <= timerValues.getCurrentWatermarkInMs():
            for r in rows:
                yield self._row(key, "late", _NO_BAR, (r.event_ts, r.price, r.volume, r.tick_id))
            return
        known = self.bar.get()
        if known is None:
            self.handle.registerTimer(end_ms)
            bar = [None] * 9 + [0, 0]
        else:
            bar = list(known)
        for r in rows:
            self._merge(bar, r)
        bar[10] += 1
        self.bar.update(tuple(bar))
        yield self._row(key, "revised", self._shown(bar), _NO_TICK)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        bar = self.bar.get()
        self.bar.clear()
        if bar is not None:
            yield self._row(key, "closed", self._shown(bar), _NO_TICK)

    def close(self) -> None:
        pass

    @staticmethod
    def _merge(bar: list, r: Row) -> None:
        """One tick; NULL prices and volumes count as ticks and change nothing else, as in the bars of tables."""
        at = r.tick_at
        bar[9] += 1
        bar[8] = r.event_ts if bar[8] is None else min(bar[8], r.event_ts)
        if bar[6] is None or at < bar[6]:
            bar[0], bar[6] = r.price, at
        if bar[7] is None or at >= bar[7]:
            bar[3], bar[7] = r.price, at
        if r.price is not None:
            bar[1] = r.price if bar[1] is None else max(bar[1], r.price)
            bar[2] = r.price if bar[2] is None else min(bar[2], r.price)
        if r.volume is not None:
            bar[4] = (bar[4] or 0.0) + r.volume
            if r.price is not None:
                bar[5] = (bar[5] or 0.0) + r.price * r.volume

    @staticmethod
    def _shown(bar: list) -> tuple:
        return (bar[10], *bar[:6], bar[8], bar[9])

    @staticmethod
    def _row(key: tuple, kind: str, bar: tuple, tick: tuple) -> Row:
        return Row(*_FIELDS)(*key, kind, *bar, *tick)


def revised_bars(
    ticks: DataFrame, interval: str = "1 minute", delay: str = "0 seconds", tick_id: str = "tick_id"
) -> DataFrame:
    """A stream of bar revisions, closed bars and late ticks (``kind``) from a stream of ticks.

    ``ticks`` needs ``symbol``, ``event_ts``, ``price``, ``volume`` and a number ``tick_id`` that orders ticks of one
    instant. A tick is late if its bar ended at or before the watermark (the latest tick of the earlier batches less
    ``delay``). Rows without a time are left out, as in the bars of tables. A batch that is run again after a failure
    gives the same rows. Needs the RocksDB state store; start it inside ``rocksdb_state``.
    """
    # the copy of the time has no watermark of its own, so the operator gets late rows too
    timed = ticks.where("event_ts IS NOT NULL").withWatermark("event_ts", delay).select(
        "symbol", (F.col("event_ts") + F.expr("INTERVAL 0 SECONDS")).alias("_at"),
        F.col("price").cast("double").alias("price"), F.col("volume").cast("double").alias("volume"),
        F.col(tick_id).cast("bigint").alias("tick_id"),
    )
    bar = F.window("_at", interval)
    order = tick_order(F.col("_at"), F.col("tick_id"), F.col("price"))
    keyed = timed.select(bar.alias("_bar"), "*").select(
        "symbol", F.unix_micros("_bar.start").alias("bar_start"), F.unix_micros("_bar.end").alias("bar_end"),
        F.unix_micros("_at").alias("event_ts"), "price", "volume", "tick_id", order.alias("tick_at"),
    )
    rows = keyed.groupBy("symbol", "bar_start", "bar_end").transformWithState(
        statefulProcessor=Revisions(), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime"
    )
    return rows.withColumns({name: F.timestamp_micros(name) for name in _TIMES})


def last_revisions(rows: DataFrame) -> DataFrame:
    """The latest state of every bar in a table of what ``revised_bars`` gave."""
    bars = rows.where("kind <> 'late'")
    columns = [c for c in _FIELDS[4:13] if c != "revision"]
    newest = F.max_by(F.struct(*columns), F.col("revision") * 2 + (F.col("kind") == "closed").cast("int"))
    closed = F.bool_or(F.col("kind") == "closed")
    return (
        bars.groupBy("symbol", "bar_start", "bar_end")
        .agg(newest.alias("_bar"), closed.alias("closed"), F.max("revision").alias("revisions"))
        .select("symbol", "bar_start", "bar_end", "_bar.*", "closed", "revisions")
    )


def late_ticks(rows: DataFrame) -> DataFrame:
    """The late ticks in a table of what ``revised_bars`` gave."""
    return rows.where("kind = 'late'").select("symbol", "event_ts", "price", F.col("tick_volume").alias("volume"), "tick_id")
