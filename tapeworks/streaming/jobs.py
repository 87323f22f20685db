"""Streaming jobs: raw ingestion, candles and stateless maps, and running several side by side."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from threading import Condition

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from tapeworks.operators.bars import bars
from tapeworks.schemas import CHANNELS
from tapeworks.sources.messages import decode_envelopes
from tapeworks.sources.versions import Change, Snapshot, Versions

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Start queries with state kept in RocksDB rather than on the executors' heap."""
    before = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_PROVIDER)
        else:
            spark.conf.set(STATE_PROVIDER, before)


def read_text_messages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Messages landed as lines of text files, as a ``value`` stream."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


PARTITIONS = ["rejected", "trading_date"]


def batch_writer(channel: str, path: str, run: str | None = None) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch of envelopes to the raw table at ``path``, by rejection and trading date.

    A batch goes to a folder of its own and counts from the version that names it. The run is the id of the
    query, which Spark keeps with the checkpoint: a batch of a run that is stored already is handed over
    again only after a failure, and is left out, so every message is stored once; batches of a new
    checkpoint never meet those of an older one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        known = run or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not known:
            raise ValueError("a batch writer outside a stream needs the id of its run")
        versions = Versions(batch.sparkSession, path)
        if versions.snapshot().batches.get(known, -1) >= batch_id:
            return
        decoded = decode_envelopes(batch, CHANNELS[channel])
        rejected = F.col("reject_reason").isNotNull()
        rows = decoded.withColumn("_message", F.when(rejected, F.col("_message"))).withColumn("rejected", rejected)
        below = f"run={known}/batch_id={batch_id}/attempt={uuid.uuid4().hex}"
        added = versions.write(rows, below, PARTITIONS)

        def stored(now: Snapshot) -> Change | None:
            if now.batches.get(known, -1) >= batch_id:
                return None  # another attempt was faster
            return Change(add=added, batches={known: batch_id})

        versions.change(stored)

    return write


def compact(spark: SparkSession, channel: str, path: str, before: str) -> int:
    """Merge the good rows of each day before ``before`` into few files; returns the folders replaced.

    Works beside streams that write and readers: exactly the folders of the version it starts from are merged, the
    merged ones replace them in one version, and batches that land meanwhile stay beside them. Replaced folders are
    there for readers that have opened them until ``vacuum``. A job that breaks off changes nothing.
    """
    versions = Versions(spark, path)
    by_day: dict[str, list[str]] = {}
    for folder in versions.snapshot().folders:
        if "/rejected=false/" in folder:
            by_day.setdefault(folder.rpartition("=")[2], []).append(folder)
    old = frozenset(
        folder for day, own in by_day.items() if day < before and any("run=compacted" not in name for name in own) for folder in own
    )
    if not old:
        return 0
    merged = versions.read(_raw_schema(channel), old).drop("run", "batch_id", "attempt")
    below = f"run=compacted/batch_id=0/attempt={uuid.uuid4().hex}"
    added = versions.write(merged.hint("rebalance", "trading_date"), below, PARTITIONS)
    versions.change(lambda now: Change(add=added, drop=old))
    return len(old)


def vacuum_raw(spark: SparkSession, path: str, hours: float = 24) -> int:
    """Delete folders of a raw table that no version of the last ``hours`` names; returns how many."""
    return Versions(spark, path).vacuum(hours, depth=5)


def sent_once(messages: DataFrame, within: str = "1 hour") -> DataFrame:
    """A stream of messages (``value``) without those sent again ``within`` that time after they first arrived.

    State holds a digest per message until the time has passed, over batches and restarts. It runs on arrival, not on
    the time in the message: no message is ever too late, however old its trading date, and rejected ones have none.
    """
    arrived = messages.withColumn("_arrived", F.current_timestamp()).withColumn(
        "_digest", F.sha2(F.coalesce(F.col("value").cast("string"), F.lit("")), 256)
    )
    first = arrived.withWatermark("_arrived", within).dropDuplicatesWithinWatermark(["_digest"])
    return first.drop("_arrived", "_digest")


def ingest(
    messages: DataFrame, channel: str, path: str, checkpoint: str, once: bool = False, every: str = "1 second"
) -> DataStreamWriter:
    """Append a channel's messages to its raw table; ``once`` stops when the backlog is done."""
    writer = messages.writeStream.foreachBatch(batch_writer(channel, path)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)


def _raw_schema(channel: str) -> str:
    columns = [f"`{c}` {kind}" for _, c, kind in CHANNELS[channel]]
    return ", ".join([
        *columns, "`_message` string, reject_reason string, run string, batch_id bigint, attempt string, rejected boolean"
    ])


def _stored(spark: SparkSession, channel: str, path: str, rejected: bool) -> DataFrame:
    versions = Versions(spark, path)
    kind = f"/rejected={str(rejected).lower()}/"
    folders = frozenset(folder for folder in versions.snapshot().folders if kind in folder)
    return versions.read(_raw_schema(channel), folders)


def raw_table(spark: SparkSession, channel: str, path: str) -> DataFrame:
    """The typed rows of the latest version, in folders by trading date: a filter on it reads only those days.

    Later changes of the table don't touch what was opened here.
    """
    return _stored(spark, channel, path, False).select(*[c for _, c, _ in CHANNELS[channel]])


def rejected_messages(spark: SparkSession, channel: str, path: str) -> DataFrame:
    rows = _stored(spark, channel, path, True)
    return rows.select(F.col("_message").alias("message"), "reject_reason", "batch_id")


def candle_stream(
    ticks: DataFrame,
    interval: str = "1 minute",
    delay: str = "0 seconds",
    symbol: str = "symbol",
    tick_id: str | None = None,
) -> DataFrame:
    """Bars of a tick stream. A bar is emitted once event time passes its end by ``delay``;
    ticks that come after that are dropped (``LateTicks`` counts them)."""
    return bars(ticks.withWatermark("event_ts", delay), interval, symbol, "event_ts", tick_id)


def to_table(rows: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = "1 second") -> DataStreamWriter:
    """Append a stream to a parquet table."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)


def to_console(rows: DataFrame) -> DataStreamWriter:
    """Print a stream batch by batch, to look at it."""
    return rows.writeStream.format("console").outputMode("append").option("truncate", False)


class LateTicks(StreamingQueryListener):
    """Counts the rows that each run of a query dropped behind its watermark, over all its batches.

    Add it with ``spark.streams.addListener`` before the queries start.
    """

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()
        self.ended: set[str] = set()
        self.news = Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self.news:
            operators = event.progress.stateOperators
            self.dropped[str(event.progress.runId)] += sum(op.numRowsDroppedByWatermark for op in operators)

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def of(self, query: StreamingQuery, patience: float = 30) -> int:
        """Rows dropped so far; of a query that has ended, all of them."""
        run = str(query.runId)
        with self.news:
            if not query.isActive:
                self.news.wait_for(lambda: run in self.ended, patience)
            return self.dropped[run]


def start_all(writers: dict[str, DataStreamWriter]) -> dict[str, StreamingQuery]:
    """Start several streams in one session."""
    return {name: writer.queryName(name).start() for name, writer in writers.items()}


def as_they_end(queries: dict[str, StreamingQuery]) -> Iterator[tuple[str, str | None]]:
    """Name and error (None without one) of every stream, as soon as it ends while the others go on."""
    left = dict(queries)
    while left:
        for name, query in list(left.items()):
            if not query.isActive:
                del left[name]
                error = query.exception()
                yield name, None if error is None else str(error)
        if left:
            manager = SparkSession.active().streams
            with suppress(StreamingQueryException):  # read from the query itself above
                manager.awaitAnyTermination(1)
            manager.resetTerminated()


def wait_all(queries: dict[str, StreamingQuery]) -> dict[str, str]:
    """Wait until every stream has ended; returns the error of each one that failed.

    For streams without an end use ``as_they_end``, which reports each failure when it happens.
    """
    return {name: error for name, error in as_they_end(queries) if error is not None}
