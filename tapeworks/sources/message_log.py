"""A log of messages in files, as a stream source with offsets and a sink with commit and abort.

Each writer (one stream, one name) owns a folder. A task writes its rows to one file of its own; when all tasks of a batch are
done, one small entry names their files, and from then on they count::

    <path>/<writer>/data/<any name>.parquet
    <path>/<writer>/entries/<batch>-<offset of its first message>-<messages>.json

Offsets number the messages of a writer from 0 without gaps, so the names of the entries are enough to plan a batch, and any
span of offsets can be read again with the same messages. A batch whose entry exists is not entered twice; files of tasks
that failed, or of a batch that was aborted, are named by no entry and never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.streaming import DataStreamWriter

FORMAT = "message_log"
SCHEMA = "value string, partition string, offset bigint"
READ_ROWS = 10_000


@dataclass(frozen=True)
class Entry:
    batch: int
    first: int
    rows: int
    file: str

    @property
    def end(self) -> int:
        return self.first + self.rows


def _store(path: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return store, root.rstrip("/")


def _entries(store: fs.FileSystem, root: str, writer: str) -> list[Entry]:
    """The entries of a writer in order, from their names alone."""
    found = store.get_file_info(fs.FileSelector(f"{root}/{writer}/entries", allow_not_found=True))
    names = [f.base_name for f in found if f.base_name.endswith(".json") and f.base_name[0] != "."]
    parts = [(*map(int, name.removesuffix(".json").split("-")), f"{root}/{writer}/entries/{name}") for name in names]
    return sorted((Entry(*part) for part in parts), key=lambda entry: entry.batch)


def _writers(store: fs.FileSystem, root: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name[0] not in "._")


def _publish(store: fs.FileSystem, path: str, text: str) -> None:
    """Write a small file that others see whole or not at all. A file that is there already stays: its name says
    what it holds."""
    if store.get_file_info(path).type != fs.FileType.NotFound:
        return
    folder = path.rpartition("/")[0]
    store.create_dir(folder, recursive=True)
    beside = f"{folder}/.{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as out:
        out.write(text.encode())
    store.move(beside, path)


class Piece(InputPartition):
    """Messages ``skip`` to ``skip + take`` of a file; the first of them has ``offset``."""

    def __init__(self, file: str, writer: str, skip: int, take: int, offset: int) -> None:
        self.file, self.writer, self.skip, self.take, self.offset = file, writer, skip, take, offset


class LogReader(DataSourceStreamReader):
    """Options: ``path``; ``start``, ``earliest`` or ``latest``, for the first run of a checkpoint; ``limit`` of messages
    in a batch, with ``progress``, a folder of this checkpoint alone.

    Spark does not tell a restarted source where it stands before it asks for the next end. A limit counts
    from there, so the end of each planned batch is kept in ``progress``; Spark has stored it in the checkpoint before.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.start = options["path"], options.get("start", "earliest")
        self.limit, self.progress = int(options.get("limit", 0)), options.get("progress")
        if self.start not in ("earliest", "latest"):
            raise ValueError("start is earliest or latest")
        if self.limit and not self.progress:
            raise ValueError("a limit needs a progress folder")
        self.position: dict[str, int] | None = None
        self.first: dict[str, int] | None = None

    def _ends(self) -> dict[str, int]:
        store, root = _store(self.path)
        ends = {}
        for writer in _writers(store, root):
            if entries := _entries(store, root, writer):
                ends[writer] = entries[-1].end
        return ends

    def initialOffset(self) -> dict:
        # Spark may have asked for the first end before: the query then starts from what was there at that time
        if self._kept() is None:
            found = self._ends() if self.first is None else self.first
            self._keep(found if self.start == "latest" else {})
        return self.position

    def latestOffset(self) -> dict:
        ends = self._ends()
        if self._kept() is None:
            if not self.limit:
                self.first = self.first or ends
                return ends
            self._keep(ends if self.start == "latest" else {})
        if not self.limit:
            return ends
        position = self.position
        # every writer gets an even share; what some leave over goes to the others
        wanted, left = dict(position), self.limit
        behind = {w: end - position.get(w, 0) for w, end in ends.items() if end > position.get(w, 0)}
        while behind and left > 0:
            share = max(1, left // len(behind))
            for writer in list(behind):
                taken = min(share, behind[writer], left)
                wanted[writer] = wanted.get(writer, 0) + taken
                left -= taken
                behind[writer] -= taken
                if not behind[writer]:
                    del behind[writer]
        return wanted

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self._keep(end)
        store, root = _store(self.path)
        pieces = []
        for writer, until in end.items():
            begin = start.get(writer, 0)
            for entry in _entries(store, root, writer):
                if entry.end <= begin or entry.first >= until:
                    continue
                with store.open_input_stream(entry.file) as text:
                    files = json.loads(text.read())
                at = entry.first
                for name, rows in files:
                    low, high = max(at, begin), min(at + rows, until)
                    if low < high:
                        pieces.append(Piece(f"{root}/{writer}/data/{name}", writer, low - at, high - low, low))
                    at += rows
        return pieces

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        with store.open_input_file(piece.file) as data:
            file = pq.ParquetFile(data)
            # whole row groups before the span are not read
            groups, before = [], 0
            skip = piece.skip
            for group in range(file.num_row_groups):
                rows = file.metadata.row_group(group).num_rows
                if before + rows <= piece.skip:
                    skip -= rows
                elif before < piece.skip + piece.take:
                    groups.append(group)
                before += rows
            left, offset = piece.take, piece.offset
            for batch in file.iter_batches(READ_ROWS, row_groups=groups, columns=["value"]):
                part = batch.slice(skip, left)
                skip = max(0, skip - batch.num_rows)
                if not part.num_rows:
                    continue
                yield pa.RecordBatch.from_arrays([
                    part.column(0).cast(pa.string()), pa.array([piece.writer] * part.num_rows, pa.string()),
                    pa.array(range(offset, offset + part.num_rows), pa.int64()),
                ], names=["value", "partition", "offset"])
                left, offset = left - part.num_rows, offset + part.num_rows

    def commit(self, end: dict) -> None:
        """Nothing: the log keeps its messages."""

    def _keep(self, position: dict) -> None:
        self.position = dict(position)
        if self.limit:
            store, root = _store(self.progress)
            before = self._positions(store, root)
            # positions only grow, and so do their names; the last one stays until the next is there
            path = f"{root}/{sum(position.values()):020d}.json"
            _publish(store, path, json.dumps(position))
            for old in before:
                if old < path:
                    store.delete_file(old)

    @staticmethod
    def _positions(store: fs.FileSystem, root: str) -> list[str]:
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f"{root}/{f.base_name}" for f in found if f.base_name.endswith(".json") and f.base_name[0] != ".")

    def _kept(self) -> dict[str, int] | None:
        """Where the query stands; None if that is not known here."""
        if self.position is None and self.limit:
            store, root = _store(self.progress)
            if known := self._positions(store, root):
                with store.open_input_stream(known[-1]) as text:
                    self.position = json.loads(text.read())
        return self.position


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class LogWriter(DataSourceStreamArrowWriter):
    """Options: ``path`` and ``writer``, the name of this stream in the log. Rows need ``value`` only."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.writer = options["path"], options["writer"]
        if not self.writer or self.writer[0] in "._" or "/" in self.writer:
            raise ValueError("a writer is named like a folder")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        schema = pa.schema([("value", pa.string())])
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    store.create_dir(f"{root}/{self.writer}/data", recursive=True)
                    out = pq.ParquetWriter(f"{root}/{self.writer}/data/{name}", schema, filesystem=store)
                values = batch.column(batch.schema.get_field_index("value")).cast(pa.string())
                out.write_batch(pa.RecordBatch.from_arrays([values], schema=schema), row_group_size=READ_ROWS)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name, rows)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        store, root = _store(self.path)
        entries = _entries(store, root, self.writer)
        if any(entry.batch >= batchId for entry in entries):
            self.abort(messages, batchId)  # entered before a failure; the new files are copies
            return
        first = entries[-1].end if entries else 0
        files = [(m.file, m.rows) for m in messages if m is not None and m.rows]
        rows = sum(n for _, n in files)
        if rows:
            entry = f"{root}/{self.writer}/entries/{batchId:012d}-{first:020d}-{rows:012d}.json"
            _publish(store, entry, json.dumps(files))

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        store, root = _store(self.path)
        for message in messages:
            if message is not None and message.rows:
                store.delete_file(f"{root}/{self.writer}/data/{message.file}")


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> LogWriter:
        if "value" not in schema.fieldNames():
            raise ValueError("messages have a column value")
        return LogWriter(dict(self.options))


def read_log(
    spark: SparkSession, path: str, start: str = "earliest", max_messages: int | None = None, progress: str | None = None
) -> DataFrame:
    """Messages as ``value`` text with ``partition`` (the writer) and ``offset``.

    ``max_messages`` bounds a micro-batch exactly. A query that takes the backlog once (``availableNow``) asks for its end
    only at the start: leave the limit out there.
    """
    spark.dataSource.register(MessageLog)
    reader = spark.readStream.format(FORMAT).option("path", path).option("start", start)
    if max_messages:
        reader = reader.option("limit", max_messages).option("progress", progress or "")
    return reader.load()


def write_log(messages: DataFrame, path: str, writer: str, checkpoint: str) -> DataStreamWriter:
    """Append a stream of ``value`` messages to the log at ``path`` as ``writer``: each batch once, whole or not at all.

    A writer's batches are numbered by its checkpoint: a new checkpoint needs a new name.
    """
    messages.sparkSession.dataSource.register(MessageLog)
    sink = messages.select("value").writeStream.format(FORMAT).option("path", path).option("writer", writer)
    return sink.option("checkpointLocation", checkpoint).outputMode("append")
