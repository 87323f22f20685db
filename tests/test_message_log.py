"""The message log: offsets, limits, restarts, commits and aborts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tapeworks.schemas import CHANNELS
from tapeworks.sources.message_log import LogReader, LogWriter, read_log, write_log
from tapeworks.streaming.jobs import ingest, raw_table, read_text_messages


def land(path, name, lines):
    path.mkdir(exist_ok=True)
    (path / f"{name}.txt").write_text("\n".join(lines) + "\n")


def send(spark, folder, log, checkpoint, writer="a"):
    stream = read_text_messages(spark, str(folder))
    write_log(stream, str(log), writer, str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


def batch(*values):
    return pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])


def all_of(reader, start, end):
    parts = reader.partitions(start, end)
    return [tuple(row.values()) for p in parts for b in reader.read(p) for row in b.to_pylist()]


def test_batches_are_entered_once_and_aborted_ones_never(tmp_path):
    sink = LogWriter({"path": str(tmp_path), "writer": "a"})
    sink.commit([sink.write(iter([batch("x", "y")])), sink.write(iter([])), sink.write(iter([batch("z")]))], 0)
    sink.commit([sink.write(iter([batch("x", "y", "z")]))], 0)  # the same batch after a failure
    sink.abort([sink.write(iter([batch("lost")])), None], 1)

    def broken():
        yield batch("half")
        raise OSError("the task failed")

    with pytest.raises(OSError):
        sink.write(broken())
    sink.commit([sink.write(iter([batch(None, "w")]))], 1)
    reader = LogReader({"path": str(tmp_path)})
    assert reader.initialOffset() == {} and reader.latestOffset() == {"a": 5}
    rows = all_of(reader, {}, {"a": 5})
    assert sorted(rows[:3], key=lambda r: r[2])[2][2] == 2 and {r[0] for r in rows} == {"x", "y", "z", None, "w"}
    assert [r[2] for r in rows] == [0, 1, 2, 3, 4]
    assert all_of(reader, {"a": 1}, {"a": 4}) == rows[1:4]


def test_spans_across_row_groups(tmp_path):
    sink = LogWriter({"path": str(tmp_path), "writer": "a"})
    sink.commit([sink.write(iter([batch(*map(str, range(k, k + 7_000))) for k in range(0, 35_000, 7_000)]))], 0)
    reader = LogReader({"path": str(tmp_path)})
    for start, end in ((0, 35_000), (6_999, 7_001), (13_000, 29_500), (34_999, 35_000)):
        rows = all_of(reader, {"a": start}, {"a": end})
        assert [(int(r[0]), r[2]) for r in rows] == [(i, i) for i in range(start, end)]


def test_limits_are_shared_and_survive_restarts(tmp_path):
    log, options = tmp_path / "log", {"path": str(tmp_path / "log"), "limit": "6", "progress": str(tmp_path / "p")}
    for name, n in (("a", 10), ("b", 2)):
        sink = LogWriter({"path": str(log), "writer": name})
        sink.commit([sink.write(iter([batch(*(f"{name}{i}" for i in range(n)))]))], 0)
    position, ends = LogReader(options).initialOffset(), []
    for _ in range(3):
        reader = LogReader(options)  # a restarted query has a new reader
        end = reader.latestOffset()
        reader.partitions(position, end)
        position = end
        ends.append(end)
    assert ends == [{"a": 4, "b": 2}, {"a": 10, "b": 2}, {"a": 10, "b": 2}]
    with pytest.raises(ValueError):
        LogReader({"path": str(log), "limit": "6"})


def test_restarts_go_on_exactly(spark, tmp_path):
    """A log written and read over several runs, with a limit: every message once, no batch above the limit."""
    sent, log = tmp_path / "sent", tmp_path / "log"
    sizes = []

    def keep(rows, _):
        sizes.append(rows.count())
        rows.select("value", "partition", "offset").write.mode("append").parquet(str(tmp_path / "out"))

    def receive():
        rows = read_log(spark, str(log), max_messages=40, progress=str(tmp_path / "progress"))
        query = rows.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "received")).start()
        query.processAllAvailable()
        query.stop()

    for run in range(3):
        land(sent, f"f{run}", [f"m{run}-{i}" for i in range(70)])
        send(spark, sent, log, tmp_path / "sink")
        receive()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["value"] for r in rows) == sorted(f"m{run}-{i}" for run in range(3) for i in range(70))
    assert sorted(r["offset"] for r in rows) == list(range(210))
    assert max(sizes) <= 40 and sum(sizes) == 210


def test_latest_start_leaves_out_what_was_there(spark, tmp_path):
    sent, log, got = tmp_path / "sent", tmp_path / "log", []
    land(sent, "old", ["old"])
    send(spark, sent, log, tmp_path / "sink")
    rows = read_log(spark, str(log), start="latest")
    query = rows.writeStream.foreachBatch(lambda b, _: got.extend(r[0] for r in b.select("value").collect())).option(
        "checkpointLocation", str(tmp_path / "received")
    ).start()
    query.processAllAvailable()
    land(sent, "new", ["new"])
    send(spark, sent, log, tmp_path / "sink")
    query.processAllAvailable()
    query.stop()
    assert got == ["new"]


def test_ingestion_from_the_log(spark, tmp_path):
    wire = CHANNELS["index"][0][0]
    land(tmp_path / "sent", "f", [f'{{"Content": "{{\\"{wire}\\": \\"v{i}\\"}}"}}' for i in range(5)])
    send(spark, tmp_path / "sent", tmp_path / "log", tmp_path / "sink")
    stream = read_log(spark, str(tmp_path / "log")).select("value")
    ingest(stream, "index", str(tmp_path / "raw"), str(tmp_path / "check"), once=True).start().awaitTermination()
    column = CHANNELS["index"][0][1]
    assert raw_table(spark, "index", str(tmp_path / "raw")).select(F.count_distinct(column)).first()[0] == 5
