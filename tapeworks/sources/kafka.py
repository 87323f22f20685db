"""Kafka topics. The connector package must be on the cluster's class path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.schemas import TOPICS


def reader_options(servers: str, topic: str, start: str = "earliest", max_messages: int | None = None,
                   group: str | None = None) -> dict[str, str]:
    """``start`` is ``earliest`` or ``latest``; it counts only for the first run of a checkpoint.

    ``max_messages`` limits a micro-batch; without it a backlog is taken in one.
    """
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start}
    if max_messages:
        options["maxOffsetsPerTrigger"] = str(max_messages)
    if group:
        options["kafka.group.id"] = group
    return options


def read_topic(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Messages as ``value`` text with ``partition`` and ``offset``."""
    stream = spark.readStream.format("kafka").options(**reader_options(servers, topic, **options)).load()
    return stream.select(F.col("value").cast("string"), "partition", "offset")


def topic_of(channel: Column) -> Column:
    """Topic of a channel code; NULL for unknown codes."""
    topic = F.lit(None).cast("string")
    for code, name in TOPICS.items():
        topic = F.when(channel == code, F.lit(name)).otherwise(topic)
    return topic


def route(messages: DataFrame, channel: str = "channel") -> tuple[DataFrame, DataFrame]:
    """Messages with their ``topic``, and those of unknown channels."""
    routed = messages.withColumn("topic", topic_of(F.col(channel)))
    return routed.where("topic is not null"), routed.where("topic is null").drop("topic")


def as_messages(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows as JSON ``value`` text."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("value"))


def write_topic(messages: DataFrame, servers: str, checkpoint: str, topic: str | None = None):
    """Stream writer of ``value`` messages; without ``topic`` each row names its own."""
    writer = messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    return writer.option("topic", topic) if topic else writer
