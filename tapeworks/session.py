"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}
_made: ContextVar[list[str] | None] = ContextVar("scratch paths of the job that runs", default=None)


def build_session(app_name: str = "tapeworks", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library relies on: UTC, AQE, RocksDB streaming state."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", None)
    if master is None or not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="tapeworks-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A fresh path under the shared scratch folder; ``keep`` saves it from ``temporary_scratch``."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not keep and (paths := _made.get()) is not None:
        paths.append(path)
    return path


@contextmanager
def temporary_scratch() -> Iterator[None]:
    """Delete, at the end, the scratch paths that this thread made inside: for work that has stored its result."""
    paths: list[str] = []
    before = _made.set(paths)
    try:
        yield
    finally:
        _made.reset(before)
        for path in paths:
            files, at = file_system(SparkSession.active(), path)
            files.delete(at, True)


def file_system(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path as it knows it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    files, at = file_system(spark, path)
    return files.exists(at)


def staged(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors and gives Spark true sizes, so that
    it can choose join strategies for small tables.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
