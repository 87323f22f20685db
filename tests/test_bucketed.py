"""Facts in buckets: nothing stored is moved, NULLs compare as equal, a new catalog finds the table."""

import re

import pytest
from pyspark.sql import functions as F
from tapeworks.etl import load_facts
from tapeworks.schemas import TABLES
from tapeworks.sources.bucketed import BucketedStore
from tapeworks.sources.stores import ParquetStore


@pytest.fixture
def store(spark, tmp_path):
    yield BucketedStore(spark, str(tmp_path), "bucket_tests", buckets=6)
    spark.sql("DROP DATABASE IF EXISTS bucket_tests CASCADE")


def facts(spark, *rows):
    """Trades of (day, time, symbol, price), everything else NULL."""
    made = spark.createDataFrame(
        rows, "tradingdate_key int, time_key int, symbol_key bigint, last_price double"
    )
    known = {name: F.col(name) for name in made.columns}
    fields = spark.createDataFrame([], TABLES["fact_trade"]).schema.fields
    return made.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


OLD = [(20250103, 90000, 1, 10.0), (20250103, 90000, 1, None), (20250203, None, 2, 11.0), (None, 90100, 3, 12.0)]
NEW = [(20250103, 90000, 1, 10.5), (20250203, 90000, 2, 11.0)]


def load(spark, store, rows):
    batch = facts(spark, *rows)
    return load_facts("fact_trade", batch, batch.select("tradingdate_key"), store)


def test_loads_store_each_fact_once(spark, store, tmp_path):
    plain = ParquetStore(spark, str(tmp_path / "plain"))
    for rows, added in ((OLD, 4), (OLD, 0), (OLD + NEW, 2), (NEW[:1], 0)):
        assert load(spark, store, rows) == load(spark, plain, rows) == added
    key = lambda r: str(tuple(r))
    assert sorted(store.read("fact_trade").collect(), key=key) == sorted(plain.read("fact_trade").collect(), key=key)
    assert store.read("fact_trade", [202501]).count() == 3 and store.read("fact_trade", []).count() == 0


def test_stored_rows_are_not_exchanged(spark, store):
    load(spark, store, OLD)
    months, batch = [202501, 202502], facts(spark, *OLD, *NEW)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = store.unstored("fact_trade", batch, months, batch.select("tradingdate_key"))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
    # the one exchange is the batch's, by the hash it computes into the six buckets of the table
    assert re.search(r"Exchange hashpartitioning\(natural_hash#\d+L, 6\)", plan)
    stored = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "Bucketed: true" in stored and "SelectedBucketsCount: 6 out of 6" in stored and "PartitionFilters" in stored



def test_a_new_catalog_finds_the_table(spark, store, tmp_path):
    load(spark, store, OLD)
    spark.sql("DROP TABLE bucket_tests.fact_trade")  # external: the files stay
    other = BucketedStore(spark, str(tmp_path), "bucket_tests", buckets=64)  # the table keeps its own number
    assert load(spark, other, OLD + NEW) == 2 and other.read("fact_trade").count() == 6
    assert [p.name for p in tmp_path.glob("fact_trade_in_*")] == ["fact_trade_in_6"]
    (tmp_path / "fact_trade_in_9").mkdir()
    spark.sql("DROP TABLE bucket_tests.fact_trade")
    with pytest.raises(ValueError):
        other.read("fact_trade")


def test_other_tables_are_plain(spark, store):
    store.append("dim_time", spark.createDataFrame([], TABLES["dim_time"]))
    assert store.read("dim_time").count() == 0
