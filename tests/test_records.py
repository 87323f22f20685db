import datetime as dt

from pyspark.sql import functions as F

from tapeworks import schemas
from tapeworks.operators import records
from tapeworks.session import scratch_path, staged
from tapeworks.sources import files, jdbc


def values(df):
    return sorted(r.v for r in df.collect())


def people(spark):
    return spark.createDataFrame([(1, "a", 10), (3, "b", 30), (7, "a", 20)], "v int, name string, create_time bigint")


def test_filter_builder(spark):
    df = people(spark)
    find = lambda **wanted: values(records.filter_records(df, **wanted))
    assert find() == []
    assert find(unknown=1) == []
    assert find(v=None) == []
    assert find(v=[1, 2, 3]) == []
    assert find(v=[None, 3]) == [1, 3]
    assert find(v=[3, None]) == [3, 7]
    assert find(v=[2, 7], name="a") == [7]
    assert find(name=["a", "x"]) == [1, 7]
    assert find(create_time=["1970-01-01 00:00:00", "1970-01-01 00:00:01"]) == [1, 3, 7]


def test_filter_order(spark):
    order = lambda **how: [r.v for r in records.filter_records(people(spark), v=[0, 9], **how).collect()]
    assert order(reverse=True, order_by="v") == [7, 3, 1]
    assert order(reverse=False, order_by="nothing") == [1, 7, 3]


def test_views_and_changes(spark):
    df = spark.createDataFrame([("1", "x", 5)], "f_id string, f_name string, plain int")
    assert records.human_view(df).columns == ["id", "name", "plain"]
    assert records.human_view(df, ["f_id"], ["name"]).columns == ["id", "name"]
    assert records.add_column(df, "plain", "string").schema == df.schema
    assert records.rename_column(df, "plain", "f_id").columns == df.columns
    assert records.change_type(df, "f_name", "int").first().f_name is None
    assert records.values_lost(df, "f_name", "int").first()[0] == 1


def test_audit(spark):
    inserted = records.with_audit(spark.range(1), 1000)
    assert inserted.first().create_date == "1970-01-01 00:00:01"
    updated = records.with_audit(inserted, 2000, inserting=False).first()
    assert (updated.create_time, updated.update_time, updated.update_date) == (1000, 2000, "1970-01-01 00:00:02")


def test_tables_are_created_once(spark):
    wanted = {f"t_{name}": schema for name, schema in schemas.TABLES.items()}
    made = records.create_tables(spark, wanted)
    assert set(made) == set(wanted)
    assert records.create_tables(spark, wanted) == []
    assert spark.table("t_dim_date").count() == 0
    for name in wanted:
        spark.sql(f"DROP TABLE {name}")


def test_csv_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Symbol,Sector\n"V,CB",Bank\n')
    assert files.read_csv(spark, str(tmp_path), "Symbol string, Sector string").first().Symbol == "V,CB"
    path = files.write_csv(people(spark), scratch_path(spark, "people"), dt.datetime(2025, 1, 2, 3, 4, 5))
    assert path.endswith("_20250102_030405")
    assert values(files.read_csv(spark, path, "v int, name string, create_time bigint")) == [1, 3, 7]


def test_a_table_can_be_replaced_by_rows_read_from_it(spark):
    path = scratch_path(spark, "replace_test")
    files.append_table(people(spark), path)
    files.append_table(people(spark), path)
    table = files.read_table(spark, path, "v int, name string, create_time bigint")
    files.replace_table(table.distinct().withColumn("v", F.col("v") + 1), path)
    assert values(files.read_table(spark, path, "v int, name string, create_time bigint")) == [2, 4, 8]


def test_narrow_scans_are_dealt_out(spark):
    one = staged(spark.range(100).coalesce(1), "narrow")
    assert files.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(100).repartition(64)
    assert files.spread(wide) is wide


def test_jdbc_options():
    options = jdbc.read_options("jdbc:x", "fact.stocktrade", {"user": "u"}, "tradingdate_key", (20240101, 20241231), 8)
    assert options["numPartitions"] == "8" and options["partitionColumn"] == "tradingdate_key"
    assert "numPartitions" not in jdbc.read_options("jdbc:x", "dim.date", {})
