import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeworks.functions import scaling, text, times
from tapeworks.functions.numbers import rounded


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_trading_date(spark):
    got = column(spark, ["05/01/2025", "5/1/2025", "31/02/2025", "xx", "", None, "5/1/25"], "string", times.trading_date)
    day = dt.date(2025, 1, 5)
    assert got == [day, day, None, None, None, None, None]


def test_clock_key(spark):
    got = column(spark, ["09:30:00", "00:00:00", " 23:59:59 ", "24:00:00", "9:30:00", None], "string", times.clock_key)
    assert got == [93000, 0, 235959, None, None, None]


def test_clock_text_is_the_inverse_of_the_key(spark):
    seconds = [0, 59, 3600, 34200, 86399]
    assert column(spark, seconds, "int", times.clock_text) == ["00:00:00", "00:00:59", "01:00:00", "09:30:00", "23:59:59"]


def test_date_key_and_weekday(spark):
    assert column(spark, [dt.date(2025, 1, 5), None], "date", times.date_key) == [20250105, None]
    assert column(spark, [dt.date(2025, 1, 5)], "date", F.dayofweek) == [1]


def test_epoch_milliseconds(spark):
    assert column(spark, [0, None], "bigint", times.ms_to_text) == ["1970-01-01 00:00:00", None]
    assert column(spark, ["1970-01-01 00:00:01", "x"], "string", times.text_to_ms) == [1000, None]


def test_hash_keeps_the_place_of_null(spark):
    rows = spark.createDataFrame([(1, None, 2), (1, 2, None)], "a int, b int, c int")
    hashes = [r[0] for r in rows.select(text.row_hash([F.col(c) for c in "abc"])).collect()]
    assert hashes[0] != hashes[1]


def test_constant_feature_scales_to_zero(spark):
    scale = lambda v: scaling.minmax(v, F.lit(5.0), F.lit(5.0))
    assert column(spark, [5.0, 5.0, None], "double", scale) == [0.0, 0.0, None]


def test_scale_and_inverse(spark):
    back = lambda v: scaling.minmax_back(scaling.minmax(v, F.lit(2.0), F.lit(6.0)), F.lit(2.0), F.lit(6.0))
    assert column(spark, [2.0, 3.5, 6.0], "double", back) == [2.0, 3.5, 6.0]


def test_finite(spark):
    assert column(spark, [1.0, float("inf"), float("-inf"), float("nan"), None], "double", scaling.finite) == [1.0] + [None] * 4


def test_or_blank(spark):
    assert column(spark, [" a ", " ", None], "string", lambda v: text.or_blank(v, F.lit("b"))) == ["a", "b", "b"]


def test_numbers(spark):
    assert column(spark, ["12", "12.7", "x", None], "string", lambda v: text.number(v, "bigint")) == [12, 12, None, None]


@pytest.mark.parametrize("digits", [0, 4, 6])
def test_rounded_equals_round(spark, digits):
    draw = random.Random(3)
    values = [None, 0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1e300, -1e-300, 0.5, -0.5, 2.5, 0.00005, 1.00005, 1.005]
    values += [draw.choice([-1, 1]) * (k + 0.5) / 10**digits for k in range(200)]
    values += [draw.uniform(-1, 1) * 10 ** draw.randrange(-8, 18) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(rounded(F.col("v"), digits).alias("got"), F.round("v", digits).alias("want")).collect()
    assert [repr(r.got) for r in got] == [repr(r.want) for r in got]
