import datetime as dt

import pytest
from pyspark.sql import functions as F

from firmgauge.functions import columns as C
from firmgauge.schemas import BINS_10, BINS_4, BINS_5, BINS_DEFAULT


def labels(spark, bins, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, revenue double")
    return [r["revenue_bin"] for r in C.with_bins(df, bins).orderBy("i").collect()]


def test_bins_are_left_closed_with_an_open_end(spark):
    values = [-1.0, 0.0, 4.99, 5.0, 10.0, 25.0, 50.0, 100.0, 500.0, 1000.0, 5000.0, 9999.9, 10000.0]
    assert labels(spark, BINS_10, values) == [
        "0-5M", "0-5M", "0-5M", "5-10M", "10-25M", "25-50M", "50-100M", "100-500M", "500M-1B", "1-5B",
        "5-10B", "5-10B", "10B& up",
    ]
    assert labels(spark, BINS_5, [19.9, 20.0, 499.9, 500.0]) == ["<20", "20-50", "100-500", ">500"]
    assert labels(spark, BINS_4, [19.9, 20.0, 100.0, 500.0]) == ["0-20M", "20-100M", "100-500M", "500M+"]


def test_missing_values_get_no_bin_or_the_default(spark):
    assert labels(spark, BINS_10, [None, float("nan")]) == [None, None]
    assert labels(spark, BINS_DEFAULT, [None, float("nan"), -3.0, 10000.0]) == ["<5M", "<5M", "<5M", ">10B"]


def test_bin_order_follows_the_labels(spark):
    df = spark.createDataFrame([(1.0,), (7.0,), (20000.0,), (None,)], "revenue double")
    got = {r["revenue_bin"]: r["bin_order"] for r in C.with_bins(df, BINS_10).collect()}
    assert got == {"0-5M": 0, "5-10M": 1, "10B& up": 9, None: None}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value,expected", [(1234.0, 1400.0), (100.0, 101.0), (7.0, 7.1), (0.0, None), (None, None)])
def test_axis_ceiling(spark, value, expected):
    got = one(spark, C.round_up_nice(F.lit(value).cast("double")))
    assert got == (None if expected is None else pytest.approx(expected))


def test_ratios_never_fail_on_zero(spark):
    assert one(spark, C.pct_change(F.lit(0), F.lit(5))) is None
    assert one(spark, C.share(F.lit(1), F.lit(0))) is None
    assert one(spark, C.growth_ratio(F.lit(0.0), F.lit(0.0))) == 1.0
    assert one(spark, C.growth_ratio(F.lit(-3.0), F.lit(1.0))) == pytest.approx(3.0, abs=1e-5)


def test_dates_and_texts(spark):
    day = F.lit(dt.date(2018, 3, 31))
    assert one(spark, C.months_back(day, 1)) == dt.date(2018, 2, 28)
    assert one(spark, C.month_name(day)) == "March"
    assert one(spark, C.month_suffix(day)) == "2018_03"
    assert one(spark, C.file_safe(F.lit("a b c"))) == "a_b_c"
    assert one(spark, C.percent_text(F.lit(0.12345))) == "12.35%"
    assert one(spark, C.fixed(F.lit(2.5), 0)) == "3"
    assert one(spark, C.ceil_to(F.lit(10001), 10000)) == 20000


def test_blank_nulls_has_no_exponents(spark):
    df = spark.createDataFrame([(1, 1.5e9, None), (2, None, "")], "i int, x double, s string")
    assert [tuple(r) for r in C.blank_nulls(df, 4).orderBy("i").collect()] == [
        ("1", "1500000000.0000", ""), ("2", "", ""),
    ]
    whole = spark.createDataFrame([(1 / 3,)], "x double")
    assert float(C.blank_nulls(whole).first()[0]) == 1 / 3


def test_mean_null_policies(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, 3.0)], "g int, x double")
    strict = {r["g"]: r["m"] for r in df.groupBy("g").agg(C.mean("x").alias("m")).collect()}
    loose = {r["g"]: r["m"] for r in df.groupBy("g").agg(C.mean("x", "skip").alias("m")).collect()}
    assert strict == {1: None, 2: 3.0} and loose == {1: 2.0, 2: 3.0}
    with pytest.raises(ValueError):
        C.mean("x", "other")
