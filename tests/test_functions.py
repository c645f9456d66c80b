from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripgrid.functions import dates, encoding, numbers


def values(spark, column, rows, schema="v string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("out")).collect()]


def test_spark_pattern():
    assert dates.spark_pattern("%Y-%m-%dT%H:%M:%SZ") == "yyyy-M-d'T'H:m:s'Z'"
    assert dates.spark_pattern("%m/%d/%Y %H:%M", padded=True) == "MM/dd/yyyy HH:mm"
    with pytest.raises(ValueError):
        dates.spark_pattern("%j")


def test_parse_ts_multi_picks_the_layout_by_its_marks(spark):
    rows = [("3/21/2019",), ("12/1/2020 17:45",), ("2021-11-30 06:08:09",), ("x",), (None,), ("3/21/19",)]
    got = values(spark, dates.parse_ts_multi(F.col("v")).cast("string"), rows)
    assert got == ["2019-03-21 00:00:00", "2020-12-01 17:45:00", "2021-11-30 06:08:09", None, None, None]


def test_parse_ts_by_uses_the_format_of_the_set(spark):
    formats = {"a": "%Y-%m-%dT%H:%M:%SZ", "b": "%m/%d/%YT%H:%M:%S", "c": "%Y-%m-%dT%H:%M"}
    rows = [("a", "2024-01-02T03:04:05Z"), ("b", "1/2/2024T03:04:05"), ("c", "2024-01-02T03:04"), ("a", "2024-01-02T03:04")]
    out = dates.parse_ts_by(F.col("k"), F.col("k"), formats)
    got = values(spark, dates.parse_ts_by(F.col("v"), F.col("k"), formats).cast("string"), rows, "k string, v string")
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 03:04:00", None]
    assert values(spark, out, rows, "k string, v string") == [None] * 4


def test_split_and_join_date(spark):
    day = dates.split_date(F.col("d"))
    got = values(
        spark, dates.join_date_time(day, F.col("t")), [(" 2018/08/09 00:00:00+00", "12:30:00"), ("", "1:00")], "d string, t string"
    )
    assert got == ["2018/08/09T12:30:00", "T1:00"]
    assert values(spark, dates.join_date_time(None, F.col("v")), [("whole",)]) == ["whole"]


def test_hour_tags_cut_and_floor(spark):
    rows = [("1970-01-01 01:59:59",), ("1969-12-31 23:30:00",), ("1969-12-31 22:30:00",)]
    ts = F.col("v").cast("timestamp")
    assert values(spark, dates.hour_tag(ts), rows) == [1, 0, -1]
    rows = [("2016-07-07 04:00:00",), ("2016-07-07 03:59:59",), ("2016-07-07 05:00:00",)]
    assert values(spark, dates.hour_tag_origin(ts), rows) == [0, -1, 1]


def test_tags_return_to_their_hour(spark):
    df = spark.range(-5000, 5000, 37).select(F.col("id").alias("tag"))
    back = df.select(
        "tag",
        dates.hour_tag(dates.tag_to_ts(F.col("tag"))).alias("plain"),
        dates.hour_tag_origin(dates.tag_to_ts(F.col("tag"), offset_s=dates.origin_seconds())).alias("origin"),
    )
    assert back.where("tag <> plain or tag <> origin").count() == 0


def test_grid_cell_matches_plain_arithmetic(spark):
    import math

    rows = [(39.7 + i * 0.0031, -86.3 + i * 0.0047) for i in range(50)]
    x, y = numbers.grid_cell(F.col("lat"), F.col("lon"), F.lit(39.7), F.lit(-86.3))
    got = spark.createDataFrame(rows, "lat double, lon double").select("lat", "lon", x, y).collect()
    for lat, lon, gx, gy in got:
        east = (lon + 86.3) * 4e7 * math.cos((39.7 + lat) * math.pi / 360) / 360
        assert (gx, gy) == (int(east / 250), int((lat - 39.7) * 4e7 / 360 / 250))


def test_scaling(spark):
    one = [(0.5,)]
    v = F.col("v")
    assert values(spark, numbers.inv_minmax(v, F.lit(0), F.lit(5)), one, "v double") == [2.0]
    assert values(spark, numbers.minmax(F.lit(3), F.lit(0), F.lit(4)), one, "v double") == [0.75]
    assert values(spark, numbers.minmax(F.lit(3), F.lit(4), F.lit(4)), one, "v double") == [None]
    assert values(spark, numbers.zscore(v, F.lit(0.5), F.lit(0.0)), one, "v double") == [None]
    assert values(spark, numbers.round_pred(v), [(0.5,), (1.5,), (-0.5,), (2.51,)], "v double") == [0.0, 2.0, 0.0, 3.0]
    df = spark.range(0, 100).select(F.col("id").alias("v"))
    back = numbers.inv_minmax(numbers.minmax(F.col("v"), F.lit(0), F.lit(99)), F.lit(0), F.lit(99))
    assert df.where(back != F.col("v")).count() == 0


def test_null_tokens_and_numbers(spark):
    rows = [("1.5",), ("NA",), ("",), ("x",), (None,)]
    assert values(spark, numbers.to_double(numbers.blank_to_null(F.col("v"))), rows) == [1.5, None, None, None, None]


def test_one_hot(spark):
    hot = encoding.one_hot(F.col("v"), range(1, 13))
    assert values(spark, hot, [(3,)], "v int") == [[0, 0, 1] + [0] * 9]
    with pytest.raises(Exception, match="one-hot"):
        values(spark, hot, [(13,)], "v int")
    with pytest.raises(Exception, match="one-hot"):
        values(spark, hot, [(None,)], "v int")


def test_time_features(spark):
    rows = [(datetime(2024, 1, 1, 23),), (datetime(2023, 12, 31, 0),)]
    monday, sunday = values(spark, encoding.time_features(F.col("v")), rows, "v timestamp")
    assert monday == [1.0] + [0.0] * 6 + [1.0] + [0.0] * 11 + [1.0]
    assert sunday == [0.0] * 6 + [1.0] + [0.0] * 11 + [1.0] + [0.0]


moments = st.datetimes(datetime(1971, 1, 1), datetime(2099, 12, 31)).map(lambda d: d.replace(microsecond=0))
few = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@few
@given(st.lists(moments, min_size=1, max_size=40))
def test_printed_times_parse_back(spark, given_moments):
    for fmt, keep in (("%Y-%m-%dT%H:%M:%SZ", "second"), ("%m/%d/%YT%H:%M:%S", "second"), ("%Y-%m-%dT%H:%M", "minute")):
        rows = [(d, d.strftime(fmt)) for d in given_moments]
        df = spark.createDataFrame(rows, "d timestamp, v string")
        wrong = df.where(~dates.parse_ts(F.col("v"), fmt).eqNullSafe(F.date_trunc(keep, "d")))
        assert wrong.count() == 0


@few
@given(st.lists(moments, min_size=1, max_size=40))
def test_one_weekday_and_one_month_are_set(spark, given_moments):
    df = spark.createDataFrame([(d,) for d in given_moments], "d timestamp").select("d", encoding.time_features(F.col("d")).alias("tf"))
    for d, tf in df.collect():
        assert tf[:7].index(1.0) == d.weekday() and sum(tf[:7]) == 1
        assert tf[7:19].index(1.0) == d.month - 1 and sum(tf[7:19]) == 1
        assert tf[19] == d.hour / 23
