"""Trip and station inputs derived from the shared test tables by fixed formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripgrid.functions.dates import spark_pattern
from tripgrid.session import pin_utc

CITIES = ("a", "b", "c")
# The three text layouts of the supported cities.
FORMATS = {"a": "%Y-%m-%dT%H:%M:%SZ", "b": "%m/%d/%YT%H:%M:%S", "c": "%Y-%m-%dT%H:%M"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _city(event_id: Column) -> Column:
    third = event_id % 3
    return F.when(third == 0, "a").when(third == 1, "b").otherwise("c")


def _spread(event_id: Column, factor: int, steps: int, base: float) -> Column:
    return F.lit(base) + ((event_id * factor) % steps) / F.lit(10000.0) + F.lit(3e-5)


def _print_by_city(ts: Column, city: Column) -> Column:
    texts = [F.when(city == c, F.date_format(ts, spark_pattern(f, padded=True))) for c, f in FORMATS.items()]
    return F.coalesce(*texts)


def _with_gaps(ts: Column) -> Column:
    """Trips of two hours in 29 start two hours later, which leaves hours without any."""
    gap = F.floor(F.unix_seconds(ts) / 3600) % 29
    return F.when(gap.isin(7, 8), F.timestamp_seconds(F.unix_seconds(ts) + 7200)).otherwise(ts)


def trips_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid trips in the text layouts of three cities, with planted bad rows and empty hours."""
    e = table(spark, sf_dir, "events")
    i, ts = F.col("event_id"), _with_gaps(F.col("ts").cast("timestamp"))
    stop = F.timestamp_seconds(F.unix_seconds(ts) + (i % 50) * 60)
    far_lat = F.when(i % 500 == 3, 5.0).otherwise(0.0)
    far_lon = F.when(i % 700 == 9, 7.0).otherwise(0.0)
    return e.select(
        i.alias("trip_id"),
        F.col("user_id").alias("scooter_id"),
        _city(i).alias("city"),
        _print_by_city(ts, _city(i)).alias("start_time_utc"),
        _print_by_city(stop, _city(i)).alias("end_time_utc"),
        (_spread(i, 7919, 400, 39.70) + far_lat).alias("start_lat"),
        _spread(i, 104729, 600, -86.30).alias("start_lon"),
        F.when(i % 211 != 5, _spread(i, 15485863, 400, 39.70)).alias("end_lat"),
        (_spread(i, 32452843, 600, -86.30) + far_lon).alias("end_lon"),
        F.when(i % 97 == 0, 0.0).otherwise(F.col("value")).alias("distance_miles"),
    )


def split_trips_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips whose date and time of day are kept in separate columns."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("trip_id"),
        F.date_format(ts, "MM/dd/yyyy 00:00:00").alias("start_date"),
        F.date_format(ts, "HH:mm:ss").alias("start_clock"),
    )


def station_trips_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station trips of two files with mixed time layouts and missing positions."""
    e = table(spark, sf_dir, "events")
    i, u, ts = F.col("event_id"), F.col("user_id"), F.col("ts").cast("timestamp")
    stop = F.timestamp_seconds(F.unix_seconds(ts) + (i % 50) * 60)

    def printed(t: Column) -> Column:
        third = i % 3
        return (
            F.when(third == 0, F.date_format(t, "M/d/yyyy H:mm"))
            .when(third == 1, F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.date_format(t, "M/d/yyyy"))
        )

    return e.select(
        i.alias("trip_id"),
        (i % 2).alias("file_ord"),
        i.alias("row_ord"),
        (i % 50).alias("duration"),
        printed(ts).alias("start_time"),
        printed(stop).alias("end_time"),
        (F.lit(3000) + u % 40).cast("int").alias("start_station"),
        (F.lit(3000) + (i * 7919) % 43).cast("int").alias("end_station"),
        F.when(i % 5 != 0, F.lit(34.0) + (u % 40) / F.lit(100.0)).alias("start_lat"),
        (F.lit(-118.0) - (u % 40) / F.lit(100.0)).alias("start_lon"),
        (F.lit(34.0) + ((i * 7919) % 43) / F.lit(100.0)).alias("end_lat"),
        F.when(i % 7 != 0, F.lit(-118.0) - ((i * 7919) % 43) / F.lit(100.0)).alias("end_lon"),
    )


def stations_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station files: several rows for an id, missing latitudes, no longitudes."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        (F.lit(3000) + (k * 7) % 47).cast("int").alias("id"),
        (k % 2).alias("file_ord"),
        k.alias("row_ord"),
        F.when(k % 4 != 0, F.lit(33.5) + (k % 10) / F.lit(100.0)).alias("lat"),
        F.when(k % 3 != 0, F.concat(F.lit("7/"), (k % 28 + 1).cast("string"), F.lit("/2016"))).alias("time"),
    )
