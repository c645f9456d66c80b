"""One query per operator over the shared test tables.

Timestamps are printed and doubles rounded, so that another engine can repeat the
values exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripgrid.checks import fixtures as fx
from tripgrid.config import CityConfig
from tripgrid.functions import dates, encoding, numbers
from tripgrid.operators import (
    cleaning,
    conv,
    demand,
    evaluate,
    forecast,
    grid,
    latent,
    series,
    splits,
    stations,
    values,
)
from tripgrid.operators.lookup import attach, lookup_join
from tripgrid.plans import demand as demand_plan
from tripgrid.plans import forecast as forecast_plan
from tripgrid.session import Staged, own_path, pin_utc, spread, stage
from tripgrid.sources import publish, readers, registry, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEYS = ("city",)
W, H = 24, 5
LAGS = (1, 2, 3, 24)
STEPS = 5
TILE = 4
HIGH_VISITS = 12
VISIT_SHARE = 0.99
COORDS = ("start_lat", "start_lon", "end_lat", "end_lon")


def query(fn: Query) -> Query:
    """Register ``fn`` under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(pin_utc(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def six(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


# Inputs shared by several queries, stored once per session and table folder.


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.parse_times(cleaning.cast_coords(fx.trips_fx(spark, sf)), fx.FORMATS)


def whole_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Trips without zero lengths and nulls; parsed once and stored as columns."""
    typed = cleaning.computed_once(_typed(spark, sf))
    return stage(spread(cleaning.drop_nulls(cleaning.drop_zero_distance(typed))), "whole").df


_whole = lru_cache(maxsize=8)(whole_trips)


@lru_cache(maxsize=8)
def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return stage(cleaning.zscore_filter(_whole(spark, sf)), "clean").df


@lru_cache(maxsize=8)
def _tables(spark: SparkSession, sf: str) -> demand_plan.DemandTables:
    tables = demand_plan.demand_tables(_whole(spark, sf), carry=("trip_id",))
    return demand_plan.DemandTables(stage(tables.gridded, "gridded").df, tables.frame, tables.demand)


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf).demand.df


@lru_cache(maxsize=8)
def _dims(spark: SparkSession, sf: str) -> Staged:
    counts = _counts(spark, sf)
    return stage(grid.grid_dims(grid.axis_rank(counts, "x"), grid.axis_rank(counts, "y")), "dims")


@lru_cache(maxsize=8)
def _series(spark: SparkSession, sf: str) -> DataFrame:
    return series.stage_series(_counts(spark, sf), _tables(spark, sf).frame)


@lru_cache(maxsize=8)
def _visits(spark: SparkSession, sf: str) -> DataFrame:
    return stage(grid.cell_visits(_tables(spark, sf).gridded), "visits").df


@lru_cache(maxsize=8)
def _stations(spark: SparkSession, sf: str) -> Staged:
    table = stations.station_table(fx.stations_fx(spark, sf), fx.station_trips_fx(spark, sf))
    return stage(table, "stations")


@lru_cache(maxsize=8)
def _od(spark: SparkSession, sf: str) -> DataFrame:
    return stage(stations.od_matrix(fx.station_trips_fx(spark, sf), _stations(spark, sf))[0], "od").df


@lru_cache(maxsize=8)
def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    return stage(evaluate.pred_actual_join(*_stand_in(spark, sf)), "aligned").df


def _hours_n(spark: SparkSession, sf: str) -> DataFrame:
    span = _tables(spark, sf).frame.df
    return span.select("city", (F.col("last_hour") - F.col("first_hour")).alias("n"))


def _stand_in(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Persistence: sample ``i`` forecasts the counts of hour ``i - 1`` for every step."""
    counts = attach(_counts(spark, sf), _hours_n(spark, sf), KEYS)
    tall = counts.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))

    def sampled(idx: Column, value: Column) -> DataFrame:
        placed = tall.withColumn("idx", idx).where((F.col("idx") >= 1) & (F.col("idx") <= F.col("n") - STEPS))
        return placed.select(*KEYS, "idx", "step", "channel", "x", "y", value)

    pred = sampled(F.col("hour") + 1, F.col("cnt").cast("double").alias("yhat"))
    return pred, sampled(F.col("hour") - F.col("step"), F.col("cnt").alias("actual"))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return _hours_n(spark, sf).select("city", (F.col("n") - STEPS).alias("n_samples"))


def _scratch(spark: SparkSession) -> str:
    return own_path(spark, "files")


def _trip_files(spark: SparkSession, sf: str) -> dict[str, str]:
    root = _scratch(spark)
    for city in fx.CITIES:
        own = fx.trips_fx(spark, sf).where(F.col("city") == city).drop("city")
        own.write.option("header", True).csv(f"{root}/{city}")
    return {city: f"{root}/{city}/*.csv" for city in fx.CITIES}


def _jobs() -> list[CityConfig]:
    return [CityConfig(c, fx.FORMATS[c], window=W, horizon=H) for c in fx.CITIES]


# Sources


@query
def scan_trips(spark, sf):
    parts = [readers.scan_trips(spark, p, city=c) for c, p in _trip_files(spark, sf).items()]
    trips = cleaning.cast_coords(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return trips.select(
        F.col("trip_id").cast("long").alias("trip_id"),
        "city",
        "start_time_utc",
        "end_time_utc",
        *six(*COORDS, "distance_miles"),
    )


@query
def scan_trips_quoted(spark, sf):
    """Trip files with a free text that holds quotes, commas and line breaks."""
    root = _scratch(spark)
    trips = fx.trips_fx(spark, sf).where("city = 'a'").drop("city")
    note = F.concat(F.lit("by "), F.col("scooter_id").cast("string"), F.lit(', "no"'), F.repeat(F.lit("\n, x"), (F.col("trip_id") % 4).cast("int")))
    # The writer counts line ends as a reason to quote; doubled quotes are its escape here.
    trips.withColumn("note", note).write.options(header=True, escape='"').csv(root)
    read = readers.scan_trips(spark, f"{root}/*.csv", city="a")
    return read.select(F.col("trip_id").cast("long").alias("trip_id"), "start_time_utc", "note")


def _in_files(df: DataFrame, order: str, path: str, files: int = 4) -> None:
    """CSV files whose names keep ``order``."""
    ranged = df.repartitionByRange(files, order).sortWithinPartitions(order)
    ranged.drop(order).write.option("header", True).csv(path)


@query
def scan_trips_drift(spark, sf):
    """Two generations of files: other station names, another column order."""
    root = _scratch(spark)
    trips = fx.station_trips_fx(spark, sf)
    old = trips.where("file_ord = 0").select("row_ord", "trip_id", "start_time", "start_station", "end_station", "start_lat")
    new = trips.where("file_ord = 1").select(
        "row_ord", F.col("end_station").alias("end_station_id"), "trip_id", F.col("start_station").alias("start_station_id"), "start_time"
    )
    _in_files(old, "row_ord", f"{root}/2023-trips-1")
    _in_files(new, "row_ord", f"{root}/2023-trips-2")
    first_new = readers.list_files(spark, f"{root}/2023-trips-1/*.csv").count()
    read = readers.scan_trips_drift(spark, f"{root}/*-trips-*/*.csv")
    return read.select(
        F.col("trip_id").cast("long").alias("trip_id"),
        (F.col("file_ord") >= first_new).cast("long").alias("file_ord"),
        "start_time",
        F.col("start_station").cast("int").alias("start_station"),
        F.col("end_station").cast("int").alias("end_station"),
        F.round(F.col("start_lat").cast("double"), 6).alias("start_lat"),
    )


@query
def scan_stations(spark, sf):
    root = _scratch(spark)
    rows = fx.stations_fx(spark, sf).withColumnRenamed("time", "date")
    for part in (0, 1):
        _in_files(rows.where(F.col("file_ord") == part).select("row_ord", "id", "lat", "date"), "row_ord", f"{root}/stations-{part}")
    read = readers.scan_stations(spark, f"{root}/stations-*/*.csv")
    first = stations.station_first(stations.station_file_sightings(read))
    return first.select("id", *six("lat"), text(F.col("datetime")).alias("datetime"))


@query
def scan_demand(spark, sf):
    path = _scratch(spark)
    writers.write_demand(demand_plan.stored_demand(_tables(spark, sf)), path)
    stored = readers.scan_demand(spark, path, "a")
    return stored.withColumns({"t0": text(F.col("t0")), "t1": text(F.col("t1"))})


@query
def city_jobs(spark, sf):
    out = _scratch(spark)
    demand_plan.run_demand_job(spark, _jobs(), _trip_files(spark, sf), out)
    stored = readers.scan_demand(spark, f"{out}/demand")
    return stored.groupBy("city").agg(
        F.countDistinct("hour").alias("hours"), F.count("channel").alias("cells"), F.sum("cnt").alias("ends")
    )


# Sinks: what is read back from them


@query
def write_cells(spark, sf):
    """The cell table as a CSV file."""
    path = _scratch(spark)
    cells = grid.cell_table(_tables(spark, sf).gridded, "trip_id")
    writers.write_cells(cells, path, "csv")
    return spark.read.schema(cells.schema).option("header", True).csv(path)


@query
def write_trips(spark, sf):
    path = _scratch(spark)
    trips = _tables(spark, sf).gridded.select("trip_id", "city", "start_hour", "end_hour", "start_x", "start_y", "end_x", "end_y")
    writers.write_trips(trips, path)
    return spark.read.parquet(path).select(trips.columns)


@query
def write_demand(spark, sf):
    """All cities, then one again with other counts: the others stay."""
    path = _scratch(spark)
    filled = demand.fill_hours(_counts(spark, sf), _tables(spark, sf).frame)
    writers.write_demand(filled, path)
    writers.write_demand(filled.where("city = 'a'").withColumn("cnt", F.col("cnt") + 100), path)
    return spark.read.parquet(path).select(filled.columns)


@query
def write_od(spark, sf):
    path = _scratch(spark)
    writers.write_od(_od(spark, sf).drop("dat"), path)
    return spark.read.parquet(path)


@query
def write_stations(spark, sf):
    path = _scratch(spark)
    writers.write_stations(_stations(spark, sf).df, path)
    return _station_rows(spark.read.parquet(path))


@query
def append_eval(spark, sf):
    """Two runs; the first is written twice and kept once."""
    path = _scratch(spark)
    report = stage(_report(spark, sf), "report").df
    for run in ("one", "two", "one"):
        writers.append_eval(report, path, run)
    stored = spark.read.parquet(path)
    return stored.select("city", "run_id", "metric", "channel", "step", "idx", *six("value"))


# Projections and scalar functions


@query
def split_date(spark, sf):
    trips = fx.split_trips_fx(spark, sf)
    return trips.select("trip_id", dates.split_date(F.col("start_date")).alias("start_day"))


@query
def join_date_time(spark, sf):
    trips = fx.split_trips_fx(spark, sf)
    day = dates.split_date(F.col("start_date"))
    return trips.select("trip_id", dates.join_date_time(day, F.col("start_clock")).alias("start_text"))


@query
def parse_ts(spark, sf):
    trips = fx.trips_fx(spark, sf)
    parsed = dates.parse_ts_by(F.col("start_time_utc"), F.col("city"), fx.FORMATS)
    return trips.select("trip_id", text(parsed).alias("start_ts"))


@query
def parse_ts_multi(spark, sf):
    trips = fx.station_trips_fx(spark, sf)
    return trips.select("trip_id", text(dates.parse_ts_multi(F.col("start_time"))).alias("start_ts"))


@query
def is_valid_ts(spark, sf):
    trips = fx.trips_fx(spark, sf)
    return trips.select(
        "trip_id",
        *[dates.is_valid_ts(F.col("start_time_utc"), f).cast("int").alias(f"valid_{c}") for c, f in fx.FORMATS.items()],
    )


@query
def hour_tag(spark, sf):
    return _typed(spark, sf).select("trip_id", dates.hour_tag(F.col("start_time_utc")).alias("hour"))


@query
def hour_tag_origin(spark, sf):
    trips = fx.station_trips_fx(spark, sf)
    return trips.select("trip_id", dates.hour_tag_origin(dates.parse_ts_multi(F.col("start_time"))).alias("hour"))


@query
def tag_to_ts(spark, sf):
    tag = dates.hour_tag(F.col("start_time_utc"))
    origin_tag = dates.hour_tag_origin(F.col("start_time_utc"))
    return _typed(spark, sf).select(
        "trip_id",
        text(dates.tag_to_ts(tag)).alias("hour_start"),
        text(dates.tag_to_ts(origin_tag, offset_s=dates.origin_seconds())).alias("origin_hour_start"),
    )


@query
def hour_interval(spark, sf):
    calendar = demand.hour_calendar(_tables(spark, sf).frame)
    return calendar.select("city", "hour", text(F.col("t0")).alias("t0"), text(F.col("t1")).alias("t1"))


@query
def cast_coords(spark, sf):
    i = F.col("event_id")
    shown = F.concat((i % 400).cast("string"), F.lit(".25"))
    planted = F.when(i % 211 == 5, "somewhere").when(i % 223 == 7, "NaN").otherwise(shown)
    rows = fx.table(spark, sf, "events").select(i.alias("trip_id"), *[planted.alias(c) for c in COORDS])
    return cleaning.cast_coords(rows)


@query
def grid_cell(spark, sf):
    box = grid.bounding_box(_clean(spark, sf)).select("city", "min_lat", "min_lon")
    x, y = numbers.grid_cell(F.col("start_lat"), F.col("start_lon"), F.col("min_lat"), F.col("min_lon"))
    return attach(_clean(spark, sf), box, KEYS).select("trip_id", x.alias("x"), y.alias("y"))


@query
def grid_trips(spark, sf):
    clean = _clean(spark, sf)
    return grid.grid_trips(clean, grid.bounding_box(clean)).select("trip_id", "start_x", "start_y", "end_x", "end_y")


@query
def zscore(spark, sf):
    whole = _whole(spark, sf)
    scored = attach(whole, cleaning.pooled_stats(whole, ("start_lon", "end_lon")), KEYS)
    z = numbers.zscore(F.col("end_lon"), F.col("mean"), F.col("std"))
    return scored.select("trip_id", F.round(z, 6).alias("z"))


@query
def minmax(spark, sf):
    scaled = numbers.minmax(F.col("value"), F.lit(0), F.lit(250))
    return fx.table(spark, sf, "events").select("event_id", F.round(scaled, 6).alias("scaled"))


@query
def inv_minmax(spark, sf):
    back = numbers.inv_minmax((F.col("event_id") % 101) / F.lit(100.0), F.lit(0), F.lit(50))
    return fx.table(spark, sf, "events").select("event_id", back.alias("cnt"))


@query
def round_pred(spark, sf):
    halves = (F.col("event_id") % 41 - 20) / F.lit(2.0)
    return fx.table(spark, sf, "events").select("event_id", numbers.round_pred(halves).cast("long").alias("pred"))


@query
def one_hot(spark, sf):
    kinds = F.col("event_id") % 5
    slots = encoding.one_hot(kinds, list(range(5)))
    joined = F.array_join(F.transform(slots, lambda v: v.cast("string")), "")
    return fx.table(spark, sf, "events").select("event_id", joined.alias("slots"))


@query
def time_features(spark, sf):
    tf = encoding.time_features(F.col("start_time_utc"))
    rows = _typed(spark, sf).select("trip_id", tf.alias("tf"))
    return rows.select(
        "trip_id",
        F.size("tf").alias("width"),
        (F.array_position(F.slice("tf", 1, 7), F.lit(1.0)) - 1).alias("weekday"),
        F.array_position(F.slice("tf", 8, 12), F.lit(1.0)).alias("month"),
        F.round(F.get("tf", F.lit(19)), 6).alias("hour_share"),
        F.round(F.aggregate("tf", F.lit(0.0), lambda a, v: a + v), 6).alias("total"),
    )


@query
def project_needed(spark, sf):
    rows = cleaning.project_needed(_typed(spark, sf))
    return rows.select(
        "city", text(F.col("start_time_utc")).alias("start_time_utc"), text(F.col("end_time_utc")).alias("end_time_utc"), *six(*COORDS)
    )


@query
def rename_cols(spark, sf):
    names = {"start_station": "id", "start_lat": "lat", "start_lon": "lon", "start_time": "time"}
    renamed = readers.rename_cols(fx.station_trips_fx(spark, sf), names)
    return renamed.select("trip_id", "id", *six("lat", "lon"), "time")


@query
def dense_grid(spark, sf):
    counts = _counts(spark, sf)
    placed = grid.axis_lookup(counts, grid.axis_rank(counts, "x"), grid.axis_rank(counts, "y"))
    calendar = demand.hour_calendar(_tables(spark, sf).frame)
    dense = series.dense_grid(placed, _dims(spark, sf), calendar=calendar)
    at = F.transform("grid", lambda v, i: v * i)
    return dense.select(
        "city",
        "hour",
        F.size("grid").alias("cells"),
        F.aggregate("grid", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"),
        F.aggregate(at, F.lit(0).cast("long"), lambda a, v: a + v).alias("placed_total"),
    )


# Filters


@query
def drop_zero_distance(spark, sf):
    return cleaning.drop_zero_distance(fx.trips_fx(spark, sf)).select("trip_id", *six("distance_miles"))


@query
def drop_nulls(spark, sf):
    return cleaning.drop_nulls(fx.trips_fx(spark, sf)).select("trip_id", *six("end_lat"))


@query
def zscore_filter(spark, sf):
    return cleaning.zscore_filter(_whole(spark, sf)).select("trip_id", "city")


@query
def valid_ts_filter(spark, sf):
    return cleaning.valid_ts_filter(fx.trips_fx(spark, sf), "end_time_utc", fx.FORMATS["b"]).select("trip_id")


@query
def high_demand_cells(spark, sf):
    visits = _visits(spark, sf)
    by_z = grid.high_demand_cells(visits).withColumn("rule", F.lit("z"))
    by_count = grid.high_demand_cells(visits, min_visits=HIGH_VISITS).withColumn("rule", F.lit("count"))
    return by_z.unionByName(by_count)


@query
def trips_in_cells(spark, sf):
    cells = grid.high_demand_cells(_visits(spark, sf), min_visits=HIGH_VISITS)
    return grid.trips_in_cells(_tables(spark, sf).gridded, cells).select("trip_id", "city")


@query
def clip_outlier_cells(spark, sf):
    visits = _visits(spark, sf).withColumnRenamed("visits", "cnt")
    return values.clip_outlier_cells(visits, share=VISIT_SHARE)


# Aggregations


@query
def bounding_box(spark, sf):
    return grid.bounding_box(_clean(spark, sf)).select("city", *six("min_lat", "min_lon", "max_lat", "max_lon"))


@query
def pooled_stats(spark, sf):
    return cleaning.pooled_stats(_whole(spark, sf), ("start_lat", "end_lat")).select("city", *six("mean", "std"))


@query
def cell_visits(spark, sf):
    return grid.cell_visits(_tables(spark, sf).gridded)


@query
def hourly_demand(spark, sf):
    """The whole chain from raw trips: starts and ends per cell and hour."""
    return demand_plan.demand_tables(whole_trips(spark, sf)).demand.df


@query
def hourly_demand_by_end(spark, sf):
    """Trip ends counted in the hour they happened."""
    return demand.hourly_demand(_tables(spark, sf).gridded, bucket_end_by="end")


@query
def total_demand(spark, sf):
    tables = _tables(spark, sf)
    return demand.total_demand(demand.fill_hours(tables.demand.df, tables.frame))


def _station_rows(df: DataFrame) -> DataFrame:
    extra = ["tidx"] if "tidx" in df.columns else []
    return df.select("id", *six("lat", "lon"), text(F.col("datetime")).alias("datetime"), *extra)


@query
def station_first(spark, sf):
    return _station_rows(stations.station_first(stations.station_file_sightings(fx.stations_fx(spark, sf))))


@query
def stations_from_trips(spark, sf):
    return _station_rows(stations.stations_from_trips(fx.station_trips_fx(spark, sf)))


@query
def station_table(spark, sf):
    return _station_rows(stations.station_table(fx.stations_fx(spark, sf), fx.station_trips_fx(spark, sf)))


@query
def od_matrix(spark, sf):
    od, _ = stations.od_matrix(fx.station_trips_fx(spark, sf), _stations(spark, sf))
    return od.withColumn("dat", text(F.col("dat")))


@query
def od_hour_count(spark, sf):
    return stations.od_hour_count(_od(spark, sf)).withColumn("dat", text(F.col("dat")))


@query
def od_max(spark, sf):
    return stations.od_max(_od(spark, sf))


@query
def demand_max(spark, sf):
    return demand.demand_max(_counts(spark, sf))


@query
def normalize_demand(spark, sf):
    scaled = values.normalize_demand(_counts(spark, sf))
    return scaled.withColumn("scaled", F.round("scaled", 6))


@query
def outlier_values(spark, sf):
    hourly = values.outlier_values(_counts(spark, sf)).withColumn("source", F.lit("hourly"))
    visits = _visits(spark, sf).withColumnRenamed("visits", "cnt")
    by_cell = values.outlier_values(visits, share=VISIT_SHARE).withColumn("source", F.lit("visits"))
    return hourly.unionByName(by_cell)


@query
def mse(spark, sf):
    scored = evaluate.mse(_aligned(spark, sf), _dims(spark, sf), _samples(spark, sf), STEPS)
    return scored.select("city", F.round("mse", 6).alias("mse"))


@query
def horizon_mse(spark, sf):
    scored = evaluate.horizon_mse(_aligned(spark, sf), _dims(spark, sf), _samples(spark, sf))
    return scored.select("city", "step", "channel", *six("total_mse", "mean_mse"))


@query
def demand_pred_vs_actual(spark, sf):
    return evaluate.demand_pred_vs_actual(_aligned(spark, sf))


# Joins


@query
def stats_join(spark, sf):
    """One-row statistics of the whole set beside every row."""
    whole = _whole(spark, sf)
    stats = cleaning.pooled_stats(whole, ("start_lon", "end_lon"), keys=())
    return attach(whole, stats).select("trip_id", *six("mean", "std"))


@query
def axis_lookup(spark, sf):
    counts = _counts(spark, sf)
    placed = grid.axis_lookup(counts, grid.axis_rank(counts, "x"), grid.axis_rank(counts, "y"))
    return placed.select("city", "hour", "channel", "x", "y", "x_idx", "y_idx", "cnt")


@query
def station_lookup(spark, sf):
    """Only the northern stations of the station files are known, so some trips are rejected."""
    named = stations.station_first(stations.station_file_sightings(fx.stations_fx(spark, sf)))
    known = stations.station_index(named.where(F.col("lat") >= 33.54))
    counts = stations.od_station_counts(stations.tag_trips(fx.station_trips_fx(spark, sf)))
    found, rejects = stations.station_lookup(counts, known)
    lost = rejects.select("hour", F.lit(-1).cast("long").alias("o_idx"), F.lit(-1).cast("long").alias("d_idx"), "trips")
    tall = found.select("hour", "o_idx", "d_idx", "trips").unionByName(lost)
    return tall.groupBy("hour", "o_idx", "d_idx").agg(F.sum("trips").alias("trips"))


@query
def pred_actual_join(spark, sf):
    return evaluate.pred_actual_join(*_stand_in(spark, sf))


@query
def outlier_member(spark, sf):
    visits = _visits(spark, sf).withColumnRenamed("visits", "cnt")
    return values.outlier_member(visits, values.outlier_values(visits, share=VISIT_SHARE))


@query
def cell_member(spark, sf):
    cells = grid.high_demand_cells(_visits(spark, sf), min_visits=HIGH_VISITS).select("city", "x", "y")
    return lookup_join(_counts(spark, sf), cells, ["city", "x", "y"], "left_semi")


# Window functions, order, limits


@query
def cell_ids(spark, sf):
    return grid.cell_table(_tables(spark, sf).gridded, "trip_id")


@query
def axis_rank(spark, sf):
    counts = _counts(spark, sf)
    parts = [
        grid.axis_rank(counts, a).select("city", F.lit(a).alias("axis"), F.col(a).alias("place"), F.col(f"{a}_idx").alias("idx"))
        for a in ("x", "y")
    ]
    return parts[0].unionByName(parts[1])


@query
def station_index(spark, sf):
    return stations.station_index(stations.stations_from_trips(fx.station_trips_fx(spark, sf))).select("id", "tidx")


@query
def rebase_hours(spark, sf):
    tagged = demand.tag_hours(_clean(spark, sf))
    return demand.rebase_hours(tagged, demand.hour_span(tagged)).select("trip_id", "start_hour", "end_hour")


@query
def fill_hours(spark, sf):
    tables = _tables(spark, sf)
    return demand.fill_hours(tables.demand.df, tables.frame)


@query
def fill_od_hours(spark, sf):
    filled = stations.fill_od_hours(stations.od_hour_count(_od(spark, sf)))
    return filled.withColumn("dat", text(F.col("dat")))


def _window_digest(cut: DataFrame) -> DataFrame:
    """Whole-grid totals of each sample; cell and position weights make a misplaced count visible."""
    weight = F.col("x") * 1009 + F.col("y") * 9176 + F.col("channel") * 31 + 1

    def total(name: str) -> Column:
        return F.aggregate(name, F.lit(0).cast("long"), lambda a, v: a + v)

    def placed(name: str) -> Column:
        return F.aggregate(F.transform(name, lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)

    return cut.groupBy("city", "idx").agg(
        F.sum(total("features")).alias("features_total"),
        F.sum(weight * placed("features")).alias("features_placed"),
        F.sum(total("labels")).alias("labels_total"),
        F.sum(weight * placed("labels")).alias("labels_placed"),
    )


@query
def sliding_windows(spark, sf):
    return _window_digest(series.sliding_windows(_series(spark, sf), W, H))


@query
def sliding_windows_gap(spark, sf):
    return _window_digest(series.sliding_windows_gap(_series(spark, sf), W, H))


@query
def sample_time_features(spark, sf):
    """Calendar inputs of every whole-grid sample, hour by hour."""
    calendar = demand.hour_calendar(_tables(spark, sf).frame)
    tall = series.sample_time_features(series.sample_hours(calendar, W, H)).select(
        "city", "idx", F.posexplode("time_features").alias("pos", "tf")
    )
    return tall.select(
        "city",
        "idx",
        F.col("pos").cast("int").alias("pos"),
        (F.array_position(F.slice("tf", 1, 7), F.lit(1.0)) - 1).alias("weekday"),
        F.round(F.get("tf", F.lit(19)), 6).alias("hour_share"),
    )


@query
def sort_by_hour(spark, sf):
    return writers.sort_by_hour(_counts(spark, sf)).select("city", "hour", "channel", "x", "y", "cnt")


@query
def nth_sample(spark, sf):
    return evaluate.nth_sample(_aligned(spark, sf))


@query
def pos_modulo(spark, sf):
    counted = attach(_counts(spark, sf), _hours_n(spark, sf), KEYS)
    wrapped = splits.pos_modulo(F.col("hour") * 7 - 3, F.col("n") - W - H)
    return counted.select("city", "hour", "channel", "x", "y", wrapped.alias("pos"))


# Set operations and splits


@query
def union_ends(spark, sf):
    return grid.union_ends(_tables(spark, sf).gridded, ["city", "trip_id"])


@query
def union_stations(spark, sf):
    rows = stations.union_stations(fx.stations_fx(spark, sf), fx.station_trips_fx(spark, sf))
    return rows.select("id", "src", *six("lat", "lon"), text(F.col("datetime")).alias("datetime"))


@query
def cell_ids_kept(spark, sf):
    """Ids of a run over every other trip stay when a second run sees all."""
    path, gridded = _scratch(spark), _tables(spark, sf).gridded
    for part in (gridded.where("trip_id % 2 = 0"), gridded):
        ends = grid.union_ends(part, ("city", "trip_id")).withColumn("first_seen", F.col("trip_id") * 2 + F.col("channel"))
        seen = ends.groupBy("city", "x", "y").agg(F.min("first_seen").alias("first_seen"))
        kept = registry.extend_ids(seen, path, ("x", "y"), "first_seen", "cell_id")
    return kept.select("city", "x", "y", "cell_id", F.col("version").cast("int").alias("version"))


@query
def publish_tables(spark, sf):
    """Two tables of all cities, of which a second job replaces one city."""
    root = _scratch(spark)
    counts = _counts(spark, sf).select("city", "hour", "channel", "x", "y", "cnt")
    for times, cities in ((1, fx.CITIES), (2, fx.CITIES[1:2])):
        own = counts.where(F.col("city").isin(*cities)).withColumn("cnt", F.col("cnt") * times)
        with publish.publication(spark, root, cities) as folder:
            writers.write_by_city(own, f"{folder}/demand")
            writers.write_by_city(own.groupBy("city").agg(F.sum("cnt").alias("total")), f"{folder}/totals")
    demand_now, totals = publish.read_table(spark, root, "demand"), publish.read_table(spark, root, "totals")
    return demand_now.join(totals, "city").select("city", "hour", "channel", "x", "y", "cnt", "total")


@query
def distinct_axis(spark, sf):
    return grid.distinct_axis(_counts(spark, sf), "x").orderBy("city", "x")


@query
def value_except(spark, sf):
    visits = _visits(spark, sf).withColumnRenamed("visits", "cnt")
    counted = values.value_counts(visits)
    kept = counted.where(F.col("cells_below") < F.rint(F.lit(VISIT_SHARE) * F.col("n")))
    return values.value_except(visits.select("city", "cnt"), kept.select("city", "cnt"))


@query
def split_chrono(spark, sf):
    tables = _tables(spark, sf)
    train, test = splits.split_chrono(tables.demand.df, tables.frame)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def split_random(spark, sf):
    hours = demand.hour_calendar(_tables(spark, sf).frame).select("city", "hour")
    train, test = splits.split_random(hours, ["city", "hour"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


# Forecasting


@query
def lag_features(spark, sf):
    rows = series.lag_features(_series(spark, sf), LAGS)
    weight = F.col("x") * 1009 + F.col("y") * 9176 + F.col("channel") * 31 + 1
    lagged = [F.sum(weight * F.get("lags", F.lit(j))).cast("long").alias(f"lag_{k}") for j, k in enumerate(LAGS)]
    return rows.groupBy("city", "hour").agg(
        *lagged,
        F.sum(weight * F.col("label")).cast("long").alias("label"),
        F.max(F.array_position(F.slice("time_features", 1, 7), F.lit(1.0)) - 1).alias("weekday"),
        F.round(F.max(F.get("time_features", F.lit(19))), 6).alias("hour_share"),
    )


@lru_cache(maxsize=8)
def _train(spark: SparkSession, sf: str) -> DataFrame:
    return stage(series.split_series(_series(spark, sf), 0.9)[0], "train").df


@lru_cache(maxsize=8)
def _fitted(spark: SparkSession, sf: str) -> forecast.Forecaster:
    """Several lags and the calendar."""
    return forecast.fit_forecaster(series.lag_features(_train(spark, sf), LAGS), LAGS)


@lru_cache(maxsize=8)
def _fitted_lag(spark: SparkSession, sf: str) -> forecast.Forecaster:
    """Counts explained by the hour before alone, which SQL can fit too."""
    return forecast.fit_forecaster(series.lag_features(_train(spark, sf), (1,)), (1,), calendar=False)


# A small recurrent network: what a query trains must stay a matter of seconds.
NETWORK = {"hidden": 6, "passes": 3, "steps": 2, "rate": 0.02}


@lru_cache(maxsize=8)
def _recurrent(spark: SparkSession, sf: str, kind: str) -> forecast.Forecaster:
    return forecast.fit_recurrent(_train(spark, sf), W, kind, path=_scratch(spark), **NETWORK)


@query
def fit_forecaster(spark, sf):
    """Weights of all lags and of the calendar, and the training loss."""
    fitted = _fitted(spark, sf)
    names = [f"lag_{k}" for k in LAGS] + [f"calendar_{i}" for i in forecast.CALENDAR] + ["intercept"]
    rows = [*zip(names, fitted.weights, strict=True), ("loss", fitted.losses[0])]
    return spark.createDataFrame(rows, "input string, weight double").select("input", *six("weight"))


@query
def fit_forecaster_lag(spark, sf):
    """Weights and training loss of one lag."""
    fitted = _fitted_lag(spark, sf)
    rows = [("lag_1", fitted.weights[0]), ("intercept", fitted.weights[1]), ("loss", fitted.losses[0])]
    return spark.createDataFrame(rows, "input string, weight double").select("input", *six("weight"))


@query
def fit_recurrent(spark, sf):
    """The loss of each pass of every recurrent kind."""
    rows = [(kind, i, loss) for kind in forecast.RECURRENT for i, loss in enumerate(_recurrent(spark, sf, kind).losses)]
    return spark.createDataFrame(rows, "kind string, pass int, loss double").select("kind", "pass", *six("loss"))


@query
def loss_history(spark, sf):
    """A training that is stopped after two passes and finished by a second run."""
    path = _scratch(spark)
    for passes in (2, 3):
        fitted = forecast.fit_recurrent(_train(spark, sf), W, "gru", path=path, **{**NETWORK, "passes": passes})
        forecast.save_forecaster(spark, fitted, path)
    return forecast.loss_history(spark, path).select("pass", *six("loss"))


@query
def loss_history_lag(spark, sf):
    """The same training saved twice, one after the other."""
    path = _scratch(spark)
    for _ in range(2):
        forecast.save_forecaster(spark, _fitted_lag(spark, sf), path)
    return forecast.loss_history(spark, path).select("pass", *six("loss"))


# Weights that SQL repeats: two lags, weekdays from Tuesday, months from February, the
# share of the day, and the intercept.
WEIGHTS = (0.37, 0.21, *[0.011 * i for i in range(2, 8)], *[0.003 * i for i in range(2, 13)], 0.07, 0.013)
FIXED = forecast.Forecaster("linear", (1, 24), WEIGHTS)


def _forecast(spark: SparkSession, sf: str, fitted: forecast.Forecaster) -> DataFrame:
    _, test = series.split_series(_series(spark, sf), 0.9)
    aligned = forecast.forecast_windows(series.sliding_windows(test, W, H), fitted, W, H)
    scores = evaluate.sample_scores(aligned)
    return scores.select("city", "idx", "step", "channel", *six("se"), "pred", "actual")


def _reloaded(spark: SparkSession, fitted: forecast.Forecaster) -> forecast.Forecaster:
    path = _scratch(spark)
    forecast.save_forecaster(spark, fitted, path)
    return forecast.load_forecaster(spark, path)


@query
def save_load_model(spark, sf):
    """Forecasts of a fitted model that was saved and loaded."""
    return _forecast(spark, sf, _reloaded(spark, _fitted(spark, sf)))


@query
def save_load_model_fixed(spark, sf):
    """Forecasts of given weights that were saved and loaded."""
    return _forecast(spark, sf, _reloaded(spark, FIXED))


@query
def forecast_recursive(spark, sf):
    """The fitted model rolled out."""
    return _forecast(spark, sf, _fitted(spark, sf))


@query
def forecast_recursive_fixed(spark, sf):
    """Given weights rolled out."""
    return _forecast(spark, sf, FIXED)


@query
def forecast_recurrent(spark, sf):
    """A recurrent network, saved and loaded, rolled out with its hidden state."""
    return _forecast(spark, sf, _reloaded(spark, _recurrent(spark, sf, "lstm")))


@lru_cache(maxsize=8)
def _tile_encoder(spark: SparkSession, sf: str) -> latent.GridEncoder:
    """All components of tiles of several cells."""
    return latent.fit_encoder(_counts(spark, sf), _hours_n(spark, sf), k=2 * TILE * TILE, tile=TILE)


def _weighed_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The codes of tiles, and ``weighed``: each component times its variance."""
    encoder = _tile_encoder(spark, sf)
    z = latent.encode_grid(_counts(spark, sf), encoder)
    variances = latent.component_variances(z, encoder, _hours_n(spark, sf))
    weighed = F.zip_with("z", "variances", lambda v, w: v * w)
    return z.join(variances, ["city", "tx", "ty"]).withColumn("weighed", weighed)


@query
def encode_grid(spark, sf):
    """The squared length of each tile's code, and the spread of the tile's codes along it.

    With all components the length is that of the counts. The spread is that of the
    counts only if the axes are the principal ones.
    """
    z = _weighed_codes(spark, sf)
    energy = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + v * v)
    along = F.aggregate(F.zip_with("z", "weighed", lambda v, w: v * w), F.lit(0.0), lambda acc, v: acc + v)
    spread = F.sqrt(F.greatest(along, F.lit(0.0)) / energy)
    return z.select("city", "hour", "tx", "ty", F.round(energy, 6).alias("energy"), F.round(spread, 6).alias("spread"))


@query
def decode_grid(spark, sf):
    """Every known cell of the tiles that have a code, quiet cells too.

    ``yhat`` is decoded from the code: with all components, the counts themselves.
    ``shared`` is decoded from the code weighed by variances: how the cell varies with
    the tile's counts, times the squared hours, which makes it whole.
    """
    encoder = _tile_encoder(spark, sf)
    codes, place = _weighed_codes(spark, sf), ["city", "hour", "channel", "x", "y"]
    back = latent.decode_grid(codes.select("city", "hour", "tx", "ty", "z"), encoder)
    weighed = latent.decode_grid(codes.select("city", "hour", "tx", "ty", F.col("weighed").alias("z")), encoder)
    both = back.join(weighed.withColumnRenamed("yhat", "shared"), place)
    sized = attach(both, _hours_n(spark, sf), KEYS)
    shared = F.round(F.col("shared") * F.col("n") * F.col("n"))
    # Quiet cells come back as zeros of either sign.
    return sized.select(*place, (F.round("yhat", 6) + 0.0).alias("yhat"), (shared + 0.0).alias("shared"))


@query
def reconstruction_mse(spark, sf):
    """Error of the codes of tiles, with fewer components than columns."""
    encoder = latent.fit_encoder(_counts(spark, sf), _hours_n(spark, sf), k=2, tile=TILE)
    return latent.reconstruction_mse(_counts(spark, sf), encoder, _hours_n(spark, sf)).select("city", *six("mse"))


CONV = conv.Shape(inner=4, code=2)


@lru_cache(maxsize=8)
def _conv_encoder(spark: SparkSession, sf: str) -> conv.ConvEncoder:
    return conv.fit_conv_encoder(_counts(spark, sf), _hours_n(spark, sf), CONV, passes=3, steps=2, path=_scratch(spark))


@query
def encode_conv(spark, sf):
    """Codes of tiles that see the cells around them."""
    codes = conv.encode_tiles(_counts(spark, sf), _conv_encoder(spark, sf))
    return codes.select("city", "hour", "tx", "ty", F.transform("z", lambda v: F.round(v, 6)).cast("string").alias("z"))


@query
def decode_conv(spark, sf):
    encoder = _conv_encoder(spark, sf)
    back = conv.decode_tiles(conv.encode_tiles(_counts(spark, sf), encoder), encoder)
    return back.groupBy("city", "x", "y", "channel").agg(F.count(F.lit(1)).alias("hours"), F.round(F.avg("yhat"), 6).alias("yhat"))


@query
def conv_surroundings(spark, sf):
    """How many counts each tile and hour sees, in it and around it."""
    seen = conv.tiles(_counts(spark, sf))
    total = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["cnt"]).cast("long")
    slots = F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + c["slot"])
    return seen.select("city", "hour", "tx", "ty", F.size("cells").cast("long").alias("cells"), total.alias("cnt"), slots.alias("slots"))


@query
def conv_mse(spark, sf):
    return conv.conv_mse(_counts(spark, sf), _conv_encoder(spark, sf), _hours_n(spark, sf)).select("city", *six("mse"))


@lru_cache(maxsize=8)
def _cell_encoder(spark: SparkSession, sf: str) -> latent.GridEncoder:
    """One number for the two channels of each cell, whose axis SQL can write down."""
    return latent.fit_encoder(_counts(spark, sf), _hours_n(spark, sf), k=1, tile=1)


@query
def encode_grid_cell(spark, sf):
    """Squares of the codes of single cells; the sign of an axis is free."""
    z = latent.encode_grid(_counts(spark, sf), _cell_encoder(spark, sf))
    code = F.get("z", F.lit(0))
    return z.select("city", "hour", F.col("tx").alias("x"), F.col("ty").alias("y"), F.round(code * code, 6).alias("energy"))


@query
def decode_grid_cell(spark, sf):
    """What comes back from the codes of single cells."""
    encoder = _cell_encoder(spark, sf)
    back = latent.decode_grid(latent.encode_grid(_counts(spark, sf), encoder), encoder)
    return back.select("city", "hour", "channel", "x", "y", *six("yhat"))


@query
def reconstruction_mse_cell(spark, sf):
    """Error of the code of each cell."""
    scored = latent.reconstruction_mse(_counts(spark, sf), _cell_encoder(spark, sf), _hours_n(spark, sf))
    return scored.select("city", *six("mse"))


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.score_forecast(_aligned(spark, sf), _dims(spark, sf), _samples(spark, sf), STEPS)


@query
def score_forecast(spark, sf):
    return _report(spark, sf).withColumn("value", F.round("value", 6))


@query
def heatmap_cells(spark, sf):
    return evaluate.heatmap_cells(_aligned(spark, sf))


@query
def series_total_demand(spark, sf):
    return evaluate.series_total_demand(_report(spark, sf)).withColumn("value", F.round("value", 6))


@query
def series_loss(spark, sf):
    return evaluate.series_loss(_report(spark, sf)).withColumn("value", F.round("value", 6))


@lru_cache(maxsize=8)
def _stored_set(spark: SparkSession, sf: str) -> str:
    """A demand set as the demand job leaves it."""
    out = _scratch(spark)
    writers.write_demand(demand_plan.stored_demand(_tables(spark, sf)), f"{out}/demand")
    _dims(spark, sf).df.write.parquet(f"{out}/dims")
    return out


@query
def exp_plain_lstm(spark, sf):
    """The older experiment with a recurrent network that is trained on its random hours."""
    scored = forecast_plan.run_plain_forecast(spark, _stored_set(spark, sf), W, H, kind="lstm", **NETWORK)
    return scored.select("city", *six("mse"))


@query
def exp_plain_lags(spark, sf):
    """The older experiment with a regression on several lags."""
    scored = forecast_plan.run_plain_forecast(spark, _stored_set(spark, sf), W, H, lags=LAGS)
    return scored.select("city", *six("mse"))


@query
def exp_plain_fixed(spark, sf):
    """The older experiment with given weights."""
    scored = forecast_plan.run_plain_forecast(spark, _stored_set(spark, sf), W, H, fitted=FIXED)
    return scored.select("city", *six("mse"))


@query
def exp_autoencoder(spark, sf):
    """The older experiment with the library's own tiles and components."""
    return forecast_plan.run_encoder(spark, _stored_set(spark, sf)).select("city", *six("mse"))


@query
def exp_autoencoder_cell(spark, sf):
    """The older experiment with one number for each cell."""
    scored = forecast_plan.run_encoder(spark, _stored_set(spark, sf), k=1, tile=1)
    return scored.select("city", *six("mse"))


@query
def exp_autoencoder_conv(spark, sf):
    """The older experiment with convolutions."""
    scored = forecast_plan.run_conv_encoder(spark, _stored_set(spark, sf), CONV, passes=2, steps=2)
    return scored.select("city", *six("mse"))
