"""Trip files to the stored hourly demand set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripgrid.config import CELL_MIN_VISITS, CityConfig, ColumnMap
from tripgrid.functions.dates import hour_interval, parse_ts
from tripgrid.functions.order import reading_order
from tripgrid.operators import cleaning, demand, grid
from tripgrid.operators.cleaning import CITY
from tripgrid.operators.lookup import attach
from tripgrid.session import Staged, pin_utc, scratch, stage
from tripgrid.sources import readers, registry, writers
from tripgrid.sources.publish import publication


@dataclass(frozen=True)
class DemandTables:
    """``gridded`` trips, their ``frame`` (box and hour span), and ``demand``."""

    gridded: DataFrame
    frame: Staged
    demand: Staged


def demand_tables(
    trips: DataFrame,
    keys: Sequence[str] = CITY,
    columns: ColumnMap = ColumnMap(),
    carry: Sequence[str] = (),
    bucket_end_by: str = "start",
    order: str | None = None,
) -> DemandTables:
    """From typed trips without nulls to hourly counts.

    Three narrow passes find the statistics (longitudes, latitudes of the survivors,
    box and hours), one more counts. The counts are stored because several tables are
    made from them.
    """
    kept = cleaning.zscore_filter(trips, keys, columns)
    tagged = demand.tag_hours(cleaning.project_needed(kept, [*keys, *carry], columns), columns)
    frame = stage(demand.trip_frame(tagged, keys, columns), "frame")
    gridded = demand.rebase_hours(grid.grid_trips(tagged, frame, keys, columns), frame, keys)
    counts = stage(demand.hourly_demand(gridded, keys, bucket_end_by, order), "demand")
    return DemandTables(gridded, frame, counts)


def stored_demand(
    tables: DemandTables, keys: Sequence[str] = CITY, time_base: str = "true", drop_last: bool = True
) -> DataFrame:
    """``hour, t0, t1, channel, x, y, cnt`` for every hour of the calendar."""
    filled = demand.fill_hours(tables.demand.df, tables.frame, keys, drop_last)
    frame = tables.frame
    first = Staged(frame.df.select(*keys, "first_hour"), frame.rows, frame.path)
    base = F.col("first_hour") if time_base == "true" else F.lit(0).cast("long")
    t0, t1 = hour_interval(base + F.col("hour"))
    return attach(filled, first, keys).select(
        *keys, "hour", t0.alias("t0"), t1.alias("t1"), "channel", "x", "y", "cnt"
    )


def read_city(spark: SparkSession, job: CityConfig, path: str | Sequence[str]) -> DataFrame:
    """Typed, null-free trips of one city: the six needed columns and the reading order."""
    c = job.columns
    texts = cleaning.repair_dates(readers.scan_trips(spark, path, c, job.city), c)
    whole = cleaning.drop_nulls(cleaning.drop_zero_distance(texts, c))
    typed = cleaning.cast_coords(whole, c).withColumns(
        {t: parse_ts(F.col(t), job.time_format) for t in (c.start_time, c.end_time)}
    )
    order = reading_order(F.col("file_ord"), F.col("row_ord"))
    named = [F.col(f).alias(t) for t, f in zip(_STANDARD, (c.start_time, c.end_time, *c.lats, *c.lons))]
    once = cleaning.computed_once(typed.select("city", order.alias("row_ord"), *named))
    return cleaning.drop_nulls(once)


_STANDARD = (
    ColumnMap().start_time, ColumnMap().end_time, *ColumnMap().lats, *ColumnMap().lons,
)


def _cells(counts: DataFrame, ids: str | None) -> DataFrame:
    if ids is None:
        return grid.cells_of_demand(counts)
    seen = stage(grid.seen_cells(counts), "seen").df
    kept = registry.extend_ids(seen, f"{ids}/cells", ("x", "y"), "first_seen", "cell_id")
    return seen.join(kept, ["city", "x", "y"]).select("city", "x", "y", "cell_id", "visits")


def run_demand_job(
    spark: SparkSession,
    jobs: Sequence[CityConfig],
    paths: Mapping[str, str],
    out: str,
    drop_last: bool = True,
    time_base: str = "true",
    bucket_end_by: str = "start",
    min_visits: int = CELL_MIN_VISITS,
    publish: bool = False,
    ids: str | None = None,
) -> None:
    """All cities at once. Writes ``demand``, ``trips``, ``cells``, ``cell_mask``, ``x_axis``, ``y_axis`` and ``dims``.

    With ``publish`` readers see all these tables change at once (``publish.read_table``).
    With ``ids``, a path, cells keep the ids that earlier jobs gave them there.

    The text is read once into columns; every later pass reads only what it needs. The
    hourly counts also keep which trip was seen first, so cells are made from them.
    ``cell_mask`` has the cells with at least ``min_visits`` visits.
    """
    pin_utc(spark)
    if publish:
        with publication(spark, out, [job.city for job in jobs]) as folder:
            run_demand_job(spark, jobs, paths, folder, drop_last, time_base, bucket_end_by, min_visits, ids=ids)
        return
    with scratch(spark):
        cities = [read_city(spark, job, paths[job.city]) for job in jobs]
        trips = stage(reduce(DataFrame.unionByName, cities), "trips").df
        tables = demand_tables(trips, carry=("row_ord",), bucket_end_by=bucket_end_by, order="row_ord")
        writers.write_demand(stored_demand(tables, time_base=time_base, drop_last=drop_last), f"{out}/demand")
        writers.write_trips(tables.gridded.drop("row_ord"), f"{out}/trips")
        axes = {axis: stage(grid.axis_rank(tables.demand.df, axis), "axis").df for axis in ("x", "y")}
        cells = stage(_cells(tables.demand.df, ids), "cells").df
        writers.write_by_city(cells, f"{out}/cells")
        writers.write_by_city(grid.high_demand_cells(cells, min_visits=min_visits), f"{out}/cell_mask")
        writers.write_by_city(axes["x"], f"{out}/x_axis")
        writers.write_by_city(axes["y"], f"{out}/y_axis")
        writers.write_by_city(grid.grid_dims(axes["x"], axes["y"]), f"{out}/dims")
