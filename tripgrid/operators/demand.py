"""Hourly start and end counts per cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripgrid.config import HOUR_OFFSET_S, HOUR_S, ColumnMap
from tripgrid.functions.dates import hour_interval, hour_tag, tag_to_ts
from tripgrid.operators.cleaning import CITY
from tripgrid.operators.grid import box_columns, union_ends
from tripgrid.operators.lookup import attach
from tripgrid.session import Staged, stage

TIME_BASES = ("true", "rebased")


def tag_hours(
    df: DataFrame, columns: ColumnMap = ColumnMap(), step_s: int = HOUR_S, offset_s: int = HOUR_OFFSET_S
) -> DataFrame:
    """Replace both timestamps by bucket numbers ``start_hour, end_hour``."""
    return df.withColumns(
        {
            "start_hour": hour_tag(F.col(columns.start_time), step_s, offset_s),
            "end_hour": hour_tag(F.col(columns.end_time), step_s, offset_s),
        }
    ).drop(columns.start_time, columns.end_time)


def hour_span(df: DataFrame, keys: Sequence[str] = CITY, hour: str = "start_hour") -> DataFrame:
    """First and last bucket of each set: ``first_hour, last_hour``."""
    return df.groupBy(*keys).agg(F.min(hour).alias("first_hour"), F.max(hour).alias("last_hour"))


def trip_frame(tagged: DataFrame, keys: Sequence[str] = CITY, columns: ColumnMap = ColumnMap()) -> DataFrame:
    """Bounding box and hour span together, in one pass over the trips."""
    return tagged.groupBy(*keys).agg(
        *box_columns(columns),
        F.min("start_hour").alias("first_hour"),
        F.max("start_hour").alias("last_hour"),
    )


def rebase_hours(tagged: DataFrame, span: DataFrame | Staged, keys: Sequence[str] = CITY) -> DataFrame:
    """Count both hours from the first start hour of the set."""
    held = span if isinstance(span, Staged) else stage(span, "span")
    first = Staged(held.df.select(*keys, "first_hour"), held.rows, held.path)
    return (
        attach(tagged, first, keys)
        .withColumns(
            {
                "start_hour": F.col("start_hour") - F.col("first_hour"),
                "end_hour": F.col("end_hour") - F.col("first_hour"),
            }
        )
        .drop("first_hour")
    )


def hourly_demand(
    gridded: DataFrame, keys: Sequence[str] = CITY, bucket_end_by: str = "start", order: str | None = None
) -> DataFrame:
    """``hour, channel, x, y, cnt``: trips that start (0) and end (1) in each cell.

    With ``order``, the row order of the trips, also ``first_seen``, the place of the
    first of them; a trip's start is seen before its end. Trip ends are counted in the hour the trip started, or with ``bucket_end_by="end"``
    in the hour it ended. Cells without trips have no row. The count is combined
    before the shuffle, so a cell that holds a third of all trips arrives as one row
    per task.
    """
    if bucket_end_by not in ("start", "end"):
        raise ValueError(f"bucket_end_by must be 'start' or 'end', not {bucket_end_by!r}")
    ends = union_ends(gridded, [*keys, "start_hour", "end_hour", *([order] if order else [])])
    hour = F.col("start_hour")
    if bucket_end_by == "end":
        hour = F.when(F.col("channel") == 0, F.col("start_hour")).otherwise(F.col("end_hour"))
    first = [F.min(F.col(order) * 2 + F.col("channel")).alias("first_seen")] if order else []
    return ends.groupBy(*keys, hour.alias("hour"), "channel", "x", "y").agg(F.count(F.lit(1)).alias("cnt"), *first)


def hour_calendar(
    span: DataFrame | Staged,
    keys: Sequence[str] = CITY,
    drop_last: bool = True,
    time_base: str = "true",
    step_s: int = HOUR_S,
    offset_s: int = HOUR_OFFSET_S,
) -> DataFrame:
    """Every rebased hour of each set with its interval ``t0, t1``.

    The last hour is usually cut short by the end of the file and is left out unless
    ``drop_last`` is off. ``time_base="rebased"`` counts the interval from the epoch
    instead of from the true first hour.
    """
    if time_base not in TIME_BASES:
        raise ValueError(f"time_base must be one of {TIME_BASES}, not {time_base!r}")
    table = span.df if isinstance(span, Staged) else span
    stop = F.col("last_hour") - F.col("first_hour") - (1 if drop_last else 0)
    hours = F.when(stop >= 0, F.sequence(F.lit(0).cast("long"), stop))
    listed = table.select(*keys, "first_hour", F.explode(hours).alias("hour"))
    base = F.col("first_hour") if time_base == "true" else F.lit(0).cast("long")
    t0, t1 = hour_interval(base + F.col("hour"), step_s, offset_s)
    return listed.select(*keys, "hour", t0.alias("t0"), t1.alias("t1"))


def fill_hours(
    demand: DataFrame, span: DataFrame | Staged, keys: Sequence[str] = CITY, drop_last: bool = True
) -> DataFrame:
    """Demand restricted to the calendar, plus one empty row per hour without trips.

    An empty row has ``cnt`` 0 and no cell. Only the list of hours is joined; the
    demand rows stay where they are.
    """
    held = span if isinstance(span, Staged) else stage(span, "span")
    calendar = hour_calendar(held, keys, drop_last).select(*keys, "hour")
    seen = demand.select(*keys, "hour").distinct()
    empty = calendar.join(seen, [*keys, "hour"], "left_anti").select(
        *keys,
        "hour",
        F.lit(None).cast("int").alias("channel"),
        F.lit(None).cast("int").alias("x"),
        F.lit(None).cast("int").alias("y"),
        F.lit(0).cast("long").alias("cnt"),
    )
    limit = F.col("last_hour") - F.col("first_hour") - (1 if drop_last else 0)
    kept = (
        attach(demand, Staged(held.df.select(*keys, "first_hour", "last_hour"), held.rows, held.path), keys)
        .where((F.col("hour") >= 0) & (F.col("hour") <= limit))
        .select(*keys, "hour", "channel", "x", "y", "cnt")
    )
    return kept.unionByName(empty)


def total_demand(filled: DataFrame, keys: Sequence[str] = CITY) -> DataFrame:
    """Starts plus ends of each hour."""
    return filled.groupBy(*keys, "hour").agg(F.sum("cnt").alias("total"))


def demand_max(demand: DataFrame, keys: Sequence[str] = CITY) -> DataFrame:
    return demand.groupBy(*keys).agg(F.max("cnt").alias("max_cnt"))


def with_hour_start(demand: DataFrame, span: DataFrame | Staged, keys: Sequence[str] = CITY) -> DataFrame:
    """Add the true start ``t0`` of each rebased hour."""
    held = span if isinstance(span, Staged) else stage(span, "span")
    first = Staged(held.df.select(*keys, "first_hour"), held.rows, held.path)
    return attach(demand, first, keys).withColumn("t0", tag_to_ts(F.col("first_hour") + F.col("hour"))).drop("first_hour")

