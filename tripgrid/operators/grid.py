"""From coordinates to cells, and tables about cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripgrid.config import CELL_M, CELL_Z_MIN, EARTH_CIRCUMFERENCE_M, ColumnMap
from tripgrid.functions.numbers import grid_cell, zscore
from tripgrid.operators.cleaning import CITY
from tripgrid.operators.lookup import attach, lookup_join
from tripgrid.operators.ranking import dense_position
from tripgrid.session import Staged, stage


def box_columns(columns: ColumnMap) -> list[Column]:
    return [
        F.min(F.least(*columns.lats)).alias("min_lat"),
        F.min(F.least(*columns.lons)).alias("min_lon"),
        F.max(F.greatest(*columns.lats)).alias("max_lat"),
        F.max(F.greatest(*columns.lons)).alias("max_lon"),
    ]


def bounding_box(df: DataFrame, keys: Sequence[str] = CITY, columns: ColumnMap = ColumnMap()) -> DataFrame:
    """Extremes over both ends of the trips: min_lat, min_lon, max_lat, max_lon."""
    return df.groupBy(*keys).agg(*box_columns(columns))


def grid_trips(
    df: DataFrame,
    box: DataFrame | Staged,
    keys: Sequence[str] = CITY,
    columns: ColumnMap = ColumnMap(),
    cell_m: int = CELL_M,
    circumference_m: int = EARTH_CIRCUMFERENCE_M,
) -> DataFrame:
    """Replace coordinates by ``start_x, start_y, end_x, end_y``."""
    held = box if isinstance(box, Staged) else stage(box, "box")
    boxed = attach(df, Staged(held.df.select(*keys, "min_lat", "min_lon"), held.rows, held.path), keys)
    corner = (F.col("min_lat"), F.col("min_lon"))
    start_x, start_y = grid_cell(
        F.col(columns.start_lat), F.col(columns.start_lon), *corner, cell_m, circumference_m
    )
    end_x, end_y = grid_cell(F.col(columns.end_lat), F.col(columns.end_lon), *corner, cell_m, circumference_m)
    return boxed.withColumns({"start_x": start_x, "start_y": start_y, "end_x": end_x, "end_y": end_y}).drop(
        "min_lat", "min_lon", *columns.lats, *columns.lons
    )


def union_ends(gridded: DataFrame, carry: Sequence[str] = CITY) -> DataFrame:
    """One row per trip end: ``channel`` 0 for the start, 1 for the end."""
    ends = F.array(
        F.struct(F.lit(0).alias("channel"), F.col("start_x").alias("x"), F.col("start_y").alias("y")),
        F.struct(F.lit(1).alias("channel"), F.col("end_x").alias("x"), F.col("end_y").alias("y")),
    )
    return gridded.select(*carry, F.inline(ends))


def cell_visits(gridded: DataFrame, keys: Sequence[str] = CITY) -> DataFrame:
    """Visits per cell, both trip ends counted once each."""
    return union_ends(gridded, keys).groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("visits"))


def cell_table(gridded: DataFrame, order: str, keys: Sequence[str] = CITY, **rank) -> DataFrame:
    """``x, y, cell_id, visits``; ids follow the order in which cells were first seen.

    ``order`` is the row order of the trips. A trip's start is seen before its end.
    """
    seen = (
        union_ends(gridded, [*keys, order])
        .groupBy(*keys, "x", "y")
        .agg(
            F.count(F.lit(1)).alias("visits"),
            F.min(F.col(order) * 2 + F.col("channel")).alias("first_seen"),
        )
    )
    return _numbered(seen, keys, **rank)


def cells_of_demand(counts: DataFrame, keys: Sequence[str] = CITY, **rank) -> DataFrame:
    """The same table from hourly counts with ``first_seen``, without another pass over the trips."""
    return _numbered(seen_cells(counts, keys), keys, **rank)


def seen_cells(counts: DataFrame, keys: Sequence[str] = CITY) -> DataFrame:
    """``x, y, visits, first_seen`` from hourly counts with ``first_seen``."""
    return counts.groupBy(*keys, "x", "y").agg(F.sum("cnt").alias("visits"), F.min("first_seen").alias("first_seen"))


def _numbered(seen: DataFrame, keys: Sequence[str], **rank) -> DataFrame:
    return dense_position(seen, "first_seen", "cell_id", keys, **rank).select(*keys, "x", "y", "cell_id", "visits")


def distinct_axis(ends: DataFrame, axis: str, keys: Sequence[str] = CITY) -> DataFrame:
    """The ``x`` (or ``y``) values that occur in each set."""
    return ends.select(*keys, axis).distinct()


def axis_rank(ends: DataFrame, axis: str, keys: Sequence[str] = CITY) -> DataFrame:
    """The distinct ``x`` (or ``y``) values of a set, numbered from 0 in order.

    There are at most 160,000 of them in a set: the circumference over the cell side.
    """
    return dense_position(distinct_axis(ends, axis, keys), axis, f"{axis}_idx", keys)


def axis_lookup(ends: DataFrame, x_axis: DataFrame | Staged, y_axis: DataFrame | Staged, keys: Sequence[str] = CITY) -> DataFrame:
    """Add the matrix position ``x_idx, y_idx`` of each cell."""
    placed = lookup_join(ends, x_axis, [*keys, "x"])
    return lookup_join(placed, y_axis, [*keys, "y"])


def grid_dims(x_axis: DataFrame, y_axis: DataFrame, keys: Sequence[str] = CITY) -> DataFrame:
    """Matrix size ``nx, ny`` of each set."""
    tall = x_axis.select(*keys, F.lit(1).alias("ax")).unionByName(y_axis.select(*keys, F.lit(0).alias("ax")))
    return tall.groupBy(*keys).agg(
        F.sum("ax").alias("nx"), F.sum(1 - F.col("ax")).alias("ny")
    )


def high_demand_cells(
    visits: DataFrame, keys: Sequence[str] = CITY, z_min: float = CELL_Z_MIN, min_visits: int | None = None
) -> DataFrame:
    """Cells whose visit count is not far below average, or at least ``min_visits``."""
    if min_visits is not None:
        return visits.where(F.col("visits") >= min_visits)
    held = stage(visits, "visits")
    stats = held.df.groupBy(*keys).agg(F.avg("visits").alias("mean"), F.stddev_pop("visits").alias("std"))
    scored = attach(held.df, stats, keys)
    return scored.where(zscore(F.col("visits"), F.col("mean"), F.col("std")) > z_min).drop("mean", "std")


def trips_in_cells(gridded: DataFrame, cells: DataFrame, keys: Sequence[str] = CITY, **join) -> DataFrame:
    """Trips that start and end in one of ``cells``."""
    held = stage(cells.select(*keys, "x", "y"), "cells")
    for end in ("start", "end"):
        named = held.df.withColumnsRenamed({"x": f"{end}_x", "y": f"{end}_y"})
        on = [*keys, f"{end}_x", f"{end}_y"]
        gridded = lookup_join(gridded, Staged(named, held.rows, held.path), on, "left_semi", **join)
    return gridded
