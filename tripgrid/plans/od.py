"""Station and trip files to station-to-station counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from tripgrid.config import OD_ORIGIN
from tripgrid.operators import stations as st
from tripgrid.session import pin_utc, scratch, stage
from tripgrid.sources import readers, writers

_TRIP_COLUMNS = (
    "file_ord", "row_ord", "start_time", "end_time", "start_station", "end_station",
    "start_lat", "start_lon", "end_lat", "end_lon",
)


def run_od_job(
    spark: SparkSession,
    station_files: str | Sequence[str],
    trip_files: str | Sequence[str],
    out: str,
    origin: str = OD_ORIGIN,
) -> None:
    """Writes ``stations``, ``od``, ``od_hours``, ``rejects`` (unknown stations) and ``early_trips``.

    The trip text is read once and serves both the station table and the counts.
    """
    pin_utc(spark)
    with scratch(spark):
        trips = stage(readers.scan_trips_drift(spark, trip_files).select(*_TRIP_COLUMNS), "odtrips").df
        stations = stage(st.station_table(readers.scan_stations(spark, station_files), trips), "stations")
        od, rejects = st.od_matrix(trips, stations, origin)
        counts = stage(od, "od").df
        writers.write_stations(stations.df, f"{out}/stations")
        writers.write_od(counts, f"{out}/od")
        hours = st.od_hour_count(counts)
        st.fill_od_hours(hours, origin).write.mode("overwrite").parquet(f"{out}/od_hours")
        st.trips_before_origin(hours).write.mode("overwrite").parquet(f"{out}/early_trips")
        rejects.write.mode("overwrite").parquet(f"{out}/rejects")
