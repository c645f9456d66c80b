"""Writers for the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_city(df: DataFrame, path: str) -> None:
    """Overwrite the folders of the cities in ``df`` and leave the others alone.

    Rows are rebalanced by city first: a large city is spread over several files of
    even size and small cities do not leave one file per task.
    """
    _replace_cities(df.hint("rebalance", "city"), path)


def _replace_cities(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("city").parquet(path)


def write_demand(demand: DataFrame, path: str) -> None:
    write_by_city(demand, path)


def write_trips(trips: DataFrame, path: str) -> None:
    """Trips where they are: they were read city by city, so each task has one city or two."""
    _replace_cities(trips, path)


def write_cells(cells: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Cell table as ``parquet`` or ``csv``."""
    writer = cells.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_od(od: DataFrame, path: str) -> None:
    """OD counts, sorted by hour inside each file so that hour filters skip row groups."""
    place = ("hour", "o_idx", "d_idx")
    od.repartitionByRange(*place).sortWithinPartitions(*place).write.mode("overwrite").parquet(path)


def write_stations(stations: DataFrame, path: str) -> None:
    stations.write.mode("overwrite").parquet(path)


def sort_by_hour(df: DataFrame, hour: str = "hour") -> DataFrame:
    """Global order by hour, for a sink that has to be read in order."""
    return df.orderBy(hour)


def append_eval(report: DataFrame, path: str, run_id: str) -> None:
    """Add one run's report, by city. The same run written again replaces itself."""
    stamped = report.withColumn("run_id", F.lit(run_id))
    (
        stamped.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("city", "run_id")
        .parquet(path)
    )
