"""Readers for trip files, station files and the stored demand set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from tripgrid.config import STATION_RENAMES, ColumnMap
from tripgrid.functions.numbers import blank_to_null
from tripgrid.operators.lookup import lookup_join
from tripgrid.operators.ranking import range_position
from tripgrid.sources import quoted

# Room for the rows of one partition in a row number. Row numbers within a partition
# stay below 2**33, so this never overflows.
_ROWS = 10**11


_FORMAT = {"escape": '"'}


def _csv(spark: SparkSession) -> DataFrameReader:
    """Fields may be quoted and may then hold commas and doubled quotes.

    Files whose quoted fields hold line breaks are read by ``_read_records``.
    """
    return spark.read.option("header", True).options(**_FORMAT)


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path``: files behind paths or patterns, as the metadata column prints them.

    Only names are read, no content.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("binaryFile").load(roots).select(F.col("_metadata.file_path").alias("path"))


def _headers(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[tuple[str, ...], list[str]]]:
    """Column names and files of each header line that occurs, found in one job over all files.

    The job keeps the first line of each file, before anything is shuffled; reading the
    names costs one more for each different header. Spark's reader keeps the names of
    the files it reads on the driver, and so does this.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(roots).where(F.col("_metadata.file_block_start") == 0)
    first = lines.select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at"))
    heads = first.groupBy("path").agg(F.min_by("value", "at").alias("head"))
    groups = heads.groupBy("head").agg(F.array_sort(F.collect_list("path")).alias("files")).collect()
    return [(tuple(_csv(spark).csv(unquote(g["files"][0])).columns), g["files"]) for g in groups]


def _in_reading_order(part: DataFrame) -> DataFrame:
    """Text columns with null tokens removed, the file, and ``row_ord`` inside it.

    ``row_ord`` grows with the row also when a file is read in several pieces.
    """
    piece = F.col("_metadata.file_block_start").cast("decimal(15,0)") * F.lit(_ROWS).cast("decimal(12,0)")
    row = F.pmod(F.monotonically_increasing_id(), F.lit(2**33))
    return part.select(
        *[blank_to_null(F.col(c)).alias(c) for c in part.columns],
        F.col("_metadata.file_path").alias("path"),
        (piece + row.cast("decimal(11,0)")).cast("decimal(26,0)").alias("row_ord"),
    )


def _read_records(spark: SparkSession, files: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The same as ``_in_reading_order`` of files whose quoted fields hold line breaks."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    held = quoted.records(spark, files).filter(~F.col("head"))
    # Line ends inside fields stay as they are.
    fields = F.from_csv("record", schema, {**_FORMAT, "multiLine": "true"})
    piece = F.col("block").cast("decimal(15,0)") * F.lit(_ROWS).cast("decimal(12,0)")
    row_ord = (piece + F.col("at").cast("decimal(11,0)")).cast("decimal(26,0)")
    parsed = held.select("path", row_ord.alias("row_ord"), fields.alias("fields"))
    return parsed.select(*[blank_to_null(F.col("fields")[c]).alias(c) for c in columns], "path", "row_ord")


def _number_files(df: DataFrame, files: DataFrame) -> DataFrame:
    """Replace ``path`` by ``file_ord``, the place of the file by name among ``files``.

    A row of a file that was not there yet when the files were listed fails the read.
    """
    found = lookup_join(df, range_position(files, "path", "file_ord"), ["path"], "left")
    late = F.raise_error(F.concat(F.lit("file appeared while it was read: "), "path")).cast("long")
    return found.withColumn("file_ord", F.coalesce("file_ord", late)).drop("path")


def rename_cols(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Give drifted columns their present names; names that are absent change nothing.

    Fails if two columns would get one name, which would make either unreadable.
    """
    new = [names.get(c, c) for c in df.columns]
    if twice := sorted({c for c in new if new.count(c) > 1}):
        raise ValueError(f"two columns would be called {twice}")
    return df.withColumnsRenamed(dict(names))


def read_text_tables(
    spark: SparkSession, paths: str | Sequence[str], rename: Mapping[str, str] | None = None, line_breaks: bool | None = None
) -> DataFrame:
    """Delimited files whose headers may differ, as text columns in reading order.

    ``line_breaks`` says whether quoted fields hold any; if it is left open, one scan
    looks for them.

    Files are grouped by header and read group by group, because one read over mixed
    headers would put values under wrong names. Columns are then renamed and stacked
    by name, with ``file_ord`` and ``row_ord``.
    """
    parts = []
    broken = _broken(spark, paths, line_breaks)
    for columns, files in _headers(spark, paths):
        named = [unquote(p) for p in files]
        if broken:
            part = _read_records(spark, named, columns)
        else:
            part = _in_reading_order(_csv(spark).schema(", ".join(f"`{c}` string" for c in columns)).csv(named))
        parts.append(rename_cols(part, dict(rename or {})))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return _number_files(stacked, list_files(spark, paths))


def _broken(spark: SparkSession, paths: str | Sequence[str], line_breaks: bool | None) -> bool:
    roots = [paths] if isinstance(paths, str) else list(paths)
    return quoted.has_line_breaks(spark, roots) if line_breaks is None else line_breaks


def scan_trips(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: ColumnMap = ColumnMap(),
    city: str | None = None,
    line_breaks: bool | None = None,
) -> DataFrame:
    """Trip files of one city as text columns, with ``city`` and the reading order.

    The files of a city have one header; each task compares the header of its file
    with it and fails on another one, so any number of files is a single read.
    ``line_breaks`` says whether quoted fields hold any; if it is left open, one scan
    looks for them.
    """
    trips = _csv(spark).option("enforceSchema", False).csv(path)
    needed = {columns.start_time, columns.end_time, columns.distance, *columns.lats, *columns.lons}
    missing = needed - set(trips.columns)
    if missing:
        raise ValueError(f"trip file lacks the columns {sorted(missing)}")
    if _broken(spark, path, line_breaks):
        heads = {names for names, _ in _headers(spark, path)}
        if len(heads) > 1:
            raise ValueError(f"trip files of one city have different headers: {sorted(heads)}")
        rows = _read_records(spark, [path] if isinstance(path, str) else list(path), trips.columns)
    else:
        rows = _in_reading_order(trips)
    ordered = _number_files(rows, list_files(spark, path))
    return ordered if city is None else ordered.withColumn("city", F.lit(city))


def scan_trips_drift(
    spark: SparkSession,
    paths: str | Sequence[str],
    rename: Mapping[str, str] = STATION_RENAMES,
    line_breaks: bool | None = None,
) -> DataFrame:
    """Station-trip files whose column names changed over the years, under one schema."""
    return read_text_tables(spark, paths, rename, line_breaks)


def scan_stations(spark: SparkSession, paths: str | Sequence[str], line_breaks: bool | None = None) -> DataFrame:
    """Station files; their ``date`` column is called ``time`` from here on."""
    return read_text_tables(spark, paths, {"date": "time"}, line_breaks)


def scan_demand(spark: SparkSession, path: str, city: str | None = None) -> DataFrame:
    """The stored hourly demand set; a city reads only its own folder."""
    demand = spark.read.parquet(path)
    return demand if city is None else demand.where(F.col("city") == city)
