"""Station tables and station-to-station (OD) counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripgrid.config import OD_ORIGIN
from tripgrid.functions.dates import hour_tag_origin, origin_seconds, parse_ts_multi, tag_to_ts
from tripgrid.functions.order import reading_order
from tripgrid.operators.lookup import lookup_join
from tripgrid.operators.ranking import dense_position
from tripgrid.session import Staged, stage

STATION_COLUMNS = ("lat", "lon", "datetime")


def station_id(printed: Column) -> Column:
    """A station id as an integer; a column with blanks is often printed as ``3005.0``."""
    whole = printed.try_cast("double")
    return F.coalesce(printed.try_cast("int"), F.when(whole == F.floor(whole), whole.try_cast("int")))


def station_first(sightings: DataFrame, columns: Sequence[str] = STATION_COLUMNS, rank: str = "src") -> DataFrame:
    """Per ``id`` and column, the first value that is not null, by (``rank``, ``ord``).

    ``src`` ranks the kinds of files: the lowest one that has a value wins. Within a
    kind, ``ord`` decides. Every column is a number or a timestamp, so the aggregation
    hashes and combines before the shuffle: a station that starts a third of all trips
    is one row per task by then. Rows without an id are not stations.
    """
    per_src = sightings.where(F.col("id").isNotNull()).groupBy("id", rank)
    firsts = per_src.agg(
        *[F.min_by(c, F.when(F.col(f"has_{c}"), F.col("ord"))).alias(c) for c in columns],
        *[F.max(f"has_{c}").alias(f"has_{c}") for c in columns],
    )
    return firsts.groupBy("id").agg(
        *[F.min_by(c, F.when(F.col(f"has_{c}"), F.col(rank))).alias(c) for c in columns]
    )


def _sightings(df: DataFrame, src: int, order: Column) -> DataFrame:
    """``id, src, ord`` and each station column with a flag for "the file had a value".

    A time text that cannot be read still counts as a value: it wins and is null.
    """
    return df.select(
        station_id(F.col("id")).alias("id"),
        F.lit(src).alias("src"),
        order.alias("ord"),
        F.col("lat").cast("double").alias("lat"),
        F.col("lon").cast("double").alias("lon"),
        parse_ts_multi(F.col("time")).alias("datetime"),
        F.col("lat").isNotNull().alias("has_lat"),
        F.col("lon").isNotNull().alias("has_lon"),
        F.col("time").isNotNull().alias("has_datetime"),
    )


def station_file_sightings(stations: DataFrame) -> DataFrame:
    """Station-file rows: ``id, lat, lon, time`` and their order ``file_ord, row_ord``."""
    order = reading_order(F.col("file_ord"), F.col("row_ord"))
    for missing in {"lat", "lon"} - set(stations.columns):
        stations = stations.withColumn(missing, F.lit(None).cast("double"))
    return _sightings(stations, 0, order)


def trip_sightings(trips: DataFrame) -> DataFrame:
    """Stations as seen by the trips: of each file, all starts and then all ends."""
    ends = F.array(
        *[
            F.struct(
                F.lit(flag).alias("is_end"),
                F.col(f"{end}_station").alias("id"),
                F.col(f"{end}_lat").alias("lat"),
                F.col(f"{end}_lon").alias("lon"),
                F.col(f"{end}_time").alias("time"),
            )
            for flag, end in enumerate(("start", "end"))
        ]
    )
    tall = trips.select("file_ord", "row_ord", F.inline(ends))
    return _sightings(tall, 1, reading_order(F.col("file_ord"), F.col("row_ord"), F.col("is_end")))


def stations_from_trips(trips: DataFrame) -> DataFrame:
    return station_first(trip_sightings(trips))


def union_stations(stations: DataFrame, trips: DataFrame) -> DataFrame:
    return station_file_sightings(stations).unionByName(trip_sightings(trips))


def station_index(stations: DataFrame, **rank) -> DataFrame:
    """``tidx``: position of the station by id."""
    return dense_position(stations, "id", "tidx", **rank)


def station_table(stations: DataFrame, trips: DataFrame) -> DataFrame:
    """``id, lat, lon, datetime, tidx``; station files win over what trips say."""
    return station_index(station_first(union_stations(stations, trips)))


UNREAD = ("start_time", "start_station", "end_station")


def tag_trips(trips: DataFrame, origin: str = OD_ORIGIN) -> DataFrame:
    """The columns OD counting needs: ``hour, start_station, end_station``.

    What cannot be read is null there, and its text is kept as ``..._text``.
    """
    read = trips.select(
        hour_tag_origin(parse_ts_multi(F.col("start_time")), origin).alias("hour"),
        station_id(F.col("start_station")).alias("start_station"),
        station_id(F.col("end_station")).alias("end_station"),
        *[F.col(c).cast("string").alias(f"{c}_text") for c in UNREAD],
    )
    known = dict(zip(UNREAD, ("hour", "start_station", "end_station")))
    return read.withColumns({f"{c}_text": F.when(F.col(k).isNull(), F.col(f"{c}_text")) for c, k in known.items()})


def od_station_counts(tagged: DataFrame) -> DataFrame:
    """Trips per hour and station pair, before any lookup; texts that were not read stay apart."""
    texts = [f"{c}_text" for c in UNREAD]
    return tagged.groupBy("hour", "start_station", "end_station", *texts).agg(F.count(F.lit(1)).alias("trips"))


def station_lookup(counts: DataFrame, stations: DataFrame | Staged, **join) -> tuple[DataFrame, DataFrame]:
    """Replace both station ids by their index.

    Returns the matched rows, and the rows that cannot be placed with their ``reason``:
    no readable start ``time``, or an unknown ``station``.
    """
    held = stations if isinstance(stations, Staged) else stage(stations, "stations")

    def index_of(end: str, idx: str) -> Staged:
        named = held.df.select(F.col("id").alias(f"{end}_station"), F.col("tidx").alias(idx))
        return Staged(named, held.rows, held.path)

    both = lookup_join(counts, index_of("start", "o_idx"), ["start_station"], "left", **join)
    both = lookup_join(both, index_of("end", "d_idx"), ["end_station"], "left", **join)
    known = F.col("hour").isNotNull() & F.col("o_idx").isNotNull() & F.col("d_idx").isNotNull()
    found = both.where(known).drop("start_station", "end_station", *[f"{c}_text" for c in UNREAD])
    reason = F.when(F.col("hour").isNull(), "time").otherwise("station").alias("reason")
    return found, both.where(~known).drop("o_idx", "d_idx").select("*", reason)


def _with_date(df: DataFrame, origin: str) -> DataFrame:
    return df.withColumn("dat", tag_to_ts(F.col("hour"), offset_s=origin_seconds(origin)))


def od_matrix(
    trips: DataFrame, stations: DataFrame | Staged, origin: str = OD_ORIGIN, **join
) -> tuple[DataFrame, DataFrame]:
    """``hour, dat, o_idx, d_idx, trips`` and the rejected rows.

    Trips are counted per station pair first, so the lookups see one row per hour and
    pair instead of one per trip.
    """
    found, rejects = station_lookup(od_station_counts(tag_trips(trips, origin)), stations, **join)
    return _with_date(found, origin).select("hour", "dat", "o_idx", "d_idx", "trips"), rejects


def od_hour_count(od: DataFrame) -> DataFrame:
    """Trips per hour: ``hour, dat, cnt``."""
    return od.groupBy("hour", "dat").agg(F.sum("trips").alias("cnt"))


def od_max(od: DataFrame) -> DataFrame:
    return od.agg(F.max("trips").alias("max_trips"))


def fill_od_hours(od_hours: DataFrame, origin: str = OD_ORIGIN) -> DataFrame:
    """Every hour from the origin to the last one; hours without trips count 0.

    When trips lie before the origin, the list starts at the first of them.
    """
    held = stage(od_hours, "odhours")
    span = held.df.agg(F.least(F.min("hour"), F.lit(0).cast("long")).alias("lo"), F.max("hour").alias("hi"))
    hours = F.when(F.col("hi") >= F.col("lo"), F.sequence("lo", "hi"))
    calendar = _with_date(span.select(F.explode(hours).alias("hour")), origin)
    return (
        calendar.join(held.df.select("hour", "cnt"), "hour", "left")
        .select("hour", "dat", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))
    )


def trips_before_origin(od_hours: DataFrame) -> DataFrame:
    """How many trips carry a negative hour number."""
    early = F.when(F.col("hour") < 0, F.col("cnt")).otherwise(0)
    return od_hours.agg(F.coalesce(F.sum(early), F.lit(0)).cast("long").alias("trips_before_origin"))
