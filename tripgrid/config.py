"""Job settings: column names, city presets and fixed constants."""

from __future__ import annotations

from dataclasses import dataclass, field

# Results only agree with earlier runs when these stay as they are.
EARTH_CIRCUMFERENCE_M = 40_000_000
CELL_M = 250
HOUR_S = 3600
HOUR_OFFSET_S = 0
OD_ORIGIN = "2016-07-07 04:00:00"
COORD_Z_LIMIT = 3.0
CELL_Z_MIN = -3.0
CELL_MIN_VISITS = 100
CHRONO_SHARE = 0.9
RANDOM_SHARE = 0.8
OUTLIER_SHARE = 0.9999
WINDOW_HOURS = 74
HORIZON_HOURS = 200
PLAIN_WINDOW_HOURS = 117
PLAIN_HORIZON_HOURS = 5
REPORT_SAMPLE = 20

# Text that a trip or station file uses for "no value".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Station columns that drifted between file generations.
STATION_RENAMES = {
    "start_station_id": "start_station",
    "end_station_id": "end_station",
}


@dataclass(frozen=True)
class ColumnMap:
    """Where a trip file keeps each field; ``start_date``/``end_date`` are optional."""

    trip_id: str = "trip_id"
    scooter_id: str = "scooter_id"
    start_time: str = "start_time_utc"
    end_time: str = "end_time_utc"
    start_lat: str = "start_lat"
    start_lon: str = "start_lon"
    end_lat: str = "end_lat"
    end_lon: str = "end_lon"
    distance: str = "distance_miles"
    start_date: str | None = None
    end_date: str | None = None

    @property
    def lats(self) -> tuple[str, str]:
        return self.start_lat, self.end_lat

    @property
    def lons(self) -> tuple[str, str]:
        return self.start_lon, self.end_lon


@dataclass(frozen=True)
class CityConfig:
    """One city of a job. ``time_format`` is written with ``%``-codes.

    ``max_iter`` is the number of training passes of ``solver="l-bfgs"``; ``trees``
    belong to the kind ``gbt``; ``hidden``, ``layers`` and ``passes`` to the recurrent
    kinds ``rnn``, ``gru`` and ``lstm``.
    """

    city: str
    time_format: str
    columns: ColumnMap = field(default_factory=ColumnMap)
    window: int = WINDOW_HOURS
    horizon: int = HORIZON_HOURS
    kind: str = "linear"
    max_iter: int = 115
    solver: str = "l-bfgs"
    trees: int = 20
    hidden: int = 32
    layers: int = 1
    passes: int = 10


# How each city's file prints its times.
INDIANAPOLIS = CityConfig("indianapolis", "%Y-%m-%dT%H:%M:%SZ")
KANSAS_CITY = CityConfig("kansas_city", "%m/%d/%YT%H:%M:%S")
LOUISVILLE = CityConfig("louisville", "%Y-%m-%dT%H:%M")

CITY_PRESETS = {c.city: c for c in (INDIANAPOLIS, KANSAS_CITY, LOUISVILLE)}
