"""Row filters that turn a raw trip table into a clean one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripgrid.config import COORD_Z_LIMIT, ColumnMap
from tripgrid.functions.dates import is_valid_ts, join_date_time, parse_ts_by, split_date
from tripgrid.functions.numbers import blank_to_null, to_double, zscore
from tripgrid.operators.lookup import attach

CITY = ("city",)


def repair_dates(df: DataFrame, columns: ColumnMap) -> DataFrame:
    """Complete the time text from its date column where the file keeps them apart."""
    pairs = ((columns.start_date, columns.start_time), (columns.end_date, columns.end_time))
    whole = {
        time: join_date_time(split_date(F.col(date)), F.col(time)) for date, time in pairs if date is not None
    }
    return df.withColumns(whole).drop(*[d for d, _ in pairs if d is not None]) if whole else df


def cast_coords(df: DataFrame, columns: ColumnMap = ColumnMap()) -> DataFrame:
    """Coordinates and distance as numbers; bad text becomes null."""
    texts = dict(df.dtypes)
    names = [*columns.lats, *columns.lons, columns.distance]
    return df.withColumns(
        {n: to_double(blank_to_null(F.col(n)) if texts[n] == "string" else F.col(n)) for n in names if n in texts}
    )


def parse_times(df: DataFrame, formats: dict[str, str], columns: ColumnMap = ColumnMap(), key: str = "city") -> DataFrame:
    """Replace both time texts by timestamps, by the format of each set."""
    return df.withColumns(
        {c: parse_ts_by(F.col(c), F.col(key), formats) for c in (columns.start_time, columns.end_time)}
    )


def drop_zero_distance(df: DataFrame, columns: ColumnMap = ColumnMap()) -> DataFrame:
    """Drop trips of length zero, given as a number or as text.

    A missing length is left to ``drop_nulls``; text that is no number is kept.
    """
    d = F.col(columns.distance)
    if dict(df.dtypes)[columns.distance] == "string":
        d = d.try_cast("double")
    return df.where(d.isNull() | (d != 0))


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null or NaN in any column (of ``subset``).

    One condition per column, because those reach the file scan.
    """
    types = dict(df.dtypes)
    for c in subset or df.columns:
        df = df.where(F.col(c).isNotNull())
        if types[c] in ("double", "float"):
            df = df.where(~F.isnan(c))
    return df


def computed_once(df: DataFrame) -> DataFrame:
    """Keep later filters above the columns of ``df``.

    A filter on a parsed column is otherwise moved below the parsing with a copy of
    the expression, and every row is parsed twice.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def valid_ts_filter(df: DataFrame, column: str, fmt: str) -> DataFrame:
    return df.where(is_valid_ts(F.col(column), fmt))


def pooled_stats(df: DataFrame, pair: tuple[str, str], keys: Sequence[str] = CITY) -> DataFrame:
    """``mean`` and population ``std`` of two columns taken as one.

    Each column is summarised on its own and the two summaries are merged, so no row
    is duplicated to stack the columns.
    """
    a, b = pair
    parts = df.groupBy(*keys).agg(
        F.count(a).alias("na"), F.avg(a).alias("ma"), F.var_pop(a).alias("va"),
        F.count(b).alias("nb"), F.avg(b).alias("mb"), F.var_pop(b).alias("vb"),
    )
    n = F.col("na") + F.col("nb")

    def share(x: Column, y: Column) -> Column:
        return F.try_divide(
            F.col("na") * F.coalesce(x, F.lit(0.0)) + F.col("nb") * F.coalesce(y, F.lit(0.0)), n
        )

    mean = share(F.col("ma"), F.col("mb"))
    within = share(F.col("va"), F.col("vb"))
    between = share(F.pow(F.col("ma") - mean, F.lit(2)), F.pow(F.col("mb") - mean, F.lit(2)))
    return parts.select(*keys, mean.alias("mean"), F.sqrt(within + between).alias("std"))


def zscore_pair_filter(
    df: DataFrame, pair: tuple[str, str], keys: Sequence[str] = CITY, z: float = COORD_Z_LIMIT
) -> DataFrame:
    """Keep rows where both columns of the pair lie within ``z`` pooled deviations.

    A set without any spread has no z-scores and keeps no rows.
    """
    scored = attach(df, pooled_stats(df, pair, keys), keys)
    near = [F.abs(zscore(F.col(c), F.col("mean"), F.col("std"))) < z for c in pair]
    return scored.where(near[0] & near[1]).drop("mean", "std")


def zscore_filter(
    df: DataFrame, keys: Sequence[str] = CITY, columns: ColumnMap = ColumnMap(), z: float = COORD_Z_LIMIT
) -> DataFrame:
    """Longitudes first; the latitude statistics then come from the survivors."""
    near_lon = zscore_pair_filter(df, columns.lons, keys, z)
    return zscore_pair_filter(near_lon, columns.lats, keys, z)


def clean_trips(
    df: DataFrame, keys: Sequence[str] = CITY, columns: ColumnMap = ColumnMap(), z: float = COORD_Z_LIMIT
) -> DataFrame:
    return zscore_filter(drop_nulls(drop_zero_distance(df, columns)), keys, columns, z)


def project_needed(df: DataFrame, keys: Sequence[str] = CITY, columns: ColumnMap = ColumnMap()) -> DataFrame:
    """The six columns the demand pipeline works on, beside the set keys."""
    return df.select(*keys, columns.start_time, columns.end_time, *columns.lats, *columns.lons)
