"""Dense hourly series per cell and channel, and the windows cut from them.

A series is one row: its length is the number of hours in the calendar, whatever the
number of trips. Only cells that ever saw a trip have one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripgrid.config import HORIZON_HOURS, WINDOW_HOURS
from tripgrid.functions.dates import tag_to_ts
from tripgrid.functions.encoding import time_features
from tripgrid.operators.cleaning import CITY
from tripgrid.operators.lookup import attach
from tripgrid.session import Staged, stage

# Windows cut per intermediate row; bounds the memory of one step, not the result.
BLOCK = 256
# Series handled by one task of window cutting, fitting or forecasting.
SERIES_PER_TASK = 500


def dense_series(
    demand: DataFrame, span: DataFrame | Staged, keys: Sequence[str] = CITY, drop_last: bool = True
) -> DataFrame:
    """``x, y, channel, first_hour, series``: counts for hours 0..n-1, zeros included.

    Counts of hours outside these are left out.

    Each stored count brings the zeros since the previous one along as an array, so
    the zeros never exist as rows. The window and the grouping share one shuffle.
    """
    held = span if isinstance(span, Staged) else stage(span, "span")
    bounds = Staged(held.df.select(*keys, "first_hour", "last_hour"), held.rows, held.path)
    size = F.col("last_hour") - F.col("first_hour") + (0 if drop_last else 1)
    cell = [*keys, "x", "y", "channel"]
    ordered = Window.partitionBy(*cell).orderBy("hour")
    before = F.greatest(F.coalesce(F.lag("hour").over(ordered), F.lit(-1)), F.lit(-1))
    zero = F.lit(0).cast("long")
    # Counts outside the calendar keep their cell but have no place in its series.
    inside = (F.col("hour") >= 0) & (F.col("hour") < size)
    zeros = F.array_repeat(zero, (F.col("hour") - F.col("__before") - 1).cast("int"))
    piece = F.when(inside, F.concat(zeros, F.array("cnt"))).otherwise(F.array().cast("array<bigint>"))
    pieces = attach(demand, bounds, keys).withColumn("__before", before).withColumn("piece", piece)
    joined = pieces.groupBy(*cell).agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("hour", "piece")))["piece"]).alias("seen"),
        F.first("first_hour").alias("first_hour"),
        F.first(size).alias("n"),
    )
    tail = F.greatest(F.col("n") - F.size("seen"), F.lit(0)).cast("int")
    whole = F.slice(F.concat("seen", F.array_repeat(zero, tail)), F.lit(1), F.col("n").cast("int"))
    return joined.where(F.col("n") > 0).select(*cell, "first_hour", whole.alias("series"))


def stage_series(
    demand: DataFrame,
    span: DataFrame | Staged,
    keys: Sequence[str] = CITY,
    drop_last: bool = True,
    per_task: int = SERIES_PER_TASK,
) -> DataFrame:
    """The dense series as a stored table, spread for what is made from it.

    Mostly-zero series are tiny on disk, and windows multiply them by the window
    length, so file sizes say nothing about the work behind a row. Tasks are sized by
    the number of series instead.
    """
    held = stage(dense_series(demand, span, keys, drop_last), "series")
    tasks = max(held.df.sparkSession.sparkContext.defaultParallelism, -(-held.rows // per_task))
    return held.df.repartition(tasks, *keys, "x", "y", "channel")


def split_series(series: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """First ``int(share * n)`` hours and the rest, each as a series of its own."""
    n = F.size("series")
    cut = F.floor(F.lit(share) * n).cast("int")
    head = series.withColumn("series", F.slice("series", F.lit(1), cut))
    tail = series.withColumns(
        {"series": F.slice("series", cut + 1, n - cut), "first_hour": F.col("first_hour") + cut}
    )
    return head, tail


def sliding_windows(
    series: DataFrame,
    w: int = WINDOW_HOURS,
    f: int = HORIZON_HOURS,
    gap: int = 0,
    all_windows: bool = False,
    value: str = "series",
    block: int = BLOCK,
) -> DataFrame:
    """``idx, features, labels`` in place of the series column.

    Sample ``i`` has ``features`` [i, i+w) and ``labels`` [i+w+gap, i+w+gap+f). There
    are n-w-f samples; ``all_windows`` also gives the last ones that still fit. A
    series shorter than ``w`` is an error.
    """
    checked = _window_count(value, w, f, gap, all_windows)
    rest = [c for c in series.columns if c != value]
    at = F.col("__at") + 1
    return _positions(series, checked, w + gap + f, value, block).select(
        *rest,
        F.col("idx"),
        F.slice("__part", at, w).alias("features"),
        F.slice("__part", at + (w + gap), f).alias("labels"),
    )


def _window_count(value: str, w: int, f: int, gap: int, all_windows: bool) -> Column:
    n = F.size(value)
    count = n - w - f - gap + 1 if all_windows else n - w - f
    return F.when(n < w, F.raise_error(F.lit("window is longer than the series"))).otherwise(count)


def window_index(
    series: DataFrame,
    w: int = WINDOW_HOURS,
    f: int = HORIZON_HOURS,
    gap: int = 0,
    all_windows: bool = False,
    value: str = "series",
    block: int = BLOCK,
) -> DataFrame:
    """The same samples by reference: ``from, len, part`` in place of the series column.

    A row stands for the ``len`` samples from ``from`` on; sample ``from + k`` has
    ``features`` and ``labels`` at ``k`` and ``k + w + gap`` in ``part``. A value is kept
    about twice, whatever ``w`` and ``f`` are, and not once for each window over it.
    """
    rest = [c for c in series.columns if c != value]
    pieces = _pieces(series, _window_count(value, w, f, gap, all_windows), w + gap + f, value, max(block, w + gap + f))
    names = {"__from": "from", "__len": "len", "__part": "part"}
    return pieces.select(*rest, *[F.col(c).alias(n) for c, n in names.items()])


def _pieces(series: DataFrame, count: Column, reach: int, value: str, block: int) -> DataFrame:
    """Pieces ``__part`` of the series with the ``__len`` positions from ``__from`` on, and ``reach`` values behind."""
    rest = [c for c in series.columns if c != value]
    starts = F.when(F.col("__count") > 0, F.sequence(F.lit(0), F.col("__count") - 1, F.lit(block)))
    return (
        series.withColumn("__count", count)
        .select(*rest, value, "__count", F.explode(starts).alias("__from"))
        .select(
            *rest,
            "__from",
            F.least(F.lit(block), F.col("__count") - F.col("__from")).alias("__len"),
            F.slice(value, F.col("__from") + 1, block + reach).alias("__part"),
        )
    )


def _positions(series: DataFrame, count: Column, reach: int, value: str, block: int) -> DataFrame:
    """One row per ``idx`` below ``count``, with a piece ``__part`` of the series.

    The values from ``idx`` on are at ``__at`` and after in the piece, ``reach`` of
    them at least. Pieces cover ``block`` positions, so a row carries a short array
    around and never the whole series.
    """
    rest = [c for c in series.columns if c != value]
    pieces = _pieces(series, count, reach, value, block)
    each = pieces.select(*rest, "__from", "__part", F.explode(F.sequence(F.lit(0), F.col("__len") - 1)).alias("__at"))
    return each.withColumn("idx", (F.col("__from") + F.col("__at")).cast("long"))


def sliding_windows_gap(series: DataFrame, w: int, f: int, **how) -> DataFrame:
    """The older cut: labels start one hour later."""
    return sliding_windows(series, w, f, gap=1, **how)


def sample_hours(calendar: DataFrame, w: int, f: int, keys: Sequence[str] = CITY) -> DataFrame:
    """``idx, hours``: the ``w + f`` hour starts of each whole-grid sample."""
    listed = calendar.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("hour", "t0")))["t0"].alias("series")
    )
    cut = sliding_windows(listed, w, f)
    return cut.select(*keys, "idx", F.concat("features", "labels").alias("hours"))


def sample_time_features(hours: DataFrame) -> DataFrame:
    """``time_features``: twenty numbers for each hour of a sample.

    They are the same for every cell, so they are kept per sample and not repeated
    on the cell rows.
    """
    return hours.withColumn("time_features", F.transform("hours", time_features)).drop("hours")


def dense_grid(
    placed: DataFrame, dims: DataFrame | Staged, keys: Sequence[str] = CITY, calendar: DataFrame | None = None
) -> DataFrame:
    """``hour, grid``: one flat array per hour ordered by channel, ``x_idx``, ``y_idx``.

    ``placed`` has the matrix position of each cell and ``dims`` the matrix size. Built
    by position like a series: a hot hour costs its own matrix and no more. With a
    ``calendar`` of hours there is a grid for each of them, of zeros if it saw no trips,
    and for no other hour.
    """
    held = dims if isinstance(dims, Staged) else stage(dims, "dims")
    sized = attach(placed, held, keys)
    place = ((F.col("channel") * F.col("nx") + F.col("x_idx")) * F.col("ny") + F.col("y_idx")).cast("long")
    sized = sized.withColumn("place", place)
    ordered = Window.partitionBy(*keys, "hour").orderBy("place")
    gap = F.col("place") - F.coalesce(F.lag("place").over(ordered), F.lit(-1)) - 1
    zero = F.lit(0).cast("long")
    size = (2 * F.col("nx") * F.col("ny")).cast("int")
    pieces = sized.withColumn("piece", F.concat(F.array_repeat(zero, gap.cast("int")), F.array("cnt")))
    seen = pieces.groupBy(*keys, "hour").agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("place", "piece")))["piece"]).alias("seen"),
        F.first(size).alias("size"),
    )
    tail = F.array_repeat(zero, F.col("size") - F.size("seen"))
    grids = seen.select(*keys, "hour", F.concat("seen", tail).alias("grid"))
    if calendar is None:
        return grids
    empty = attach(calendar.select(*keys, "hour"), held, keys)
    whole = empty.select(*keys, "hour", size.alias("size")).join(grids, [*keys, "hour"], "left")
    return whole.select(*keys, "hour", F.coalesce("grid", F.array_repeat(zero, F.col("size"))).alias("grid"))


def _back(here: Column, lags: Sequence[int]) -> Column:
    """The values ``lags`` positions before ``here``; a run 1..n is one slice."""
    n = len(lags)
    if list(lags) == list(range(1, n + 1)):
        return F.reverse(F.slice("__part", here - n + 1, n))
    return F.array(*[F.get("__part", here - k) for k in lags])


def lag_features(series: DataFrame, lags: Sequence[int], block: int = BLOCK) -> DataFrame:
    """``hour, lags, time_features, label``: one row per hour that has all its lags.

    ``lags[j]`` is the count ``lags[j]`` hours earlier. Counts are doubles here, cast
    once per series and not once per use.
    """
    depth = max(lags)
    short = F.raise_error(F.lit("longest lag is longer than the series"))
    count = F.when(F.size("series") < depth, short).otherwise(F.size("series") - depth)
    rest = [c for c in series.columns if c != "series"]
    here = F.col("__at") + depth
    hour = F.col("idx") + depth
    doubles = series.withColumn("series", F.col("series").cast("array<double>"))
    return _positions(doubles, count, depth + 1, "series", block).select(
        *rest,
        hour.alias("hour"),
        _back(here, lags).alias("lags"),
        time_features(tag_to_ts(F.col("first_hour") + hour)).alias("time_features"),
        F.get("__part", here).alias("label"),
    )
