"""Training and test parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripgrid.config import CHRONO_SHARE, RANDOM_SHARE
from tripgrid.operators.cleaning import CITY
from tripgrid.operators.lookup import attach, lookup_join
from tripgrid.session import Staged, stage

_DRAWS = 1_000_000


def split_chrono(
    df: DataFrame,
    span: DataFrame | Staged,
    keys: Sequence[str] = CITY,
    share: float = CHRONO_SHARE,
    drop_last: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """First ``int(share * n)`` hours of each set, and the rest up to the last hour.

    Windows are cut after this, so none of them crosses the boundary.
    """
    held = span if isinstance(span, Staged) else stage(span, "span")
    n = F.col("last_hour") - F.col("first_hour") + (0 if drop_last else 1)
    cuts = held.df.select(*keys, n.alias("__n"), F.floor(F.lit(share) * n).alias("__cut"))
    marked = attach(df, Staged(cuts, held.rows, held.path), keys)
    first = marked.where(F.col("hour") < F.col("__cut"))
    rest = marked.where((F.col("hour") >= F.col("__cut")) & (F.col("hour") < F.col("__n")))
    return first.drop("__n", "__cut"), rest.drop("__n", "__cut")


def split_random(
    df: DataFrame, record: Sequence[str], share: float = RANDOM_SHARE, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Bernoulli split of the records named by ``record``.

    The draw is the MD5 of the printed record and the seed: a task that runs again, or
    another number of partitions, gives the same split, and so does any other engine.
    """
    printed = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in record], F.lit(str(seed)))
    draw = F.conv(F.substring(F.md5(printed), 1, 8), 16, 10).cast("long") % _DRAWS
    kept = draw < round(share * _DRAWS)
    return df.where(kept), df.where(~kept)


def reindex_hours(demand: DataFrame, hours: DataFrame, keys: Sequence[str] = CITY) -> tuple[DataFrame, DataFrame]:
    """Close the holes of a random split: hours become positions 0..m-1 of the part.

    ``hours`` lists the hours of the part, empty ones included. Returns the demand of
    those hours and its span.
    """
    ordered = Window.partitionBy(*keys).orderBy("hour")
    held = stage(hours.select(*keys, "hour", (F.row_number().over(ordered) - 1).cast("long").alias("pos")), "hours")
    moved = lookup_join(demand, held, [*keys, "hour"]).drop("hour").withColumnRenamed("pos", "hour")
    zero = F.lit(0).cast("long")
    span = held.df.groupBy(*keys).agg(F.min(zero).alias("first_hour"), F.max("pos").alias("last_hour"))
    return moved, span


def pos_modulo(pos, count):
    """Sample position wrapped into 0..count-1."""
    return F.pmod(pos, count)
