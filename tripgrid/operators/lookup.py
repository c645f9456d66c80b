"""Joins against tables that are expected, but not assumed, to be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripgrid.session import Staged, stage

# What a lookup table may weigh as a hash table on each executor, and its rows.
BROADCAST_BYTES = 50_000_000
BROADCAST_ROWS = 500_000
# Tasks over which one hot key is spread when the lookup is too big to broadcast.
SALTS = 32


def lookup_join(
    df: DataFrame,
    small: DataFrame | Staged,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``df`` to a lookup table without moving ``df`` when that is safe.

    The lookup is written, counted and weighed first. Up to ``max_rows`` and
    ``BROADCAST_BYTES`` it is broadcast. Above that, both sides are shuffled on the key and a salt: ``df`` rows of a hot key go
    to ``salts`` tasks, and each lookup row is repeated once per salt, so every row
    still meets its match exactly once.
    """
    held = small if isinstance(small, Staged) else stage(small, "lookup")
    on = list(on)
    if held.rows <= max_rows and held.bytes <= BROADCAST_BYTES:
        return df.join(F.broadcast(held.df), on, how)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    repeated = held.df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "__salt"], how).drop("__salt")


def attach(df: DataFrame, stats: DataFrame | Staged, keys: Sequence[str] = ()) -> DataFrame:
    """Put each set's statistics beside its rows.

    ``stats`` has one row per set, or exactly one row when there are no keys; that one
    row is then read as a scalar subquery.
    """
    held = stats if isinstance(stats, Staged) else stage(stats, "stats")
    if keys:
        return lookup_join(df, held, keys)
    row = held.df.select(F.struct(*held.df.columns).alias("row")).scalar()
    names = held.df.columns
    return df.withColumn("__stats", row).select(*df.columns, *[F.col("__stats")[n].alias(n) for n in names])
