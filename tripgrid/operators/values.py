"""Scaling of stored counts, and counts that are too large to be true."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripgrid.config import OUTLIER_SHARE
from tripgrid.functions.numbers import minmax
from tripgrid.operators.cleaning import CITY
from tripgrid.operators.demand import demand_max
from tripgrid.operators.lookup import attach, lookup_join
from tripgrid.session import Staged, stage


def normalize_demand(demand: DataFrame, keys: Sequence[str] = CITY, lo: int = 0) -> DataFrame:
    """Add ``scaled``: the count between ``lo`` and the largest count of the set."""
    scaled = minmax(F.col("cnt"), F.lit(lo), F.col("max_cnt"))
    return attach(demand, demand_max(demand, keys), keys).withColumn("scaled", scaled).drop("max_cnt")


def value_counts(demand: DataFrame, keys: Sequence[str] = CITY) -> DataFrame:
    """How many cells hold each count, and how many hold a smaller one.

    Counts that add up to all trips have few distinct values (the square root of
    twice their sum at most), so the running total is over a short table.
    """
    hist = demand.groupBy(*keys, "cnt").agg(F.count(F.lit(1)).alias("cells"))
    below = Window.partitionBy(*keys).orderBy("cnt").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    return hist.select(
        *keys,
        "cnt",
        "cells",
        F.coalesce(F.sum("cells").over(below), F.lit(0)).cast("long").alias("cells_below"),
        F.sum("cells").over(every).alias("n"),
    )


def _beyond(share: float):
    return F.col("cells_below") >= F.rint(F.lit(share) * F.col("n"))


def outlier_values(demand: DataFrame, keys: Sequence[str] = CITY, share: float = OUTLIER_SHARE) -> DataFrame:
    """Counts that only occur in the last ``1 - share`` of all stored cells by size."""
    return value_counts(demand, keys).where(_beyond(share)).select(*keys, "cnt")


def value_except(values: DataFrame, kept: DataFrame) -> DataFrame:
    """Distinct values that are not among ``kept``."""
    return values.subtract(kept)


def outlier_member(demand: DataFrame, outliers: DataFrame | Staged, keys: Sequence[str] = CITY, **join) -> DataFrame:
    """Demand rows whose count is an outlier value."""
    return lookup_join(demand, outliers, [*keys, "cnt"], "left_semi", **join)


def clip_outlier_cells(demand: DataFrame, keys: Sequence[str] = CITY, share: float = OUTLIER_SHARE) -> DataFrame:
    """Set outlier counts to 0.

    Outliers are all counts from some size up, so one threshold per set replaces the
    membership test.
    """
    bound = value_counts(demand, keys).groupBy(*keys).agg(F.min(F.when(_beyond(share), F.col("cnt"))).alias("__from"))
    high = F.col("__from").isNotNull() & (F.col("cnt") >= F.col("__from"))
    return (
        attach(demand, bound, keys)
        .withColumn("cnt", F.when(high, F.lit(0).cast("long")).otherwise(F.col("cnt")))
        .drop("__from")
    )
