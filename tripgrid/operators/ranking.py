"""Dense positions 0, 1, 2, ... within each set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripgrid.operators.lookup import attach, lookup_join
from tripgrid.session import Staged, stage

# Largest table that one sorted window task may number by itself.
ONE_TASK_ROWS = 1_000_000
BANDS = 256


def dense_position(
    df: DataFrame | Staged,
    order: str,
    out: str,
    keys: Sequence[str] = (),
    one_task_rows: int = ONE_TASK_ROWS,
    bands: int = BANDS,
) -> DataFrame:
    """Number the rows of each set by ``order``, a numeric column without repeats.

    A counted small table is numbered with one window. A larger one is cut into bands
    of ``order`` at approximate quantiles, numbered inside each band, and shifted by
    the rows in the bands before it. The quantiles only decide how even the bands are;
    the numbers are exact either way.
    """
    held = df if isinstance(df, Staged) else stage(df, "rank")
    keys = list(keys)
    if held.rows <= one_task_rows:
        whole = Window.partitionBy(*keys).orderBy(order)
        return held.df.withColumn(out, F.row_number().over(whole).cast("long") - 1)

    cuts = [i / bands for i in range(1, bands)]
    edges = held.df.groupBy(*keys).agg(F.percentile_approx(order, cuts, 10_000).alias("__edges"))
    banded = (
        attach(held.df, edges, keys)
        .withColumn("__band", F.size(F.filter("__edges", lambda e: e < F.col(order))))
        .drop("__edges")
    )
    before = Window.partitionBy(*keys).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        banded.groupBy(*keys, "__band")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, "__band", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long").alias("__before"))
    )
    inside = Window.partitionBy(*keys, "__band").orderBy(order)
    return (
        lookup_join(banded, offsets, [*keys, "__band"])
        .withColumn(out, F.col("__before") + F.row_number().over(inside) - 1)
        .drop("__before", "__band")
    )


def range_position(df: DataFrame, order: str, out: str, parts: int | None = None) -> DataFrame:
    """Number all rows by ``order``, which may be text, without sorting them in one task.

    Rows are dealt to sorted ranges and written with their place inside; ranges are
    shifted by the counts of those before them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    inside = df.repartitionByRange(parts or cores, order).sortWithinPartitions(order)
    place = F.pmod(F.monotonically_increasing_id(), F.lit(2**33))
    held = stage(inside.withColumn("__part", F.spark_partition_id()).withColumn("__place", place), "range").df
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    shifts = shifts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = lookup_join(held, shifts, ["__part"])
    return placed.withColumn(out, F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")
