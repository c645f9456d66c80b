"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space; every other character belongs to a word.
SPACES = r"[\x20\x09-\x0D]+"
# A key with at least this share of the rows is hot, so there are at most 1,000 hot keys.
HOT_SHARE = 1e-3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores added until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` loops over it."""
    return F.transform(F.array(value), body)[0]


def whole(text: str) -> Column:
    """The text column, with null read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def hot_keys(left: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """The keys with at least ``share`` of the rows, so at most 1 / share of them."""
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = max(left.count(), 1)
    return [r[0] for r in counts.filter(F.col("n") >= F.lit(max(total * share, 2.0))).select(key).collect()]


def uneven_join(left: DataFrame, right: DataFrame, key: str, share: float = HOT_SHARE, hot: list | None = None) -> DataFrame:
    """Left join to ``right``, which has one row per key, whatever the rows per key of ``left``.

    Keys with at least ``share`` of the left rows (so at most 1 / share keys, read to
    the driver, or given as ``hot``) meet their right rows by a broadcast of that many
    rows; all others are shuffled, and none of them can fill a task.
    """
    hot = hot_keys(left, key, share) if hot is None else hot
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = right.filter(F.col(key).isin(hot))
    return (
        left.filter(is_hot)
        .join(F.broadcast(few), key, "left")
        .unionByName(left.filter(~is_hot).join(right.filter(~is_hot), key, "left"))
    )
