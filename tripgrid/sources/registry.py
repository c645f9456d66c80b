"""Numbers that stay: an append-only dictionary of members and their ids, in versions.

A member that was numbered once keeps its id for good. Each run numbers the members that
no version before it holds, from the next free id of their set on, in the given order,
and writes them as a version of its own; the marker that Spark's writer leaves when it is
done makes the version count. A run that was stopped leaves nothing that is read, and its
version is written anew by the next one. Versions are never rewritten, so readers of an
older one always find what they found before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripgrid.operators.cleaning import CITY
from tripgrid.operators.lookup import attach, lookup_join
from tripgrid.operators.ranking import dense_position
from tripgrid.session import path_exists, stage


def _path(path: str, version: int) -> str:
    return f"{path}/version-{version:06}"


def last_version(spark: SparkSession, path: str) -> int:
    """The number of whole versions under ``path``."""
    version = 0
    while path_exists(spark, f"{_path(path, version)}/_SUCCESS"):
        version += 1
    return version


def read_ids(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Members and ids of the first ``version`` versions (all, if None), with the ``version`` that brought each."""
    count = last_version(spark, path) if version is None else version
    if not count:
        raise ValueError(f"no ids are kept under {path}")
    return spark.read.parquet(*[_path(path, v) for v in range(count)])


def extend_ids(
    found: DataFrame, path: str, members: Sequence[str], order: str, out: str, keys: Sequence[str] = CITY, **rank
) -> DataFrame:
    """Number the members of ``found`` that are new, and return the ids of all.

    ``found`` has one row for each member of a set, with ``order`` to number new ones by;
    it need not hold members of earlier runs again.
    """
    spark, place = found.sparkSession, [*keys, *members]
    version = last_version(spark, path)
    fresh = found.select(*dict.fromkeys([*place, order]))
    if version:
        known = stage(read_ids(spark, path, version), "known")
        fresh = fresh.join(known.df.select(*place), place, "left_anti")
        taken = known.df.groupBy(*keys).agg((F.max(out) + 1).alias("__next"))
        numbered = dense_position(fresh, order, out, keys, **rank)
        # A set may be new, so its first id may have none before it.
        shifted = lookup_join(numbered, taken, list(keys), "left") if keys else attach(numbered, taken)
        numbered = shifted.withColumn(out, F.col(out) + F.coalesce("__next", F.lit(0)))
    else:
        numbered = dense_position(fresh, order, out, keys, **rank)
    new = numbered.select(*place, out, F.lit(version).alias("version"))
    new.write.mode("overwrite").parquet(_path(path, version))
    return read_ids(spark, path, version + 1)
