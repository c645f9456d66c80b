"""All tables of a job made visible at once.

A job writes its tables into a folder of its own under ``versions`` and then adds one
small manifest, which names the folder of each city. Readers take the newest manifest,
so of every city they see all tables of one job or all tables of the job before, never a
mixture; a job that is stopped before its manifest leaves readers where they were. Cities
that a job does not touch stay in the folders they are in. A manifest is written aside
and moved to the next number, which only one of several jobs can take.

Folders that no kept manifest names go with ``prune``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripgrid.session import list_names, move, path_exists, read_small, remove, write_small


def manifests(spark: SparkSession, root: str) -> list[str]:
    """Names of all manifests, the newest last."""
    return sorted(n for n in list_names(spark, f"{root}/manifests") if n.endswith(".json"))


def folders(spark: SparkSession, root: str, manifest: str | None = None) -> dict[str, str]:
    """The folder of each city, as the newest manifest has it."""
    names = [manifest] if manifest else manifests(spark, root)[-1:]
    return json.loads(read_small(spark, f"{root}/manifests/{names[0]}")) if names else {}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of all cities; also of a root that was written without publications."""
    held = folders(spark, root)
    if not held:
        return spark.read.parquet(f"{root}/{name}")
    cities: dict[str, list[str]] = {}
    for city, folder in sorted(held.items()):
        cities.setdefault(folder, []).append(city)
    parts = [spark.read.parquet(f"{root}/{folder}/{name}").where(F.col("city").isin(own)) for folder, own in cities.items()]
    return reduce(DataFrame.unionByName, parts)


@contextmanager
def publication(spark: SparkSession, root: str, cities: Sequence[str]) -> Iterator[str]:
    """A folder for the tables of ``cities``, which are published when the block ends without an error."""
    folder = f"versions/{uuid.uuid4().hex}"
    before = manifests(spark, root)
    held = folders(spark, root, before[-1]) if before else {}
    yield f"{root}/{folder}"
    number = int(before[-1].split(".")[0]) + 1 if before else 0
    aside = f"{root}/manifests/.{uuid.uuid4().hex}"
    write_small(spark, aside, json.dumps({**held, **dict.fromkeys(cities, folder)}))
    if not move(spark, aside, f"{root}/manifests/{number:09}.json"):
        remove(spark, aside)
        raise RuntimeError(f"another job published under {root} at the same time")


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove all manifests but the newest ``keep``, and the folders that only removed ones name."""
    names = manifests(spark, root)
    kept = {f for n in names[-keep:] for f in folders(spark, root, n).values()}
    for name in names[:-keep]:
        for folder in set(folders(spark, root, name).values()) - kept:
            if path_exists(spark, f"{root}/{folder}"):
                remove(spark, f"{root}/{folder}")
        remove(spark, f"{root}/manifests/{name}")
