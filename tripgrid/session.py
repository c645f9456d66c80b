"""Session helpers: the time zone, the shared folder, and staged small tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def pin_utc(spark: SparkSession) -> SparkSession:
    """Hours are UTC hours; a session in another zone would shift every bucket."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, as named by the cluster.

    Only a local session, where the driver is also the executor, may fall back to a
    folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    return _own_dir(spark.sparkContext.applicationId)


@lru_cache(maxsize=None)
def _own_dir(application: str) -> str:
    path = tempfile.mkdtemp(prefix=f"tripgrid-{application}-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


_session_dirs: dict[str, str] = {}


def _session_dir(spark: SparkSession) -> str:
    """One folder per application for its staged tables, removed when its Python ends."""
    application = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/tripgrid-{application}"
    if _session_dirs.get(application) != root:
        _session_dirs[application] = root
        atexit.register(_remove_at_exit, spark, root)
    return root


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Also after the session was stopped: file systems outlive it, as long as the JVM does."""
    with suppress(Exception):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(hadoop, True)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop, files = _file_system(spark, path)
    return files.exists(hadoop)


_held: ContextVar[list[str] | None] = ContextVar("tripgrid_staged", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables staged inside the block when it ends, also after an error.

    For jobs that leave their results elsewhere: staged trips can be as large as the
    input.
    """
    paths: list[str] = []
    token = _held.set(paths)
    try:
        yield
    finally:
        _held.reset(token)
        for path in paths:
            remove(spark, path)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders under ``path``, none if it does not exist."""
    hadoop, files = _file_system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(hadoop)] if files.exists(hadoop) else []


def write_small(spark: SparkSession, path: str, text: str) -> None:
    hadoop, files = _file_system(spark, path)
    out = files.create(hadoop, False)
    out.write(bytearray(text.encode()))
    out.close()


def read_small(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Move one file to a name that is not taken; whether that was possible."""
    hadoop, files = _file_system(spark, source)
    end = spark._jvm.org.apache.hadoop.fs.Path(target)
    return not files.exists(end) and files.rename(hadoop, end)


def remove(spark: SparkSession, path: str) -> None:
    hadoop, files = _file_system(spark, path)
    files.delete(hadoop, True)


# What a value of a column takes at most in a hash table, but for texts and arrays.
_VALUE_BYTES = 16


@dataclass(frozen=True)
class Staged:
    """A table written to the shared folder, with its exact row count and about its bytes.

    ``width`` is the mean size of a row as a hash table holds it.
    """

    df: DataFrame
    rows: int
    path: str
    width: float = 100.0

    @property
    def bytes(self) -> float:
        return self.rows * self.width


def _extra_bytes(df: DataFrame) -> Column:
    """Bytes of the texts and arrays of a row."""
    sizes = [F.lit(0).cast("long")]
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(F.col(f"`{f.name}`")).cast("long"), F.lit(0)))
        elif kind in ("array", "map"):
            sizes.append(F.greatest(F.size(F.col(f"`{f.name}`")), F.lit(0)).cast("long") * _VALUE_BYTES)
    return reduce(Column.__add__, sizes)


def own_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that goes when the session's Python ends."""
    return f"{_session_dir(spark)}/tripgrid-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "t") -> Staged:
    """Write ``df`` once and read it back.

    This cuts the lineage (a lost executor never repeats the scans behind it), keeps
    plans flat however many statistics are chained, and tells the caller the row
    count and width, which are found while writing and cost no extra job. The folder
    goes when the session's Python ends, or with the block of ``scratch`` around it.
    """
    spark = df.sparkSession
    path = own_path(spark, label)
    if (held := _held.get()) is not None:
        held.append(path)
    seen = Observation()
    found = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(_extra_bytes(df)).alias("extra"))
    found.write.parquet(path)
    rows = int(seen.get["rows"])
    width = _VALUE_BYTES * (len(df.columns) + 2) + (seen.get["extra"] or 0) / max(rows, 1)
    return Staged(spark.read.schema(df.schema).parquet(path), rows, path, width)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of one small file a task per core; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
