"""Approximate nearest neighbours by inner product with cross-polytope hashing.

Vectors are brought to the unit sphere: all are divided by the largest norm, and where
norms differ a further coordinate makes up the rest, so that the nearest by angle is
the nearest by inner product. Each of ``TABLES`` tables rotates them by three rounds of
random signs and a fast Hadamard transform and assigns them to the nearest signed axis.
A query looks into the buckets of its ``PROBES`` largest signed coordinates in every
table; what it finds there is ranked by exact inner products of the original vectors.
A query that finds fewer than ``K`` although there are more candidates asks again, in all
buckets of one table, which hold every vector once.

Buckets are counted first (their number is fixed by the dimension), and a bucket of
more than ``BLOCK`` vectors is dealt to several tasks, as are the queries that probe
it, so a hot bucket is complete and still bounded per task. A task keeps a query's best
``k`` only, which is what is shuffled to the end.

Vectors that are null, zero, of another length than most, or hold a null or non-finite
component take no part, on either side. An id that repeats is one
candidate, with the best score of its rows, and never one for itself; as a query it is
its smallest vector. A null id is no query and no candidate. Extra columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripgrid.session import stage

TABLES = 8
PROBES = 16
K = 20
BLOCK = 2048
SEED = 3
# Norms that differ by a smaller share count as equal.
SAME_NORM = 1e-3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class Rotations:
    """Pseudo-rotations of ``tables`` tables for vectors of one length."""

    def __init__(self, dim: int, tables: int, seed: int):
        self.size = 1 << max(dim - 1, 1).bit_length()
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (tables, 3, self.size))

    def turned(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros((len(x), self.size))
        out[:, : x.shape[1]] = x
        for signs in self.signs[table]:
            out = hadamard(out * signs)
        return out

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        """Nearest signed axis: 2 * axis, plus 1 on its negative side."""
        turned = self.turned(x, table)
        axis = np.abs(turned).argmax(axis=1)
        return 2 * axis + (turned[np.arange(len(x)), axis] < 0)

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The ``n`` nearest signed axes of each row."""
        turned = self.turned(x, table)
        both = np.stack((turned, -turned), axis=2).reshape(len(x), -1)
        n = min(n, both.shape[1])
        return np.argpartition(-both, n - 1, axis=1)[:, :n]


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products summed by coordinate, so that equal vectors score equal in any block."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        out += np.outer(q[:, j], x[:, j])
    return out


def clean(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v, norm) of the vectors that take part."""
    v = F.col("v")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    out = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    out = out.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size("v") > 0) & finite)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c * c))
    return out.withColumn("norm", norm).filter((F.col("norm") > 0) & (F.col("norm") < float("inf")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def search(
    rows: DataFrame,
    is_query: Column,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    tables: int = TABLES,
    probes: int = PROBES,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for each row where ``is_query``, a test of ``id``."""
    spark = rows.sparkSession
    good = clean(rows, id, vector)
    # One row per length that occurs; the most frequent one counts.
    usual = good.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c"), F.min("norm").alias("low"), F.max("norm").alias("top"))
    usual = usual.orderBy(F.desc("c"), "n").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, top = usual["n"], usual["top"]
    lift = usual["low"] < top * (1 - SAME_NORM)
    turn = Rotations(dim + lift, tables, seed)
    good = stage(good.filter(F.size("v") == dim).drop("norm"), "vectors").df

    def on_sphere(x: np.ndarray, index: bool) -> np.ndarray:
        if not index:
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            return np.column_stack((x, np.zeros(len(x)))) if lift else x
        x = x / top
        rest = np.sqrt(np.clip(1 - (x * x).sum(axis=1), 0, 1))
        return np.column_stack((x, rest)) if lift else x

    def hashed(index: bool, every: bool = False):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = on_sphere(_matrix(batch.column("v")), index)
                for table in range(1 if every else tables):
                    found = turn.bucket(x, table)[:, None] if index else turn.probes(x, table, 2 * turn.size if every else probes)
                    row = np.repeat(np.arange(len(x)), found.shape[1])
                    bucket = pa.array(found.ravel() + table * 2 * turn.size, pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row)), bucket], ["id", "v", "bucket"])

        return run

    schema = "id long, v array<double>, bucket int"
    index = good.mapInArrow(hashed(True), schema)
    asking = good.withColumnRenamed("id", id).filter(is_query).groupBy(id).agg(F.min("v").alias("v")).withColumnRenamed(id, "id")
    asking = stage(asking.select("id", "v"), "asking").df
    index, asked = stage(index, "index").df, stage(asking.mapInArrow(hashed(False), schema), "asked").df

    # At most tables * 2 * size buckets, however many rows there are.
    def dealt(df: DataFrame) -> dict[int, int]:
        return {r["bucket"]: -(-r["count"] // block) for r in df.groupBy("bucket").count().collect()}

    buckets = tables * 2 * turn.size
    parts = lambda held: F.get(F.array(*[F.lit(held.get(b, 1)) for b in range(buckets)]), F.col("bucket"))
    place = lambda n: F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), n).cast("int")

    def spread(df: DataFrame, mine: dict, other: dict, own: str, all_: str, side: int) -> DataFrame:
        placed = df.withColumn(own, place(parts(mine))).withColumn(all_, F.explode(F.sequence(F.lit(0), parts(other) - 1)))
        return placed.select("bucket", "i", "q", F.lit(side).alias("side"), "id", "v")

    def rank(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids = table.column("id").to_numpy()
        x = _matrix(table.column("v").combine_chunks())
        qi, ci = ids[side == 1], ids[side == 0]
        out = [[], [], []]
        if len(qi) and len(ci):
            q, c = x[side == 1], x[side == 0]
            by_id = np.argsort(ci, kind="stable")
            ci, c = ci[by_id], c[by_id]
            # Rows of one id stand together and become one candidate.
            each = np.flatnonzero(np.concatenate(([True], ci[1:] != ci[:-1])))
            names, n = ci[each], min(k, len(each))
            for at in range(0, len(qi), 256):
                scores = inner(q[at : at + 256], c)
                scores[qi[at : at + 256, None] == ci[None, :]] = -np.inf
                scores = np.maximum.reduceat(scores, each, axis=1)
                # Candidates are in order of id, so a stable sort breaks ties by it.
                best = _best(scores, n)
                found = np.take_along_axis(scores, best, axis=1)
                real = np.isfinite(found)
                out[0].append(np.repeat(qi[at : at + 256], n).reshape(-1, n)[real])
                out[1].append(names[best][real])
                out[2].append(found[real])
        joined = [np.concatenate(o) if o else np.array([]) for o in out]
        return pa.table({"query_id": pa.array(joined[0], pa.int64()), "vec_id": pa.array(joined[1], pa.int64()), "score": pa.array(joined[2], pa.float64())})

    def answered(index: DataFrame, asked: DataFrame) -> DataFrame:
        index_parts, asked_parts = dealt(index), dealt(asked)
        both = spread(index, index_parts, asked_parts, "i", "q", 0).unionByName(spread(asked, asked_parts, index_parts, "q", "i", 1))
        ranked = both.groupBy("bucket", "i", "q").applyInArrow(rank, "query_id long, vec_id long, score double")
        # A row found in several tables is one result; rows that repeat an id count once for its best score.
        found = ranked.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = stage(answered(index, asked), "found").df
    # Other candidates of a query; at most k + 1 ids are counted to the end.
    others = good.select("id").distinct().limit(k + 1).count() - 1
    counts = first.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    short = stage(asking.join(counts, "id", "left").filter(F.coalesce("n", F.lit(0)) < min(k, others)).select("id", "v"), "short")
    if not short.rows:
        return first
    again = stage(short.df.mapInArrow(hashed(False, every=True), schema), "asked").df
    rest = answered(index.filter(F.col("bucket") < 2 * turn.size), again)
    return first.join(short.df.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` largest of each row, all that tie with the last considered in column order."""
    last = np.partition(scores, -n, axis=1)[:, -n]
    out = np.empty((len(scores), n), np.int64)
    for i, (row, least) in enumerate(zip(scores, last, strict=True)):
        near = np.flatnonzero(row >= least)
        out[i] = near[np.argsort(-row[near], kind="stable")[:n]]
    return out
