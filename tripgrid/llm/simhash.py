"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant that is at most half the radius
away from each. So every distinct fingerprint emits its ball of that half radius, the
variants are shuffled, and fingerprints that meet in a variant are linked. At most one
ball's worth of distinct fingerprints can meet in a variant (65 for one bit), because
exact copies are reduced to one fingerprint before; links go to the smallest of them
only. For an odd radius one end of a link uses the larger half and the other the smaller.

A null or empty text has the fingerprint zero, which is linked like any other. Repeated
rows stay rows and share a component; a null id is never the smallest of a component
unless it is alone there. Extra columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripgrid.llm.common import free, uneven_join, whole
from tripgrid.llm.graph import components
from tripgrid.session import Staged, stage

SHINGLE = 3
RADIUS = 2
SEED = 42
# Hashes whose bits are spread out at a time.
BLOCK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; ``bytes`` methods are ASCII only."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.dtype("<u8"), len(grams))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the column ``fingerprint`` (a signed long with the 64 bits) in place of the text."""
    rest = [c for c in docs.columns if c != text]
    body = free("__text", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(body)], np.uint64)
            columns = [batch.column(c) for c in rest] + [pa.array(found.view(np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "fingerprint"])

    schema = docs.select(*rest).withColumn("fingerprint", F.lit(0).cast("long")).schema
    return docs.select(*rest, whole(text).alias(body)).mapInArrow(run, schema)


def ball(bits: int) -> list[int]:
    """Signed masks with at most ``bits`` bits set, the empty one first."""
    masks = [sum(1 << i for i in flip) for n in range(bits + 1) for flip in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``prints``; their closure has every pair within ``radius``."""
    large, small = (radius + 1) // 2, radius // 2
    masks = ball(large)
    inner = len(ball(small))
    emitted = prints.select("fingerprint", F.posexplode(F.array(*[F.lit(m) for m in masks]).cast("array<bigint>")).alias("k", "mask"))
    a, near = F.col("fingerprint"), (F.col("k") < inner) if small < large else F.lit(True)
    variants = emitted.select(a.alias("a"), a.bitwiseXOR(F.col("mask")).alias("variant"), F.when(near, a).alias("end"))
    meeting = Window.partitionBy("variant")
    return (
        variants.select("a", F.min("end").over(meeting).alias("b"))
        .filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .distinct()
    )


def classes(prints: Staged, radius: int = RADIUS) -> DataFrame:
    """One row (fingerprint, root, component_id) for each distinct fingerprint of rows (doc_id, fingerprint)."""
    copies = stage(prints.df.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "prints").df
    roots = components(links(copies.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    rooted = copies.join(roots, "fingerprint", "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    rooted = stage(rooted, "rooted").df
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return uneven_join(rooted.select("fingerprint", "root"), lowest, "root")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) for each row; component_id is the smallest id reached by links."""
    own = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    prints = stage(fingerprints(own, "text", shingle), "simhash")
    found = stage(classes(prints, radius), "classes").df
    return uneven_join(prints.df, found, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hexed(fingerprint: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, the first of them if it repeats.

    Rows are numbered when they are written with their fingerprints, so a row can be
    named even if ids repeat.
    """
    row, printed = free("__row", docs.columns), free("__print", docs.columns)
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    held = stage(numbered, "docs").df
    own = held.select(F.col(id).alias("doc_id"), F.col(row).alias("row"), F.col(text).alias("text"))
    prints = stage(fingerprints(own, "text", shingle), "simhash")
    found = stage(classes(prints, radius), "classes").df
    # Each fingerprint's first row, then each component's.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = prints.df.groupBy("fingerprint").agg(F.min(order).alias("o"))
    chosen = firsts.join(found, "fingerprint").groupBy("root").agg(F.min("o").alias("o"))
    stay = chosen.select(F.col("o.row").alias(row))
    return held.join(stay, row, "left_semi").select(*docs.columns)
