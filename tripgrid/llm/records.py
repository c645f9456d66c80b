"""Token ids in files of length-delimited binary records, with an offset index.

A record is: payload length (8 bytes), masked checksum of those 8 bytes (4), payload,
masked checksum of the payload (4), one line end. Numbers are little-endian. The
checksum is CRC-32, masked by a rotation and an addition, so that records of records do
not carry checksums of themselves. A payload is: 1 if there is a document id, else 0
(1 byte), the width of an id (1 byte, 2 or 4), the document id (8 bytes), the ids.

The closing line end lets Spark's own text writer write the files: they reach any
store that Spark reaches, and a task that is repeated after an executor is lost leaves
no half file. Files are numbered in ascending document order, null ids first; rows
with one id stay in input order. The index is a table of its own, made from the files
themselves, so that records can be read in any order by file, offset and length.

A null text is empty and has the end id only. Repeated rows are written as often as
they occur; extra columns are not read; an empty table gives no records.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripgrid.llm.common import whole
from tripgrid.llm.tokens import Encoder
from tripgrid.session import remove, stage

END = 2
# Bytes of text that go to one file.
FILE_BYTES = 24_000_000
MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<IB")
PAYLOAD = struct.Struct("<BBq")
LINE_END = 0x0A
RECORDS = "file int, offset long, length long, doc_id long, start long, n_tokens long, ids binary"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = PAYLOAD.pack(doc_id is not None, width, doc_id or 0) + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + TAIL.pack(masked(payload), LINE_END)


def frames(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids) of each record of a file; a damaged one raises."""
    at = 0
    while at < len(data):
        n, check = HEAD.unpack_from(data, at)
        if masked(data[at : at + 8]) != check:
            raise ValueError(f"the length of the record at {at} is damaged")
        payload = data[at + HEAD.size : at + HEAD.size + n]
        if len(payload) != n or TAIL.unpack_from(data, at + HEAD.size + n) != (masked(payload), LINE_END):
            raise ValueError(f"the record at {at} is damaged")
        known, width, doc_id = PAYLOAD.unpack_from(payload)
        size = HEAD.size + n + TAIL.size
        yield at, size, doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=PAYLOAD.size)
        at += size


def write(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end: int = END, file_bytes: int = FILE_BYTES) -> None:
    """Encode every text and write the records to ``path`` in ascending order of ``id``.

    Texts are dealt to files by ranges of ids before they are encoded, so each is moved
    once and encoded once.
    """
    own = docs.select(F.col(id).cast("long").alias("doc_id"), whole(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    files = max(cores, -(-size // file_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Encoder(tokenizer)
        width = 2 if max(code.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        for batch in batches:
            out, held = [], 0
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), code.encode(batch.column("text")), strict=True):
                out.append(frame(doc_id, np.append(ids, end), width))
                held += len(out[-1])
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            # The text writer adds the line end.
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    dealt = own.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(files, "doc_id", "row")
    framed = dealt.sortWithinPartitions("doc_id", "row").select("doc_id", "text").mapInArrow(run, "record binary")
    framed.select(F.expr("substring(record, 1, length(record) - 1)").cast("string").alias("value")).write.text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files under ``path``; ``start`` counts the ids before it in its own file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                rows, start, held = [], 0, 0
                for offset, size, doc_id, ids in frames(content.as_py()):
                    rows.append((file, offset, size, doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                    start += len(ids)
                    held += size
                    if held > 1 << 22:
                        yield _records(rows)
                        rows, held = [], 0
                if rows:
                    yield _records(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    return files.select(number.alias("file"), "content").mapInArrow(run, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
    names = [c.split()[0] for c in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def write_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Write where each record lies (file, offset, length) and what it holds (doc_id, start, n_tokens, crc32).

    Here ``start`` counts all ids before the record, over all files in their order, and
    ``crc32`` is that of the ids as 32-bit numbers.
    """
    local = stage(read(spark, path).withColumn("crc32", F.crc32("ids")).drop("ids"), "offsets")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = local.df.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    starts = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("start")
    local.df.join(starts, "file").withColumn("start", place).drop("before").write.parquet(index)
    remove(spark, local.path)
    return spark.read.parquet(index)
