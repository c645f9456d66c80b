"""Packing documents into sequences of bounded length: greedy best fit, then best two fit.

A bin is filled with the longest piece that fits its gap, again and again. If a gap is
left, the bin's shortest piece is taken out when two unpacked pieces fit the gap it
leaves more tightly than it did. Only documents longer than a sequence are cut; the
remainder comes first, so that all later pieces are whole sequences.

Each task packs what it reads, in blocks of bounded size, and carries sequences that
are not nearly full over to the next block; so nothing is shuffled, a lost executor
repeats its own tasks only, and a task leaves at most a few sequences with room. Tables
in many small partitions are read by fewer tasks, ``TASK_BYTES`` of text each, so that
what the tasks leave stays below one in a hundred sequences.

A null text is empty and still has its end token. Repeated rows are packed as often as
they occur, rows with a null id too; extra columns are not read. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripgrid.llm.common import whole
from tripgrid.llm.tokens import Encoder

CAPACITY = 1024
END = 2
# Tokens that a task holds before it packs them.
BLOCK = 4_000_000
# Text that a task reads at least, if there is so much.
TASK_BYTES = 8_000_000
# Sequences with room that go from one block to the next.
CARRIED = 256
# Sequences numbered within a task; the task's number is above these bits.
TASK_SHIFT = 33
SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class _Lengths:
    """Unpacked pieces by length; the longest that fits is found by one operation on a bit set."""

    def __init__(self, lengths: Sequence[int], capacity: int):
        self.items: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i, n in enumerate(lengths):
            self.items[n].append(i)
        self.bits = sum(1 << n for n, held in enumerate(self.items) if held)

    def longest(self, most: int) -> int:
        """Largest length up to ``most`` that is left, 0 if there is none."""
        return max((self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1, 0) if most > 0 else 0

    def take(self, length: int) -> int:
        held = self.items[length]
        item = held.pop()
        if not held:
            self.bits ^= 1 << length
        return item

    def put(self, length: int, item: int) -> None:
        self.items[length].append(item)
        self.bits |= 1 << length

    def best_two(self, room: int) -> tuple[int, int]:
        """The two lengths with the largest sum up to ``room``, (0, 0) if no two fit."""
        best, most = (0, 0), 0
        a = self.longest(room - 1)
        while 2 * a > most:
            b = self.longest(min(a, room - a))
            if b == a and len(self.items[a]) < 2:
                b = self.longest(a - 1)
            if b and a + b > most:
                best, most = (a, b), a + b
                if most == room:
                    break
            a = self.longest(a - 1)
        return best


def best_two_fit(lengths: Sequence[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions in ``lengths``, each length from 1 to ``capacity``."""
    left, bins = _Lengths(lengths, capacity), []
    while left.bits:
        room, held = capacity, []
        while n := left.longest(room):
            held.append(left.take(n))
            room -= n
        if room and len(held) > 1:
            last = held[-1]
            shortest = lengths[last]
            a, b = left.best_two(room + shortest)
            if a + b > shortest:
                held[-1:] = [left.take(a), left.take(b)]
                left.put(shortest, last)
        bins.append(held)
    return bins


def _pieces(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece of a document with ``n`` ids, the remainder first."""
    first = n % capacity or capacity
    yield 0, first
    for at in range(first, n, capacity):
        yield at, capacity


class _Packer:
    def __init__(self, capacity: int, task: int):
        self.capacity, self.next = capacity, task << TASK_SHIFT
        self.waiting: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for piece, (start, length) in enumerate(_pieces(len(ids), self.capacity)):
            self.waiting.append((doc_id, piece, start, length, ids[start : start + length].astype("<u4").tobytes()))
        self.tokens += len(ids)

    def pack(self, last: bool) -> Iterator[pa.RecordBatch]:
        held, self.waiting = self.waiting, []
        bins = best_two_fit([p[3] for p in held], self.capacity)
        filled = [sum(held[i][3] for i in members) for members in bins]
        # The emptiest go on to the next block, where they may meet better company.
        roomy = [] if last else sorted((f, k) for k, f in enumerate(filled) if f < 0.98 * self.capacity)[:CARRIED]
        later = {k for _, k in roomy}
        rows = []
        for k, members in enumerate(bins):
            if k in later:
                self.waiting += [held[i] for i in members]
                continue
            at = 0
            for i in members:
                rows.append((*held[i], self.next, at))
                at += held[i][3]
            self.next += 1
        names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        self.tokens = sum(p[3] for p in self.waiting)
        for at in range(0, len(rows), 4096):
            columns = zip(*rows[at : at + 4096], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    block: int = BLOCK,
) -> DataFrame:
    """One row per piece: its document, place in it, ids (little-endian 32 bits) and place in a sequence.

    ``tokenizer`` is the path of a tokenizer file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer, code = _Packer(capacity, context.partitionId() if context else 0), Encoder(tokenizer)
        for batch in batches:
            encoded = code.encode(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                packer.add(doc_id, np.append(ids, end))
                if packer.tokens >= block:
                    yield from packer.pack(last=False)
        yield from packer.pack(last=True)

    own = docs.select(F.col(id).cast("long").alias("doc_id"), whole(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return own.coalesce(max(1, size // TASK_BYTES)).mapInArrow(run, SCHEMA)
