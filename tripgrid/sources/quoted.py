"""Records of delimited files whose quoted fields hold line breaks, read in pieces by many tasks.

Where a record begins can only be told from all that stands before it. But a line has one
of four effects on being inside a quoted field or not: none, the other way round, outside
at its end, or inside at its end. Effects are chained, so each block of a file is reduced
to one effect where it is read, a prefix over the blocks of a file says how each begins,
and then every task cuts its own blocks into records. Only what hangs over the edge of a
block is moved. Files without such line breaks cost one scan that looks for a line that
ends inside a quoted field.

Quotes open a field only at its start, and doubled ones stand for themselves; text after
a closing quote belongs to the field. Lines end with LF, CR LF or CR, which stay as they
are inside fields. A quote that is never closed takes the rest of its file, as in any
sequential reader.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripgrid.operators.lookup import BROADCAST_ROWS
from tripgrid.session import Staged, remove, stage

SAME, SWAP, OUTSIDE, INSIDE = range(4)

# Possessive quantifiers: the patterns never go back, however long a line is.
_TEXT = r'[^"]*+(?:""[^"]*+)*+'
_OPEN = rf'(?:(?:"{_TEXT}"[^,]*+|[^",][^,]*+|),)*+"{_TEXT}\z'
_FROM_OUTSIDE = rf"\A{_OPEN}"
_FROM_INSIDE = rf'\A{_TEXT}(?:\z|"[^,]*+,{_OPEN})'

# What a task found: a whole record, one that its block does not end, and lines that go
# on with the record of an earlier block.
WHOLE, OPENED, GOES_ON = range(3)


def _lines(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """``value`` (a line without its end), ``end``, and where it stands, in reading order."""
    read = spark.read.option("lineSep", "\n").text(list(roots))
    path, block = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    parts = F.split("value", r"\r(?!\z)")
    several = F.col("value").contains("\r")
    # A CR that is not followed by LF ends a line too.
    split = read.select(path, block, F.posexplode(F.when(several, parts).otherwise(F.array("value"))).alias("k", "part"), F.when(several, F.size(parts)).otherwise(1).alias("n"))
    last = F.col("k") + 1 == F.col("n")
    return split.select("path", "block", F.col("part").alias("value"), F.when(last, "\n").otherwise("\r").alias("end"))


def _effect(value: Column) -> Column:
    """The effect of a line; most lines hold no quote and have none."""
    opens, stays = value.rlike(_FROM_OUTSIDE), value.rlike(_FROM_INSIDE)
    quoted = F.when(opens, F.when(stays, INSIDE).otherwise(SWAP)).otherwise(F.when(stays, SAME).otherwise(OUTSIDE))
    return F.when(value.contains('"'), quoted).otherwise(SAME).cast("byte")


def has_line_breaks(spark: SparkSession, roots: Sequence[str]) -> bool:
    """Whether any line, read on its own, ends inside a quoted field."""
    value = F.col("value")
    lines = _lines(spark, roots).filter(value.contains('"') & value.rlike(_FROM_OUTSIDE))
    return lines.limit(1).count() > 0


def inside_after(effect: np.ndarray, before: bool) -> np.ndarray:
    """For each line, whether its end is inside a quoted field, if the first begins ``before``."""
    swaps = np.cumsum(effect == SWAP)
    fixed = np.where(effect >= OUTSIDE, np.arange(len(effect)), -1)
    last = np.maximum.accumulate(fixed) if len(effect) else fixed
    known = last >= 0
    base = np.where(known, effect[np.maximum(last, 0)] == INSIDE, before)
    return base ^ ((swaps - np.where(known, swaps[np.maximum(last, 0)], 0)) % 2 == 1) if len(effect) else np.zeros(0, bool)


def _pieces(batch: pa.RecordBatch) -> list[tuple[str, int, int, int]]:
    """(path, block, from, to): stretches of a batch that belong to one block."""
    if not batch.num_rows:
        return []
    path = batch.column("path").dictionary_encode()
    code, block = path.indices.to_numpy(), batch.column("block").to_numpy()
    change = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1
    edges = [0, *change.tolist(), batch.num_rows]
    names = path.dictionary.to_pylist()
    return [(names[code[a]], int(block[a]), a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _block_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The end of each block if it begins outside and if it begins inside a quoted field."""
    here, ends = None, (False, True)
    names = ["path", "block", "outside", "inside"]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*here, *ends)], names)

    for batch in batches:
        effect = batch.column("effect").to_numpy()
        for path, block, a, b in _pieces(batch):
            if (path, block) != here:
                if here:
                    yield row()
                here, ends = (path, block), (False, True)
            ends = tuple(bool(inside_after(effect[a:b], e)[-1]) for e in ends)
    if here:
        yield row()


def _edges(spark: SparkSession, roots: Sequence[str]) -> list[tuple[str, int, bool]]:
    """(path, block, inside): after which blocks being inside a quoted field changes, in order."""
    quoted = _lines(spark, roots).select("path", "block", _effect(F.col("value")).alias("effect")).filter(F.col("effect") != SAME)
    effects = stage(quoted.mapInArrow(_block_effects, "path string, block long, outside boolean, inside boolean"), "blocks")
    order = Window.partitionBy("path").orderBy("block")
    swap = (F.col("outside") & ~F.col("inside")).cast("int")
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").cast("int").alias("value"), "swaps"))
    state = (F.coalesce(F.col("fixed.value"), F.lit(0)) + F.col("swaps") - F.coalesce(F.col("fixed.swaps"), F.lit(0))) % 2 == 1
    ends = (
        effects.df.withColumn("swaps", F.sum(swap).over(order))
        .withColumn("fixed", F.last(fixed, ignorenulls=True).over(order))
        .select("path", "block", state.alias("now"))
        .withColumn("was", F.coalesce(F.lag("now").over(order), F.lit(False)))
    )
    changes = stage(ends.filter("now <> was").select("path", "block", "now"), "edges")
    if changes.rows > BROADCAST_ROWS:
        raise ValueError(f"{changes.rows} blocks end inside a quoted field; read fewer files at once or larger blocks")
    found = sorted(tuple(r) for r in changes.df.collect())
    for held in (effects, changes):
        remove(spark, held.path)
    return found


class _Cutter:
    """Cuts the lines of one block after the other into records."""

    def __init__(self, edges: list[tuple[str, int, bool]]):
        self.edges: dict[str, tuple[list[int], list[bool]]] = {}
        for path, block, inside in edges:
            blocks, states = self.edges.setdefault(path, ([], []))
            blocks.append(block)
            states.append(inside)
        self.here: tuple[str, int] | None = None
        self.rows: list[tuple] = []
        # The next record is the first of its file.
        self.head = False

    def _begin(self, path: str, block: int) -> None:
        blocks, states = self.edges.get(path, ([], []))
        before = int(np.searchsorted(blocks, block)) - 1
        self.here, self.inside = (path, block), before >= 0 and states[before]
        self.head = block == 0
        # The lines of the record that is not ended yet, and the place of its first one.
        self.held, self.at, self.kind = [], 0, GOES_ON if self.inside else WHOLE

    def _end(self) -> None:
        if self.here and self.held:
            kind = self.kind if self.kind == GOES_ON else OPENED if self.inside else WHOLE
            self._put(kind)

    def _put(self, kind: int) -> None:
        record, self.held = "".join(self.held), []
        if kind != WHOLE or record.strip():
            self.rows.append((*self.here, self.at, kind, self.head and kind != GOES_ON, record))
            self.head = False

    def add(self, path: str, block: int, lines: list[str], effect: np.ndarray, first: int) -> None:
        if (path, block) != self.here:
            self._end()
            self._begin(path, block)
        after = inside_after(effect, self.inside)
        before = np.append(self.inside, after[:-1])
        starts = [*np.flatnonzero(~before).tolist(), len(lines)]
        self._extend(lines[: starts[0]], first)
        for a, b in zip(starts, starts[1:], strict=False):
            if self.held:
                self._put(self.kind)
            self.kind = WHOLE
            self._extend(lines[a:b], first + a)
        self.inside = bool(after[-1])

    def _extend(self, lines: list[str], at: int) -> None:
        if lines:
            self.at = at if not self.held else self.at
            self.held += lines

    def batch(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if last:
            self._end()
        for i in range(0, len(self.rows), 4096):
            columns = zip(*self.rows[i : i + 4096], strict=True)
            types = [pa.string(), pa.int64(), pa.int64(), pa.int8(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "block", "at", "kind", "head", "record"])
        self.rows = []


def records(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """``path, block, at, head, record``: every record, with the block and the place in it of its first line.

    ``head`` marks the first record of a file.
    The records are a stored table, because blocks have to be the same as those whose
    beginnings were found. Blank records are left out.
    """
    edges = _edges(spark, roots)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(edges)
        for batch in batches:
            lines, effect = batch.column("line").to_pylist(), batch.column("effect").to_numpy()
            at = batch.column("at").to_numpy()
            for path, block, a, b in _pieces(batch):
                cutter.add(path, block, lines[a:b], effect[a:b], int(at[a]))
            yield from cutter.batch()
        yield from cutter.batch(last=True)

    row = F.pmod(F.monotonically_increasing_id(), F.lit(2**33)).alias("at")
    lines = _lines(spark, roots).select("path", "block", row, F.concat("value", "end").alias("line"), _effect(F.col("value")).alias("effect"))
    found = stage(lines.mapInArrow(cut, "path string, block long, at long, kind byte, head boolean, record string"), "records")
    whole = found.df.filter(F.col("kind") == WHOLE).drop("kind")
    joined = whole.unionByName(_over_edges(found))
    bare = F.regexp_replace("record", r"\r?[\r\n]?\z", "")
    return joined.withColumn("record", bare)


def _over_edges(found: Staged) -> DataFrame:
    """Records that hang over the edge of a block: their beginning and all lines that go on with it.

    There are two parts for each block at most.
    """
    parts = found.df.filter(F.col("kind") != WHOLE)
    before = Window.partitionBy("path").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col("kind") == OPENED, F.struct("block", "at"))
    owned = parts.withColumn("first", F.last(own, ignorenulls=True).over(before))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("block", "at", "record")))["record"], "")
    joined = owned.groupBy("path", "first").agg(F.max("head").alias("head"), text.alias("record"))
    return joined.select("path", "first.block", "first.at", "head", "record")
