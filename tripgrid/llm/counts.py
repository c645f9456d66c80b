"""Token counts of texts without their ids.

Pieces are counted once per distinct pre-token. A bounded sample of texts gives the
pre-tokens that are worth a broadcast (at most ``FREQUENT`` of at most ``LONGEST``
characters); a document's frequent pre-tokens are summed where the document is read.
Every other pre-token goes to the task that owns it, one row for each document that
holds it, with its frequency there; the task counts its pieces once, and the products
are summed per document. The sample decides the way a pre-token takes, never a count.

Texts are split by the tokenizer's own pre-tokenizer, distinct chunks of a slice of
texts at a time. Strings of special tokens count as one token each, as the tokenizer
reads them.

A null text is empty: no bytes, no tokens. Repeated rows are counted as often as they
occur, rows with a null id too; very long texts are held one at a time; extra columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripgrid.llm.common import whole
from tripgrid.llm.flat import ends_of, flat, slices
from tripgrid.llm.tokens import PLAIN, chunks, load, merged, specials

FREQUENT = 1 << 17
LONGEST = 64
# Texts of the sample that names the frequent pre-tokens.
SAMPLE_ROWS = 4000
SEED = 7
SLOTS = "row long, doc_id long, n_bytes long, pretoken string, n long"


class Splitter:
    """Distinct chunks to the pre-tokens in them; the strings of special tokens are left out and counted."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        marks = specials(self.tokenizer)
        self.special = re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True)))) if marks else None

    def split(self, chunk: str) -> tuple[list[str], int]:
        """The pre-tokens of one chunk in order, and how many special tokens stand between them."""
        parts = self.special.split(chunk) if self.special else [chunk]
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        return [part[a:b] for part in parts if part for _, (a, b) in cut(part)], len(parts) - 1

    def table(self, names: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Pre-tokens of all chunks in order, where each chunk's begin and the last one's end, and special tokens per chunk."""
        plain = pc.match_substring_regex(names, PLAIN).to_pylist()
        found, sizes, marks = [], [], []
        for chunk, one in zip(names.to_pylist(), plain, strict=True):
            held, special = ([chunk], 0) if one else self.split(chunk)
            found += held
            sizes.append(len(held))
            marks.append(special)
        return ends_of(np.array(sizes, np.int64)), found, np.array(marks, np.int64)


def _occurrences(first: np.ndarray) -> np.ndarray:
    """The text of each chunk, by where each text's chunks begin."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _spread(begin: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pre-tokens of each chunk occurrence, and which occurrence each is of."""
    size = begin[code + 1] - begin[code]
    after = ends_of(size)
    return np.repeat(begin[code] - after[:-1], size) + np.arange(after[-1]), np.repeat(np.arange(len(code)), size)


def frequent(docs: DataFrame, tokenizer: str, text: str = "text", most: int = FREQUENT, rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """Pieces of the pre-tokens that occur most often in a sample of about ``rows`` texts."""
    share = min(1.0, rows / max(docs.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(tokenizer)
        for batch in batches:
            for _, part in slices(batch.column("text")):
                code, names, _ = chunks(part)
                begin, found, _ = splitter.table(names)
                times = np.repeat(np.bincount(code, minlength=len(names)), np.diff(begin))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(times, pa.int64())], ["pretoken", "n"])

    found = docs.select(whole(text).alias("text")).sample(share, SEED).mapInArrow(run, "pretoken string, n long")
    ranked = found.filter(F.length("pretoken") <= LONGEST).groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken")
    code = load(tokenizer)
    return {r[0]: len(merged(code, r[0])) for r in ranked.select("pretoken").limit(most).collect()}


def frequencies(docs: DataFrame, tokenizer: str, known: dict[str, int], id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document with the pieces of its ``known`` pre-tokens, and a row for each other pre-token of it.

    Columns are those of ``SLOTS``; ``n`` is a number of pieces where ``pretoken`` is
    null, and a frequency elsewhere.
    """
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, pieces = Splitter(tokenizer), held.value
        for batch in batches:
            for at, part in slices(batch.column("text")):
                row = batch.column("row").slice(at, len(part))
                code, names, first = chunks(part)
                begin, found, marks = splitter.table(names)
                cost = np.fromiter((pieces.get(p, -1) for p in found), np.int64, len(found))
                # What a chunk has of known pre-tokens and special tokens.
                ready = ends_of(np.maximum(cost, 0))
                ready = ready[begin[1:]] - ready[begin[:-1]] + marks
                doc = _occurrences(first)
                sums = np.bincount(doc, ready[code], len(part)).astype(np.int64)
                _, starts = flat(part)
                yield _rows(row, batch.column("doc_id").slice(at, len(part)), np.diff(starts), None, sums)
                # Rare pre-tokens: one row for each document and pre-token.
                rare = np.flatnonzero(cost < 0)
                if not len(rare):
                    continue
                own = ends_of(cost < 0)
                where, of = _spread(own[begin], code)
                texts = pa.array([found[i] for i in rare], pa.string()).dictionary_encode()
                number = texts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                pairs, n = np.unique(doc[of] * len(texts.dictionary) + number[where], return_counts=True)
                which, what = np.divmod(pairs, len(texts.dictionary))
                yield _rows(row.take(pa.array(which)), None, None, texts.dictionary.take(pa.array(what)), n)

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("doc_id"), whole(text).alias("text"))
    return own.mapInArrow(run, SLOTS)


def _rows(row: pa.Array, doc_id: pa.Array | None, n_bytes: np.ndarray | None, pretoken: pa.Array | None, n: np.ndarray) -> pa.RecordBatch:
    size = len(row)
    columns = [
        row,
        pa.nulls(size, pa.int64()) if doc_id is None else doc_id,
        pa.nulls(size, pa.int64()) if n_bytes is None else pa.array(n_bytes, pa.int64()),
        pa.nulls(size, pa.string()) if pretoken is None else pretoken,
        pa.array(n, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SLOTS.split(", ")])


def _weighed(tokenizer: str):
    """Frequencies times pieces, over rows that come by ascending pre-token, so that each is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, last, cost = load(tokenizer), None, 0
        for batch in batches:
            texts = batch.column("pretoken").dictionary_encode()
            names = texts.dictionary.to_pylist()
            sizes = [cost if name == last else len(merged(code, name)) for name in names]
            if names:
                last, cost = names[-1], sizes[-1]
            times = pc.fill_null(pa.array([*sizes, 1], pa.int64()).take(pc.fill_null(texts.indices, len(sizes))), 1)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "doc_id", "n_bytes")] + [pc.multiply(batch.column("n"), times)], ["row", "doc_id", "n_bytes", "n"])

    return run


def count(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", most: int = FREQUENT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens) for each row of ``docs``.

    ``tokenizer`` is the path of a byte-level tokenizer file that every executor can open.
    """
    known = frequent(docs, tokenizer, text, most, sample_rows)
    slots = frequencies(docs, tokenizer, known, id, text)
    # Rows of documents have no pre-token; they are dealt by their own numbers.
    owner = F.when(F.col("pretoken").isNull(), F.col("row")).otherwise(F.xxhash64("pretoken"))
    dealt = slots.repartition(owner).sortWithinPartitions("pretoken")
    weighed = dealt.mapInArrow(_weighed(tokenizer), "row long, doc_id long, n_bytes long, n long")
    summed = weighed.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return summed.drop("row")
