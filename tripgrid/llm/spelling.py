"""Groups of spelling variants by PartEnum signatures of letter multisets.

A word is a binary vector with one dimension for the first, second, ... occurrence of
each letter. One replaced letter changes two dimensions of it, one inserted or deleted
letter one. PartEnum deals the dimensions to parts and enumerates signatures, each the
vector without some of the parts: without any two of ``PARTS_SAME`` for words of one
length, without any one of ``PARTS_NEXT`` for lengths that differ by one. Two words
whose vectors differ that little agree on the signature without the parts that differ.
An edit also leaves one half of a word as it is, so every signature is emitted with the
hash of each half, and words that share many letters do not all meet. Signatures meet
in an equi-join, and every pair that meets is verified by its edit distance.

Parts are balanced by how many words have each dimension, counted over all words. Any
dealing gives the same pairs; a balanced one gives fewer to verify.

Words are counted by Spark after each task has counted its own, so a word with a third
of all occurrences is one row for each slice of texts. A null text has no words, and
neither has an empty one; a null id takes part in the spoiling as an empty id. Repeated
rows count as often as they occur; a run of letters of any length is one word; extra
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripgrid.llm.common import uneven_join, whole
from tripgrid.llm.flat import coded, flat, runs, slices, text_of
from tripgrid.session import Staged, remove, stage

LEAST_LETTERS = 6
LEAST_COUNT = 5
# A form must occur so many times as often as its variant.
TIMES = 5
# Where the checksum of an id and a word is divisible by this, the word loses a letter.
SPOIL = 199
PARTS_SAME, PARTS_NEXT = 5, 3
# Dimensions that are dealt by their counts; rarer ones are dealt by their numbers.
DEALT = 4096
# Occurrences of one letter that have dimensions of their own.
OCCURRENCES = 64

_LATIN = np.zeros(256, bool)
_LATIN[0x41:0x5B] = _LATIN[0x61:0x7B] = True
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to A-Z, a-z or a character from U+00C0 to U+00FF."""
    inside = _LATIN[data]
    later = np.zeros(len(data), bool)
    later[1:] = (data[:-1] == 0xC3) & (data[1:] & 0xC0 == 0x80)
    inside |= later
    inside[:-1] |= later[1:]
    return inside


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ 0xEDB88320, out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()


def checksums(before: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of what ``before`` is the checksum of, followed by each stretch of ``data``."""
    state, size = ~before.astype(np.uint32), end - begin
    order = np.argsort(-size, kind="stable")
    falling = -size[order]
    for k in range(int(size.max(initial=0))):
        going = order[: np.searchsorted(falling, -k, "left")]
        state[going] = _CRC[(state[going] ^ data[begin[going] + k]) & 0xFF] ^ (state[going] >> 8)
    return ~state


def spoiled(word: str, check: int) -> str:
    """``word`` without the letter that its checksum points at."""
    at = check % len(word)
    return word[:at] + word[at + 1 :]


def _counted(ids: list[int | None], texts: pa.Array, least: int, spoil: int | None) -> tuple[pa.Array, np.ndarray]:
    """Words of a slice of texts, each once but for spoiled ones, and how often they occur."""
    data, starts = flat(texts)
    data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    begin, end = runs(letters(data), starts)
    # The first byte of a two-byte letter is no letter of its own.
    size = end - begin - _within(data == 0xC3, begin, end)
    long = np.flatnonzero(size >= least)
    begin, end, size = begin[long], end[long], size[long]
    hit = np.zeros(len(begin), bool)
    odd: list[str] = []
    if spoil and len(begin):
        prefix = np.array([zlib.crc32(b"%s:" % (b"" if i is None else b"%d" % i)) for i in ids], np.uint32)
        check = checksums(prefix[text_of(begin, starts)], data, begin, end)
        hit = check % spoil == 0
        for i in np.flatnonzero(hit & (size > least)):
            odd.append(spoiled(data[begin[i] : end[i]].tobytes().decode(), int(check[i])))
    begin, end = begin[~hit], end[~hit]
    ends = np.concatenate([[0], np.cumsum(end - begin)])
    held = data[np.repeat(begin - ends[:-1], end - begin) + np.arange(ends[-1])]
    code, names = coded(held, ends)
    words = pa.concat_arrays([names.cast(pa.string()), pa.array(odd, pa.string())])
    return words, np.concatenate([np.bincount(code, minlength=len(names)), np.ones(len(odd), np.int64)])


def _within(marks: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many ``marks`` lie in each stretch."""
    before = np.concatenate([[0], np.cumsum(marks)])
    return before[end] - before[begin]


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, count: int = LEAST_COUNT, spoil: int | None = None) -> DataFrame:
    """(word, n) of every word with ``least`` letters and ``count`` occurrences, lower-cased where it is ASCII.

    With ``spoil`` a word whose checksum it divides loses a letter, which plants known
    misspellings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at, part in slices(batch.column("text")):
                words, n = _counted(ids[at : at + len(part)], part, least, spoil)
                yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], ["word", "n"])

    own = docs.select(F.col(id).cast("long").alias("doc_id"), whole(text).alias("text"))
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


class _Letters:
    """The letters of words, flattened: character, word, place from the front and from the back, dimension."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.char = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        self.word = np.repeat(np.arange(len(words)), self.size)
        ends = np.cumsum(self.size)
        self.front = np.arange(len(self.char)) - np.repeat(ends - self.size, self.size)
        self.back = np.repeat(self.size, self.size) - 1 - self.front
        order = np.lexsort((self.char, self.word))
        char, word = self.char[order], self.word[order]
        new = np.ones(len(char), bool)
        new[1:] = (char[1:] != char[:-1]) | (word[1:] != word[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(char)), 0))
        nth = np.empty(len(char), np.int64)
        nth[order] = np.minimum(np.arange(len(char)) - first, OCCURRENCES - 1)
        self.dim = self.char * OCCURRENCES + nth


def dimensions(words: DataFrame, most: int = DEALT) -> list[int]:
    """The dimensions that most words have, most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, n = np.unique(_Letters(batch.column("word").to_pylist()).dim, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(dim, pa.int64()), pa.array(n, pa.int64())], ["dim", "n"])

    counted = words.select("word").mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    return [r[0] for r in counted.orderBy(F.desc("n"), "dim").limit(most).collect()]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers from numbers, the same on every machine."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _projections(held: _Letters, rank: dict[int, int], parts: int, out: int) -> list[np.ndarray]:
    """For every choice of ``out`` parts, a hash of each word's vector without them."""
    dims, number = np.unique(held.dim, return_inverse=True)
    # Dealt in turns, back and forth, most frequent first.
    place = np.array([rank.get(int(d), int(d)) for d in dims], np.int64)
    turn, step = np.divmod(place, parts)
    part = np.where(turn % 2 == 0, step, parts - 1 - step)
    sums = np.zeros((parts, len(held.size)), np.uint64)
    np.add.at(sums, (part[number], held.word), _mixed(dims)[number])
    total = sums.sum(axis=0)
    return [_mixed(total - sums[list(left)].sum(axis=0)) + np.uint64(k) for k, left in enumerate(combinations(range(parts), out))]


def _halves(held: _Letters, shorter: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first half and of the last half, by the length of the shorter word of a pair."""
    half = shorter // 2
    first = _mixed(_mixed(held.char) + held.front.astype(np.uint64))
    last = _mixed(_mixed(held.char) + held.back.astype(np.uint64))
    out = []
    for hashes, place, size in ((first, held.front, half), (last, held.back, shorter - half)):
        sums = np.zeros(len(held.size), np.uint64)
        use = place < size[held.word]
        np.add.at(sums, held.word[use], hashes[use])
        out.append(sums)
    return [_mixed(out[0]), _mixed(out[1]) + np.uint64(1)]


# A word's part in a pair: of the same length, the shorter, the longer.
SAME, SHORTER, LONGER = 0, 1, 2


def signatures(words: DataFrame, ranked: list[int]) -> DataFrame:
    """(key, role, word, n): rows whose words may be near agree on the key."""
    rank = {d: i for i, d in enumerate(ranked)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = _Letters(batch.column("word").to_pylist())
            # The shorter length of a pair and the kind of pair keep groups apart.
            for role, shorter, parts, out in ((SAME, held.size, PARTS_SAME, 2), (SHORTER, held.size, PARTS_NEXT, 1), (LONGER, held.size - 1, PARTS_NEXT, 1)):
                group = _mixed(2 * shorter + (role > 0))
                halves = _halves(held, shorter)
                for projected in _projections(held, rank, parts, out):
                    for half in halves:
                        key = _mixed(projected + _mixed(half + group)).view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key), pa.array(np.full(len(key), role, np.int8)), batch.column("word"), batch.column("n")], ["key", "role", "word", "n"]
                        )

    return words.select("word", "n").mapInArrow(run, "key long, role byte, word string, n long")


def near(a: Column, b: Column) -> Column:
    """One code point inserted, deleted or replaced."""
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of near words once."""
    signed = signatures(words, dimensions(words))
    left = signed.select("key", F.col("role").alias("a_role"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = signed.select("key", F.col("role").alias("b_role"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    same = (F.col("a_role") == SAME) & (F.col("b_role") == SAME) & (F.col("a") < F.col("b"))
    next_to = (F.col("a_role") == SHORTER) & (F.col("b_role") == LONGER)
    met = left.join(right, "key").filter((same | next_to) & near(F.col("a"), F.col("b")))
    return met.select("a", "a_n", "b", "b_n").distinct()


def roots(forms: Staged) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form), whose last form is its root.

    Each round follows twice as many forms. Forms occur more often than their variants
    by a factor, so chains are short and have an end.
    """
    spark = forms.df.sparkSession
    reached = stage(forms.df.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reached.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(uneven_join(reached.df, ahead, "root").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        going = moved.df.filter("moved").limit(1).count()
        remove(spark, reached.path)
        reached = Staged(moved.df.drop("moved"), moved.rows, moved.path)
        if not going:
            return reached.df


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row (word, n) with distinct words.

    A word's form is its near word with most occurrences (ties: the smallest), if it
    occurs at least ``times`` as often.
    """
    held = stage(words.select("word", "n"), "words")
    pairs = near_pairs(held.df)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = pairs.select(F.inline(both)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    form_n = -F.col("best.least")
    common = form_n >= times * F.col("n")
    found = held.df.join(best, "word", "left").select(
        "word", F.when(common, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(common, form_n).alias("form_n")
    )
    found = stage(found, "forms")
    linked = stage(found.df.filter(F.col("form").isNotNull()).select("word", "form"), "linked")
    last = roots(linked)
    return found.df.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
