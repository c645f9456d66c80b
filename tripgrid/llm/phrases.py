"""Collocations from stripes: each prefix keys a counter of the words that come next.

A stripe belongs to a language and a prefix of words and maps each next word to how
often it follows within a piece of text. Tasks count their own stripes, which are merged
entry by entry where they meet; entries below ``least`` are dropped, because a phrase is
as rare as any part of it. Level by level, from the empty prefix on, stripes give the
counts of phrases one word longer. The merged stripes hold all that scoring needs: an
entry is an extension of its prefix, a prefix's total is an entry of the level before,
and the largest entry of a prefix's stripe says whether the prefix never stands without
one certain word after it (and the largest entry by suffix, before it).

Tasks leave out what cannot be frequent by a filter of the level before: a fixed number
of bits, one for the hash of each frequent phrase. It may let rare phrases pass, never
stop a frequent one, and does not grow past ``FILTER_BITS``. The stripe of a prefix with
``HOT`` occurrences or more (as a second filter says) is cut into shards by the hash of
the next word, so that no prefix fills a task; a rarer prefix has fewer next words than
occurrences. Partial stripes travel packed, all those of a slice of texts and a bucket of
keys as one compressed row, are put in order of their key where they arrive, and are
merged one after the other.

A null text has no words; a null language is ``und``. Repeated rows count as often as
they occur; a very long text is held alone; extra columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripgrid.llm.common import uneven_join, whole
from tripgrid.llm.flat import coded, ends_of, flat, runs, slices, text_of
from tripgrid.operators.lookup import lookup_join
from tripgrid.session import Staged, remove, stage

LEAST = 100
LONGEST = 5
TOP = 2000
#: Bits of the filter of frequent phrases: 16 for each phrase, at most 16 MB.
FILTER_BITS = 1 << 27
#: Entries that a shard of a stripe holds, as far as the number of frequent words tells.
SHARD = 4096
#: Occurrences from which a prefix has shards.
HOT = 16_384
#: Entries in one row of a stripe on its way to be merged.
ROW_ENTRIES = 256
#: Bytes of text whose words a shard of the empty prefix counts.
SHARD_BYTES = 8_000_000
#: Buckets of keys: the least, and bytes of text for one more.
BUCKETS = 32
BUCKET_BYTES = 32_000_000
#: Stripes merged at a time.
MERGED = 10_000
#: Bytes of text counted at a time.
SLICE = 6_000_000
#: Bytes of one row of the filter on its way to the driver.
ROW_BYTES = 4096
UNKNOWN = "und"

KEY = ("lang", "prefix", "shard")
STRIPES = "lang string, prefix string, shard int, next array<string>, n array<bigint>"
#: Words are joined by blanks, counts are 32-bit numbers one after the other.
PACKED = "lang string, prefix string, shard int, next string, n binary"
#: The stripes of a bucket: ``chars`` bytes of text, a line for each with prefix and next
#: words; then the shards and the counts.
BUCKETED = "lang string, bucket int, size int, chars int, stripes binary"
CODEC = "zstd"

# A-Z to lower case, the ends of pieces to line ends, tabs to blanks.
_TABLE = bytearray(range(256))
_TABLE[0x41:0x5B] = _TABLE[0x61:0x7B]
_TABLE[0x09] = 0x20
for _end in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_end] = 0x0A
_TABLE = bytes(_TABLE)

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(texts: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, len(texts))


class _Words:
    """The words of a slice of texts: code, language and piece of each, and a hash of each distinct word."""

    def __init__(self, texts: pa.Array, langs: np.ndarray):
        raw, starts = flat(texts)
        data = np.frombuffer(raw.tobytes().translate(_TABLE), np.uint8)
        line = data == 0x0A
        inside = ~line & (data != 0x20)
        begin, end = runs(inside, starts)
        self.code, self.names = coded(data[inside], ends_of(end - begin))
        doc = text_of(begin, starts)
        self.lang = langs[doc]
        lines = ends_of(line)[begin]
        # The first word of a piece, or of a text.
        fresh = np.ones(len(begin), bool)
        fresh[1:] = (lines[1:] != lines[:-1]) | (doc[1:] != doc[:-1])
        self.piece = np.cumsum(fresh)
        self.hash = _hashes(self.names.to_pylist())


def phrase_hashes(word: np.ndarray, lang: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from each place on; there are ``length - 1`` fewer than words."""
    out = _mixed(lang)[: len(word) - length + 1]
    for k in range(length):
        out = _mixed(out * _STEP + word[k : len(word) - length + 1 + k])
    return out


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _stripes(
    words: _Words, langs: list[str], length: int, bits: tuple[np.ndarray, np.ndarray] | None, shards: int
) -> tuple[pa.RecordBatch, np.ndarray] | None:
    """The stripes of prefixes of ``length - 1`` words in a slice of texts, and a hash of the key of each.

    ``bits`` are the filters of frequent and of hot phrases one word shorter.
    """
    places = len(words.code) - length + 1
    if places <= 0:
        return None
    lang_hash = _hashes(langs)[words.lang]
    shorter = _mixed(lang_hash)
    good = words.piece[:places] == words.piece[length - 1 :]
    if bits is not None:
        # Both parts that are one word shorter have to be frequent.
        shorter = phrase_hashes(words.hash[words.code], lang_hash, length - 1)
        seen = _passes(bits[0], shorter)
        good &= seen[:places] & seen[1 : places + 1]
    at = np.flatnonzero(good)
    if not len(at):
        return None
    # A number for each prefix, from the numbers of shorter ones.
    key = words.lang[at].astype(np.int64)
    for k in range(length - 1):
        key = np.unique(key * len(words.names) + words.code[at + k], return_inverse=True)[1]
    pair, first, n = np.unique(key * len(words.names) + words.code[at + length - 1], return_index=True, return_counts=True)
    prefix, following = np.divmod(pair, len(words.names))
    where = at[first]
    shard = (words.hash[following] % np.uint64(shards)).astype(np.int64)
    if bits is not None:
        shard[~_passes(bits[1], shorter[where])] = 0
    order = np.lexsort((shard, prefix))
    prefix, following, n, where, shard = prefix[order], following[order], n[order], where[order], shard[order]
    new = np.ones(len(prefix), bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | (shard[1:] != shard[:-1])
    # Long stripes are sent in rows of bounded size; all rows of a key are merged.
    new[(np.arange(len(prefix)) - np.maximum.accumulate(np.where(new, np.arange(len(prefix)), 0))) % ROW_ENTRIES == 0] = True
    begin = np.flatnonzero(new)
    ends = np.append(begin, len(prefix))
    names = words.names.cast(pa.string())
    parts = [names.take(pa.array(words.code[where[begin] + k])) for k in range(length - 1)]
    joined = pc.binary_join_element_wise(*parts, " ") if parts else pa.array([""] * len(begin), pa.string())
    keyed = _mixed(shorter[where[begin]] + _STEP * shard[begin].astype(np.uint64))
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(langs, pa.string()).take(pa.array(words.lang[where[begin]])),
            joined,
            pa.array(shard[begin], pa.int32()),
            pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(following))), " "),
            pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(n.astype("<u4"))]),
        ],
        ["lang", "prefix", "shard", "next", "n"],
    )
    return batch, keyed


def _bucketed(batch: pa.RecordBatch, bucket: np.ndarray) -> pa.RecordBatch:
    """A row for all stripes of a language and bucket."""
    lang = batch.column("lang").dictionary_encode()
    code = lang.indices.to_numpy().astype(np.int64)
    order = np.lexsort((bucket, code))
    batch, code, bucket = batch.take(pa.array(order)), code[order], bucket[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])
    begin = np.flatnonzero(new)
    ends = np.append(begin, len(code))
    lines = pc.binary_join_element_wise(batch.column("prefix"), batch.column("next"), "\t")
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines), "\n")
    shards = batch.column("shard").to_numpy()
    counts = batch.column("n")
    at = np.frombuffer(counts.buffers()[1], np.int32, len(counts) + 1, counts.offset * 4)
    held, codec, rows = memoryview(counts.buffers()[2]), pa.Codec(CODEC), []
    for text, first, last in zip(texts, begin, ends[1:], strict=True):
        chars = text.as_buffer()
        raw = b"".join((chars, shards[first:last].tobytes(), held[at[first] : at[last]]))
        rows.append((len(raw), chars.size, codec.compress(raw, asbytes=True)))
    sizes, chars, packed = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            lang.dictionary.take(pa.array(code[begin])),
            pa.array(bucket[begin], pa.int32()),
            pa.array(sizes, pa.int32()),
            pa.array(chars, pa.int32()),
            pa.array(packed, pa.binary()),
        ],
        ["lang", "bucket", "size", "chars", "stripes"],
    )


def _opened(lang: str, bodies: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
    """The stripes of a language and bucket, those of a key one after the other."""
    texts, shards, counts = [], [], []
    for raw, chars in bodies:
        rows = raw.count(b"\n", 0, chars) + 1
        texts.append(raw[:chars])
        shards.append(raw[chars : chars + 4 * rows])
        counts.append(raw[chars + 4 * rows :])
    bodies.clear()
    parts = pc.split_pattern(pc.split_pattern(pa.array([b"\n".join(texts)], pa.binary()).cast(pa.large_string()), "\n").flatten(), "\t").flatten()
    prefix, following = (parts.take(pa.array(np.arange(k, len(parts), 2))).cast(pa.string()) for k in (0, 1))
    shard = np.frombuffer(b"".join(shards), np.int32)
    lengths = pc.count_substring(following, " ").to_numpy().astype(np.int64) + 1
    held = pa.py_buffer(b"".join(counts))
    n = pa.Array.from_buffers(pa.binary(), len(shard), [None, pa.py_buffer((4 * ends_of(lengths)).astype(np.int32)), held])
    place = np.lexsort((prefix.dictionary_encode().indices.to_numpy(), shard))
    batch = pa.RecordBatch.from_arrays([pa.array([lang] * len(shard), pa.string()), prefix, pa.array(shard), following, n], [*KEY, "next", "n"])
    for at in range(0, len(place), MERGED):
        yield batch.take(pa.array(place[at : at + MERGED]))


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stripes of rows that come by language and bucket."""
    own, bodies, codec = None, [], pa.Codec(CODEC)
    for batch in batches:
        for lang, bucket, size, chars, packed in zip(*(batch.column(c).to_pylist() for c in ("lang", "bucket", "size", "chars", "stripes")), strict=True):
            if own is not None and own != (lang, bucket):
                yield from _opened(own[0], bodies)
                bodies = []
            own = lang, bucket
            bodies.append((codec.decompress(packed, size, asbytes=True), chars))
    if own is not None:
        yield from _opened(own[0], bodies)


def partial_stripes(docs: DataFrame, length: int, bits: Broadcast | None, shards: int, buckets: int = BUCKETS) -> DataFrame:
    """Stripes of single slices of the texts of ``docs`` (lang, text), a row for each bucket of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bits is None else tuple(np.frombuffer(b, np.uint8) for b in bits.value)
        for batch in batches:
            coded_langs = batch.column("lang").dictionary_encode()
            langs, code = coded_langs.dictionary.to_pylist(), coded_langs.indices.to_numpy(zero_copy_only=False)
            for at, part in slices(batch.column("text"), SLICE):
                found = _stripes(_Words(part, code[at : at + len(part)].astype(np.int64)), langs, length, held, shards)
                if found is not None:
                    yield _bucketed(found[0], (found[1] % np.uint64(buckets)).astype(np.int64))

    return docs.mapInArrow(run, BUCKETED)


def _unpacked(batch: pa.RecordBatch) -> tuple[pa.ListArray, pa.Array]:
    packed = batch.column("n")
    offsets = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, packed.offset * 4)
    counts = np.frombuffer(packed.buffers()[2], "<u4", (offsets[-1] - offsets[0]) // 4, offsets[0])
    return pc.split_pattern(batch.column("next"), " "), pa.array(counts.astype(np.int64))


def _merge(least: int, totals: bool):
    """Merge stripes (``PACKED``) that come key by key, entry by entry, and drop what stays below ``least``.

    With ``totals`` each stripe keeps the sum of all its entries as that of the empty
    text, which is no word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_next, open_n = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in KEY), strict=True))
            change = np.fromiter((k != before for k, before in zip(keys, [open_key, *keys], strict=False)), bool, len(keys))
            group = np.cumsum(change)
            names = ([open_key] if open_key is not None else []) + [keys[i] for i in np.flatnonzero(change)]
            if open_key is None:
                group -= 1
            lists, counts = _unpacked(batch)
            each = np.repeat(group, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            columns = [pa.array(each), lists.flatten(), counts]
            if open_key is not None:
                columns = [pa.concat_arrays(c) for c in zip([pa.array(np.zeros(len(open_n), np.int64)), open_next, open_n], columns, strict=True)]
            summed = pa.table(columns, ["g", "next", "n"]).group_by(["g", "next"], use_threads=False).aggregate([("n", "sum")]).sort_by("g").combine_chunks()
            last = pc.equal(summed["g"], len(names) - 1)
            closed, still = summed.filter(pc.invert(last)).combine_chunks(), summed.filter(last).combine_chunks()
            if len(names) > 1:
                yield _closed(names[:-1], closed, least, totals)
            open_key, open_next, open_n = names[-1], _one(still["next"]), _one(still["n_sum"])
        if open_key is not None:
            yield _closed([open_key], pa.table({"g": np.zeros(len(open_n), np.int64), "next": open_next, "n_sum": open_n}), least, totals)

    return run


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _closed(keys: list[tuple], summed: pa.Table, least: int, totals: bool) -> pa.RecordBatch:
    """The stripes of ``keys``, whose entries are in ``summed`` by ascending place of their key."""
    group = summed["g"].to_numpy()
    n, following = summed["n_sum"].to_numpy(), _one(summed["next"])
    if totals:
        sums = np.bincount(group, n, len(keys)).astype(np.int64)
        ready = np.append(n >= least, np.ones(len(keys), bool))
        group, n = np.append(group, np.arange(len(keys))), np.append(n, sums)
        following = pa.concat_arrays([following, pa.array([""] * len(keys), pa.string())])
        kept = np.flatnonzero(ready)
        kept = kept[np.argsort(group[kept], kind="stable")]
    else:
        kept = np.flatnonzero(n >= least)
    size = np.bincount(group[kept], minlength=len(keys))
    full = np.flatnonzero(size)
    ends = pa.array(ends_of(size[full]), pa.int32())
    own = list(zip(*(keys[i] for i in full), strict=True)) or [[], [], []]
    lists = [pa.ListArray.from_arrays(ends, following.take(pa.array(kept))), pa.ListArray.from_arrays(ends, pa.array(n[kept], pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(own[0], pa.string()), pa.array(own[1], pa.string()), pa.array(own[2], pa.int32()), *lists], [*KEY, "next", "n"])


def stripes(docs: DataFrame, length: int, bits: Broadcast | None, shards: int, least: int, buckets: int = BUCKETS) -> DataFrame:
    """The merged stripes of all prefixes of ``length - 1`` words."""
    dealt, merged = partial_stripes(docs, length, bits, shards, buckets).repartition("lang", "bucket"), _merge(least, length == 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merged(_ordered(batches))

    return dealt.sortWithinPartitions("lang", "bucket").mapInArrow(run, STRIPES)


def filter_bits(phrases: DataFrame, rows: int) -> bytes:
    """A filter of about ``rows`` phrases (lang, phrase): a power of two of bits, at most ``FILTER_BITS``."""
    size = 1 << max(15, min(FILTER_BITS, 16 * rows).bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            words = [t.split(" ") for t in batch.column("phrase").to_pylist()]
            hashes = _mixed(_hashes(batch.column("lang").to_pylist()))
            for k in range(len(words[0]) if words else 0):
                hashes = _mixed(hashes * _STEP + _hashes([w[k] for w in words]))
            at = hashes & np.uint64(size - 1)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        for i in range(0, len(bits), ROW_BYTES):
            part = bits[i : i + ROW_BYTES]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["at", "bits"])

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        both = reduce(np.bitwise_or, (np.frombuffer(b.as_py(), np.uint8) for b in table.column("bits")))
        return pa.table({"at": [key[0].as_py()], "bits": [both.tobytes()]})

    # A task may make the whole filter, so there are no more tasks than cores.
    cores = phrases.sparkSession.sparkContext.defaultParallelism
    schema = "at long, bits binary"
    found = phrases.select("lang", "phrase").coalesce(cores).mapInArrow(run, schema).groupBy("at").applyInArrow(merged, schema)
    out = bytearray(size // 8)
    for r in found.collect():
        out[r["at"] : r["at"] + len(r["bits"])] = r["bits"]
    return bytes(out)


def _key(lang: str, text: Column) -> Column:
    """A language and a phrase as one text; words hold no line ends."""
    return F.concat(text, F.lit("\n"), F.col(lang))


def counted(level: Staged, before: DataFrame | None, length: int) -> DataFrame:
    """(lang, phrase, a, lefts, rights): phrases of ``length`` words, with the counts of all their beginnings and rests.

    ``before`` has the phrases one word shorter. A beginning is the prefix or one of its
    beginnings, a rest the suffix or one of its rests, so one join each will do. Prefixes
    are joined to stripes, before these are opened.
    """
    opened = F.inline(F.arrays_zip("next", "n"))
    if before is None:
        none = F.array().cast("array<bigint>")
        return level.df.select("lang", opened).filter(F.col("next") != "").select("lang", F.col("next").alias("phrase"), F.col("n").alias("a"), none.alias("lefts"), none.alias("rights"))
    shorter = before.withColumn("key", _key("lang", F.col("phrase")))
    left = shorter.select(F.col("key").alias("left"), F.concat("lefts", F.array("a")).alias("lefts"))
    right = shorter.select(F.col("key").alias("right"), F.concat(F.array("a"), "rights").alias("rights"))
    begun = uneven_join(level.df.withColumn("left", _key("lang", F.col("prefix"))), left, "left").select("lang", "prefix", "lefts", opened)
    named = begun.select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("n").alias("a"), "lefts")
    rest = F.substring_index("phrase", " ", 1 - length)
    return uneven_join(named.withColumn("right", _key("lang", rest)), right, "right").select("lang", "phrase", "a", "lefts", "rights")


def longer(level: Staged, phrases: DataFrame, length: int) -> DataFrame:
    """(key, most): the largest entry of each prefix's stripe of a level, and that of each suffix."""
    after = level.df.select(_key("lang", F.col("prefix")).alias("key"), F.array_max("n").alias("most"))
    ahead = phrases.select(_key("lang", F.substring_index("phrase", " ", 1 - length)).alias("key"), F.col("a").alias("most"))
    return after.unionByName(ahead).groupBy("key").agg(F.max("most").alias("most"))


def cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a * 1000) * wide(n), wide(left) * wide(right))


def weakest(phrases: DataFrame) -> DataFrame:
    """``phrases`` (with the total ``n``) with l, r and score of the cut that scores lowest, the first of them."""
    cuts = F.transform(
        F.arrays_zip("lefts", "rights"),
        lambda c, k: F.struct(cut_score(F.col("a"), F.col("n"), c["lefts"], c["rights"]).alias("score"), k.alias("k"), c["lefts"].alias("l"), c["rights"].alias("r")),
    )
    cut = F.array_min(cuts)
    return phrases.withColumn("cut", cut).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases (lang, rank, phrase, a, l, r, n, score) of each language.

    A phrase of 2 to ``longest`` words that occurs ``least`` times scores by its weakest
    cut; one that never stands outside a longer one is left out.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), whole(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards, bits, before, totals, kept = -(-size // SHARD_BYTES) or 1, None, None, None, []
    buckets = BUCKETS + size // BUCKET_BYTES
    for length in range(1, longest + 1):
        level = stage(stripes(own, length, bits, shards, least, buckets), "stripes")
        phrases = stage(counted(level, before.df if before else None, length), "phrases")
        if bits is not None:
            bits.unpersist()
        if length == 1:
            opened = level.df.select("lang", F.inline(F.arrays_zip("next", "n")))
            totals = stage(opened.filter(F.col("next") == "").groupBy("lang").agg(F.sum("n").alias("total")), "totals")
            shards = max(1, -(-phrases.rows // SHARD))
        if length > 2:
            kept.append(stage(_outside(before.df, longer(level, phrases.df, length)), "outside").df)
        remove(spark, level.path)
        before = phrases
        if length == longest or not phrases.rows:
            break
        # Fewer than one in sixteen phrases is hot, or the filter is fuller.
        hot = filter_bits(phrases.df.filter(F.col("a") >= HOT), phrases.rows // 16)
        bits = spark.sparkContext.broadcast((filter_bits(phrases.df, phrases.rows), hot))
    kept.append(before.df if length > 1 else before.df.limit(0))
    every = reduce(DataFrame.unionByName, kept)
    total = Staged(totals.df.withColumnRenamed("total", "n"), totals.rows, totals.path)
    scored = weakest(lookup_join(every, total, ["lang"]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _outside(phrases: DataFrame, most: DataFrame) -> DataFrame:
    """The phrases that also stand outside of every longer one."""
    joined = phrases.withColumn("key", _key("lang", F.col("phrase"))).join(most, "key", "left")
    return joined.filter(F.coalesce(F.col("most") < F.col("a"), F.lit(True))).select(*phrases.columns)
