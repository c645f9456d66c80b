import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tripgrid.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        best, inside = [], Counter()
        for q, a in held.items():
            for p in {q[i:j] for i in range(len(q)) for j in range(i + 2, len(q) + 1)} - {q}:
                inside[p] = max(inside[p], a)
        for p, a in held.items():
            if 100 * inside[p] >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize(("least", "shard", "top"), [(5, 3, 40)])
def test_documents(docs, monkeypatch, least, shard, top):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "HOT", 4 * least)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    want = plain(rows, least, top=top)
    assert len({len(w[2].split(" ")) for w in want}) > 2
    assert found(phrases.collocations(docs, least=least, top=top)) == want


def test_long_stripes_and_small_slices(docs, monkeypatch):
    monkeypatch.setattr(phrases, "ROW_ENTRIES", 2)
    monkeypatch.setattr(phrases, "SLICE", 5000)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 20_000)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert found(phrases.collocations(docs, least=10)) == plain(rows, 10)


def test_overlaps_ends_and_whole_phrases(spark):
    texts = ["a a a a", "new york city. New York, city", "x\ty;x y!x  y?x y:x y", "p q r s t u v", "p q r s t u v", "a. a", None, ""]
    docs = spark.createDataFrame([(None if i % 2 else "en", t) for i, t in enumerate(texts * 3)], "lang string, text string")
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert found(phrases.collocations(docs, least=2)) == plain(rows, 2)


def test_merge_meets_keys_over_batches():
    def batch(rows):
        rows = [(*r[:3], " ".join(r[3]), np.array(r[4], "<u4").tobytes()) for r in rows]
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*phrases.KEY, "next", "n"])

    given = [
        [("en", "a", 0, ["x", "y"], [1, 2]), ("en", "a", 0, ["x"], [3])],
        [("en", "a", 0, ["z", "x"], [5, 1]), ("en", "b", 0, ["x"], [1])],
        [("en", "b", 1, ["x"], [9])],
    ]
    out = [r for b in phrases._merge(2, False)(iter(map(batch, given))) for r in b.to_pylist()]
    assert [(r["prefix"], r["shard"], dict(zip(r["next"], r["n"]))) for r in out] == [("a", 0, {"x": 5, "y": 2, "z": 5}), ("b", 1, {"x": 9})]
    out = [r for b in phrases._merge(3, True)(iter(map(batch, given))) for r in b.to_pylist()]
    assert [dict(zip(r["next"], r["n"])) for r in out] == [{"x": 5, "z": 5, "": 12}, {"": 1}, {"x": 9, "": 9}]


def test_stripes_travel_as_rows_of_buckets(spark):
    """A slice sends a row for each language and bucket, in which no stripe is lost."""
    texts = [" ".join(f"w{(i * j) % 61}é" for j in range(1, 90)) + f" a{i}. b {i}" for i in range(60)]
    rows = [("en" if i % 3 else "d\te\n", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    sent = phrases.partial_stripes(docs, 2, _every_phrase(spark), 3, 5).toPandas()
    assert len(sent) <= 2 * 2 * 5 and not sent.duplicated(["lang", "bucket", "stripes"]).any()
    want = defaultdict(Counter)
    for lang, text in rows:
        for piece in text.split("."):
            words = piece.split()
            for pair in zip(words, words[1:]):
                want[lang, pair[0]][pair[1]] += 1
    got, places, keys = defaultdict(Counter), defaultdict(set), []
    sent = sent.sort_values(["lang", "bucket"])
    for (lang, bucket), own in sent.groupby(["lang", "bucket"]):
        for batch in phrases._ordered(iter([pa.RecordBatch.from_pandas(own, preserve_index=False)])):
            for r in batch.to_pylist():
                key = r["lang"], r["prefix"], r["shard"]
                places[key].add(bucket)
                keys += [] if keys and keys[-1] == key else [key]
                for word, n in zip(r["next"].split(" "), np.frombuffer(r["n"], "<u4"), strict=True):
                    got[r["lang"], r["prefix"]][word] += int(n)
    assert got == want
    assert all(len(p) == 1 for p in places.values()) and len(keys) == len(set(keys))
    assert len({k[2] for k in keys}) == 3


def _every_phrase(spark):
    return spark.sparkContext.broadcast((b"\xff" * 4096, b"\xff" * 4096))


def test_scores_beyond_64_bits(spark):
    big = 10**15
    rows = [("en", "a b", big, 9 * 10**15, [2 * big, big], [3 * big, big])]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, n long, lefts array<bigint>, rights array<bigint>")
    r = phrases.weakest(df).first()
    assert r["score"] == 1000 * big * 9 * 10**15 // (2 * big * 3 * big) and (r["l"], r["r"]) == (2 * big, 3 * big)


def test_filter_lets_every_frequent_phrase_pass(spark):
    held = [("en", f"w{i} v{i % 7}") for i in range(3000)] + [("de", f"w{i} v{i % 7}") for i in range(50)]
    bits = np.frombuffer(phrases.filter_bits(spark.createDataFrame(held, "lang string, phrase string"), len(held)), np.uint8)
    assert len(bits) & (len(bits) - 1) == 0
    for lang, text in held[::37]:
        words = phrases._hashes(text.split(" "))
        code = phrases._hashes([lang] * 2)
        assert phrases._passes(bits, phrases.phrase_hashes(words, code, 2)).all()
    assert np.unpackbits(bits).mean() < 0.2


def test_odd_rows(odd):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert found(phrases.collocations(odd, least=2)) == plain(rows, 2)
    assert phrases.collocations(odd, least=10**6).count() == 0
    assert phrases.collocations(odd.limit(0)).count() == 0
