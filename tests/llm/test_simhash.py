from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripgrid.llm import simhash
from tripgrid.llm.graph import components


def plain(text, shingle=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))] if words else []
    count = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for i in range(64):
            count[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * count[i] > len(grams))


def closure(prints, radius):
    """Smallest index reached from each of ``prints``, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(prints))]


@given(st.text(alphabet="aAbB \n\tÉé\x0b", max_size=60))
@settings(max_examples=200)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_components_equal_brute_force(spark, docs, texts):
    rows = simhash.near_duplicates(docs).collect()
    ids = sorted(texts)
    prints = [plain(texts[i]) for i in ids]
    want = closure(prints, 2)
    assert {r["doc_id"]: (r["fingerprint"] % (1 << 64), r["component_id"]) for r in rows} == {
        i: (prints[k], ids[want[k]]) for k, i in enumerate(ids)
    }
    kept = sorted(r["doc_id"] for r in simhash.keep_first(docs).collect())
    assert kept == sorted({ids[k] for k in want})


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_close_over_every_pair(spark, radius):
    rng = np.random.default_rng(radius)
    base = [int(x) for x in rng.integers(0, 1 << 62, 12)]
    prints = set(base)
    for b in base:
        for n in range(1, 6):
            v = b
            for bit in rng.choice(64, n, replace=False):
                v ^= 1 << int(bit)
            prints.add(v)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    found = {r["node"]: r["root"] for r in components(simhash.links(df, radius)).collect()}
    want = closure([p % (1 << 64) for p in prints], radius)
    assert {p: found.get(p, p) for p in prints} == {p: prints[w] for p, w in zip(prints, want, strict=True)}


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(300)]
    rng = np.random.default_rng(0)
    label = rng.permutation(1000).tolist()
    edges = [(label[a], label[b]) for a, b in chain + star] + [(-5, -5), (None, 3), (label[0], label[1])]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    sizes = Counter(r["root"] for r in found.collect())
    assert sorted(sizes.values()) == [41, 301]
    assert found.filter(F.col("root") > F.col("node")).count() == 0


def test_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert len(by_id[1]) == 2 and {r["component_id"] for r in by_id[1]} == {1}
    # Null, empty and blank texts share the fingerprint zero.
    assert [(by_id[i][0]["fingerprint"], by_id[i][0]["component_id"]) for i in (2, 3, 4)] == [(0, 2)] * 3
    assert by_id[None][0]["component_id"] is None
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "None", "5", "6", "7", "8"])


def test_empty_table(odd):
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    assert simhash.keep_first(odd.limit(0)).count() == 0
