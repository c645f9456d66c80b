import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripgrid.llm import ann

def asked():
    return F.col("vec_id") % 20 == 0


def exact(rows, k=20):
    """The k nearest of every query by comparing all, ties by id."""
    best = {}
    good = [(i, np.array(v, float)) for i, v in rows if i is not None]
    for q, v in good:
        if q % 20:
            continue
        scores = {}
        for i, x in good:
            if i != q:
                scores[i] = max(scores.get(i, -math.inf), float(sum(a * b for a, b in zip(v, x))))
        best[q] = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
    return best


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    return df, [(r["vec_id"], r["embedding"]) for r in df.collect()]


def recall(found, want):
    hit = sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hit / sum(map(len, want.values()))


def test_recall_and_scores(vectors):
    df, rows = vectors
    found, want = answers(ann.search(df, asked())), exact(rows)
    assert set(found) == set(want)
    assert recall(found, want) >= 0.9
    by_id = dict(rows)
    for q, hits in found.items():
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))
        for i, score in hits:
            assert score == pytest.approx(float(np.dot(np.array(by_id[q], float), np.array(by_id[i], float))), abs=1e-12)


@pytest.mark.parametrize("block", [7, 100])
def test_all_probes_give_the_exact_answer(vectors, block):
    df, rows = vectors
    found = answers(ann.search(df, asked(), tables=1, probes=10**6, block=block))
    want = exact(rows)
    assert {q: [i for i, _ in h] for q, h in found.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_norms_that_differ(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 24)) * rng.uniform(0.2, 3, (600, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = answers(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), asked(), probes=24))
    assert recall(found, exact(rows)) >= 0.9


def test_hot_vector_ties_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(6)
    same = rng.normal(size=16).tolist()
    rows = [(i, same) for i in range(300)] + [(300 + i, rng.normal(size=16).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = answers(ann.search(df, asked(), block=32))
    assert [i for i, _ in found[40]] == [i for i in range(22) if i != 40][:20]


def test_hash_is_the_nearest_signed_axis():
    turn = ann.Rotations(48, 2, 1)
    x = np.random.default_rng(0).normal(size=(50, 48))
    z = turn.turned(x, 1)
    assert turn.size == 64 and np.allclose((z * z).sum(axis=1), (x * x).sum(axis=1))
    axes = np.stack((z, -z), axis=2).reshape(50, -1)
    assert (turn.bucket(x, 1) == axes.argmax(axis=1)).all()
    assert (turn.probes(x, 1, 1)[:, 0] == axes.argmax(axis=1)).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "a", 1), (20, [0.0, 2.0], "b", 2), (20, [0.0, 2.0], "b", 2), (40, None, "c", 3), (60, [0.0, 0.0], "d", 4),
        (80, [nan, 1.0], "e", 5), (100, [inf, 1.0], "f", 6), (120, [None, 1.0], "g", 7), (None, [1.0, 1.0], "h", 8), (140, [1.0, 2.0, 3.0], "i", 9),
        (160, [], "j", 10), (3, [1.0, 1.0], "k", 11), (3, [2.0, 1.0], "k", 11),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string, rank int")
    found = answers(ann.search(df, asked(), probes=4))
    assert found == {0: [(3, 2.0), (20, 0.0)], 20: [(3, 2.0), (0, 0.0)]}
    assert ann.search(df.limit(0), asked()).count() == 0
    assert ann.search(df.filter("vec_id = 60"), asked()).count() == 0
    assert ann.search(df.filter("vec_id = 0"), asked()).count() == 0


@pytest.mark.parametrize("n", [5, 21])
def test_few_vectors_are_all_found(spark, n):
    x = np.random.default_rng(7).normal(size=(n, 64))
    rows = [(20 * i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    found = answers(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), asked()))
    assert {q: [i for i, _ in h] for q, h in found.items()} == {q: [i for i, _ in w] for q, w in exact(rows).items()}
