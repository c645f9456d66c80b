import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripgrid.llm import lm

def is_held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check_base(rows, given):
    """Counts and base scores of (doc_id, text) pairs by the formula."""
    count = Counter()
    for doc_id, text in given:
        if not held_out(doc_id):
            count.update(words(text))
    n, v = sum(count.values()), len(count)
    want = []
    for doc_id, text in given:
        w = words(text)
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        want.append((str(doc_id), held_out(doc_id), len(w), sum(count[x] > 0 for x in w), n, round(base, 6)))
    found = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows]
    assert sorted(found) == sorted(want)


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs.collect(), lm.score(docs, is_held_out()).collect()


def test_counts_and_base_scores(scored):
    docs, rows = scored
    check_base(rows, [(d["doc_id"], d["text"]) for d in docs])


def test_held_out_texts_score_above_word_counts(scored):
    _, rows = scored
    total = lambda c: sum(r[c] for r in rows if r["held_out"])
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert total("score") > total("base_score")


@pytest.mark.parametrize("common", [2, 50, 10**6])
def test_common_and_joined_words_agree(spark, docs, texts, monkeypatch, common):
    monkeypatch.setattr(lm, "COMMON", common)
    check_base(lm.score(docs, is_held_out()).collect(), list(texts.items()))


def test_small_counting_memory(spark, docs, texts, monkeypatch):
    counts = {r["word"]: (r["c"], r["a"]) for r in lm.count_words(docs.withColumn("held_out", is_held_out())).collect()}
    monkeypatch.setattr(lm, "COUNTED", 5)
    again = {r["word"]: (r["c"], r["a"]) for r in lm.count_words(docs.withColumn("held_out", is_held_out())).collect()}
    assert counts == again and counts[lm.END][1] == len(texts)


def test_probabilities_are_normalised(spark):
    weights = np.arange(1.0, lm.OWN + lm.RARE + 1)
    model = lm.Model.start(weights)
    model.context *= 10
    z = lm.normalisers(spark, model)
    every = np.arange(len(weights))
    for a, b in [(0, 0), (5, 900), (len(weights), len(weights)), (3, len(weights))]:
        logs = lm.log_probabilities(model, z, every, np.tile([a, b], (len(every), 1)))
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-3)


def test_shares_within_a_class_sum_to_one(spark, docs):
    counts = lm.count_words(docs.withColumn("held_out", is_held_out())).cache()
    vocab = lm.vocabulary(counts)
    own = set(vocab.words[: lm.OWN])
    mass = Counter()
    for r in counts.filter("c > 0").collect():
        if r["word"] not in own:
            mass[lm.rare_class(r["word"])] += r["c"] + 1
    assert vocab.words[0] == lm.END
    for k in range(lm.OWN, lm.OWN + lm.RARE):
        assert vocab.masses[k] == mass[k] + 1


def test_contexts():
    classes, ends = np.array([4, 5, 6, 7, 8]), np.array([3, 4, 5])
    assert lm.contexts_of(classes, ends, 9).tolist() == [[9, 9], [4, 9], [5, 4], [9, 9], [9, 9]]


def test_training_learns_pairs(monkeypatch):
    monkeypatch.setattr(lm, "NOISE", 8)
    monkeypatch.setattr(lm, "RATE", 0.1)
    weights = np.array([100.0, 100.0, 100.0])
    model = lm.Model.start(weights)
    trainer = lm.Trainer(model, model.squares(), weights, 1)
    classes = np.array([0, 1, 2] * 200)
    contexts = lm.contexts_of(classes, np.array([600]), 3)
    for _ in range(60):
        trainer.step(contexts, classes)
    scores = model.hidden(np.array([[0, 2], [1, 0], [2, 1]])) @ model.next.T + model.bias[:, 0]
    assert scores.argmax(axis=1).tolist() == [1, 2, 0]


TEXTS = ["", " \t\n\r\x0b\x0c ", "  a  B\xa0 c\x85 ÉTÉ A\x1cB\x00 ", "a a b", "x\u3000y Z 😀\n", "A"]


def test_tokens():
    whole = pa.array(["zz", *TEXTS, "zz"]).slice(1, len(TEXTS))
    codes, found_words, ends = lm.tokens(whole)
    found = [found_words[c].as_py() for c in codes]
    assert [found[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [
        [lm.END if w is None else w.encode() for w in words_of] for words_of in map(words, TEXTS)
    ]


class Direct:
    """Stands for a table, so that a step over batches runs here."""

    def __init__(self):
        self.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value)))

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def test_words_are_looked_up_once_for_many_occurrences(monkeypatch):
    calls = []
    plain = lm.rare_class
    monkeypatch.setattr(lm, "rare_class", lambda word: calls.append(word) or plain(word))
    monkeypatch.setattr(lm, "OWN", 2)
    vocab = lm.Vocabulary([lm.END, b"own", b"common", b"held"], np.array([3, 9, 4, 0]), None, None, 16, 3)
    texts = ["rare own " * 500, "", "Other rare held common common x own"]
    columns = [pa.array([7, 8, 9]), pa.array([1, None, 3]), pa.array([False, True, False]), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "text"])
    rows = pa.Table.from_batches(lm.encode(Direct(), vocab).run(iter([batch]))).to_pylist()
    # Once each: "rare", "other" and "x", and "common" and "held" in the vocabulary.
    assert len(calls) <= 5
    for row, doc_id, held, text, got in zip([7, 8, 9], [1, None, 3], [False, True, False], texts, rows, strict=True):
        w = [lm.END if x is None else x.encode() for x in words(text)]
        count = dict(zip(vocab.words, vocab.counts.tolist(), strict=True))
        log = {x: math.log10(c + 1) for x, c in count.items()}
        assert (got["row"], got["doc_id"], got["held_out"], got["n_tokens"]) == (row, doc_id, held, len(w))
        own = {x: i for i, x in enumerate(vocab.words[:2])}
        assert np.frombuffer(got["classes"], np.uint16).tolist() == [own.get(x, plain(x)) for x in w]
        assert got["known"] == sum(count.get(x, 0) > 0 for x in w)
        assert got["logs"] == pytest.approx(sum(log.get(x, 0) for x in w))
        assert got["rare_logs"] == pytest.approx(sum(log.get(x, 0) for x in w if x not in own))
        assert {r["word"]: r["n"] for r in got["rare"]} == Counter(x for x in w if x not in count)


def test_training_step_by_the_formula():
    """Two steps against the gradients written out row by row, in double precision."""
    weights = np.array([50.0, 30.0, 10.0, 5.0, 0.0])
    model = lm.Model.start(weights)
    trainer = lm.Trainer(model, model.squares(), weights, 3)
    p = {name: x.astype(float) for name, x in model.parts().items()}
    squares = {name: x.astype(float) for name, x in model.squares().items()}
    rng, share = np.random.default_rng(3), (weights + 1) / (weights + 1).sum()
    classes = np.array([0, 1, 1, 2, 0, 3, 4, 0, 1])
    contexts = lm.contexts_of(classes, np.array([4, 9]), 5)
    for _ in range(2):
        trainer.step(contexts, classes)
        noise = np.searchsorted(np.cumsum(share), rng.random(lm.NOISE) * np.cumsum(share)[-1])
        grad = {name: np.zeros(x.shape) for name, x in p.items()}
        for near, target in zip(contexts, classes, strict=True):
            hidden = sum(p["context"][c] * p["scale"][i] for i, c in enumerate(near))
            dhidden = np.zeros(lm.WIDTH)
            for k, true in [(target, True), *((k, False) for k in noise)]:
                score = hidden @ p["next"][k] + p["bias"][k, 0] - math.log(lm.NOISE * share[k])
                up = (true - 1 / (1 + math.exp(-score))) / len(classes)
                grad["next"][k] += up * hidden
                grad["bias"][k] += up
                dhidden += up * p["next"][k]
            for i, c in enumerate(near):
                grad["context"][c] += dhidden * p["scale"][i]
                grad["scale"][i] += dhidden * p["context"][c]
        for name, g in grad.items():
            squares[name] += g * g
            p[name] += lm.RATE * g / np.sqrt(squares[name])
    for name, x in model.parts().items():
        assert np.allclose(x, p[name], atol=1e-3), name
        assert np.allclose(trainer.squares[name], squares[name], rtol=1e-3, atol=1e-7), name


def test_odd_rows(odd):
    rows = lm.score(odd, is_held_out()).collect()
    check_base(rows, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert all(math.isfinite(r["score"]) for r in rows)
    assert lm.score(odd.limit(0), is_held_out()).count() == 0
