import numpy as np
import pytest
from test_credentials import covered
from test_mixing import chosen, key_of
from test_packing import check, ids_of
from test_quality import measured, rejected
from test_simhash import closure, plain

import corpus_pipeline as cp
from tripgrid.llm import mixing, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def domain(source):
    return "forum" if source in queries.FORUMS else "books" if source in queries.BOOKS else "web"


def brute(rows):
    """The rows that each stage but the last leaves of (doc_id, text, lang, source, n_chars), by plain loops."""
    rows = [r for r in rows if not rejected(measured(r[1]))]
    yield rows
    rows = sorted(rows, key=lambda r: r[0])
    root = closure([plain(r[1]) for r in rows], 2)
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    yield rows
    clean = [(r[0], covered(r[1]), *r[2:]) for r in rows]
    rows = [(*c[:4], len(c[1]) if c[1] != r[1] else r[4]) for c, r in zip(clean, rows)]
    yield rows
    mix = mixing.Mix(weights=queries.MIX.weights)
    copies = chosen([(r[0], r[1], domain(r[3]), r[2], r[3]) for r in rows], mix, key_of(mix))
    yield [r for r, c in zip(rows, copies) for _ in range(c)]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(COLUMNS)
    out, df = [], docs
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage"))
        stage(spark, df, sf).write.mode("overwrite").parquet(path)
        out.append(df := spark.read.parquet(path))
    return docs, out


def test_every_stage_equals_brute_force(stages):
    docs, out = stages
    given = [tuple(r) for r in docs.collect()]
    for df, want in zip(out, brute(given)):
        assert df.columns == COLUMNS
        assert sorted(map(tuple, df.collect())) == sorted(want)
        assert 0 < len(want)


def test_sequences_hold_every_id(stages):
    _, out = stages
    want = [ids_of(r["text"]) for r in out[3].collect()]
    pieces = out[4].collect()
    assert sum(p["length"] for p in pieces) == sum(map(len, want))
    short = sorted(bytes(p["ids"]) for p in pieces if p["start"] == 0)
    assert short == sorted(np.array(w[: len(w) % 1024 or 1024], "<u4").tobytes() for w in want)
    # Documents that are taken once meet the whole check of places.
    seen = [r["doc_id"] for r in out[3].collect()]
    once = {r["doc_id"]: r["text"] for r in out[3].collect() if seen.count(r["doc_id"]) == 1}
    check([p for p in pieces if p["doc_id"] in once], once)


def test_run_gives_the_last_stage(spark, sf, stages):
    _, out = stages
    digest = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in df.collect())
    assert digest(cp.run(spark, sf)) == digest(out[4])


def test_odd_documents(spark, odd, sf, tmp_path):
    for docs in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, sf)
            if k < len(cp.STAGES) - 1:
                assert out.columns == docs.columns
            path = str(tmp_path / f"{k}-{docs is odd}")
            out.write.mode("overwrite").parquet(path)
        assert spark.read.parquet(path).count() >= 0
