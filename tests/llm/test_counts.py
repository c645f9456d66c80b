import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tripgrid.llm import counts
from tripgrid.llm.tokens import chunks, load, merged

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
HARD = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "it's, 'tis.  x\n\n y", " a b été. 中文 .,", "x" * 5000, "1.5,a,b.c \t. "]


def plain(text):
    return len((text or "").encode()), len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)


@given(st.text(alphabet=" \n\t\r\x0b\x1c\x85\xa0 ​abXY09,.'é×中\U0001f600ª<|>s", max_size=60))
@settings(max_examples=200, deadline=None)
def test_pretokens_are_the_tokenizers(text):
    splitter = counts.Splitter(PATH)
    code, names, _ = chunks(pa.array([text]))
    begin, found, marks = splitter.table(names)
    held = [p for c in code for p in found[begin[c] : begin[c + 1]]]
    want = [text[a:b] for _, (a, b) in splitter.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    if "<|endoftext|>" not in text:
        assert held == want and not marks.any()
    assert sum(len(merged(load(PATH), p)) for p in held) + int(marks[code].sum()) == plain(text)[1]


@pytest.mark.parametrize("most", [counts.FREQUENT, 50, 0])
def test_every_document(docs, texts, most):
    """The number of broadcast pre-tokens decides the way they take, not the counts."""
    rows = counts.count(docs, PATH, most=most, sample_rows=50).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows} == {i: plain(t) for i, t in texts.items()}
    assert len(rows) == len(texts)


def test_each_rare_pretoken_is_counted_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"rare{i % 3} word rare{i % 3}") for i in range(40)], "doc_id long, text string")
    slots = counts.frequencies(docs.coalesce(1), PATH, {" word": 1})
    rare = slots.filter("pretoken is not null").collect()
    assert {r["pretoken"] for r in rare} == {f"{s}rare" for s in ("", " ")} | {"0", "1", "2"}
    assert all(r["n"] == (2 if r["pretoken"].isdigit() else 1) for r in rare)
    seen = []
    monkeypatch.setattr(counts, "merged", lambda tokenizer, p: seen.append(p) or merged(tokenizer, p))
    batches = [
        pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.nulls(2, pa.int64()), pa.nulls(2, pa.int64()), pa.array(p, pa.string()), pa.array([1, 3])], ["row", "doc_id", "n_bytes", "pretoken", "n"])
        for p in ([None, " a"], [" a", " abcdefgh"], [" abcdefgh", " z"])
    ]
    out = [n for b in counts._weighed(PATH)(iter(batches)) for n in b.column("n").to_pylist()]
    size = len(merged(load(PATH), " abcdefgh"))
    assert seen == [" a", " abcdefgh", " z"] and out == [1, 3, 1, 3 * size, size, 3]


def test_odd_rows(spark, odd):
    rows = counts.count(odd, PATH, most=10).collect()
    want = sorted((r["doc_id"] or -1, *plain(r["text"])) for r in odd.collect())
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert counts.count(odd.limit(0), PATH).count() == 0
    hard = spark.createDataFrame(list(enumerate(HARD)), "doc_id int, text string")
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in counts.count(hard, PATH).collect()}
    assert found == {i: plain(t) for i, t in enumerate(HARD)}
