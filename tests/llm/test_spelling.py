import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tripgrid.llm import spelling
from tripgrid.session import stage

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, least, spoil):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                out[run] += 1
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n, times=5):
    near = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    forms = {}
    for w, held in near.items():
        best = min(held, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best and n[best] >= times * n[w] else None
    rows = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n[w], len(near[w]), n[forms[w]] if forms[w] else None))
    return sorted(rows)


def found(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


@pytest.mark.parametrize("spoil", [None, 7])
def test_counts_of_documents(docs, texts, spoil):
    rows = spelling.word_counts(docs, least=4, count=2, spoil=spoil).collect()
    want = {w: n for w, n in plain_counts(texts.items(), 4, spoil).items() if n >= 2}
    assert {r["word"]: r["n"] for r in rows} == want


def test_documents(docs, texts):
    n = plain_counts(texts.items(), 5, 199)
    n = {w: c for w, c in n.items() if c >= 4}
    words = spelling.word_counts(docs, least=5, count=4, spoil=199)
    assert len(n) > 300
    assert found(spelling.variants(words)) == plain_variants(n)


@pytest.mark.parametrize("letters", ["ab", "abé\U0001f600"])
def test_words_of_few_letters(spark, letters):
    """Many repeated letters, anagrams and long chains of forms."""
    rng = np.random.default_rng(3)
    n = {"".join(rng.choice(list(letters), rng.integers(1, 7))): int(5 ** rng.uniform(0, 4)) for _ in range(60)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert found(spelling.variants(words)) == plain_variants(n)


def test_every_near_pair_shares_a_signature():
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklméÿ"))
    for size in (6, 7, 12, 40):
        for _ in range(60):
            word = "".join(rng.choice(letters, size))
            at = int(rng.integers(size))
            for other in (word[:at] + "z" + word[at + 1 :], word[:at] + word[at + 1 :], word[:at] + "a" + word[at:]):
                held = spelling._Letters([word, other])
                kind = [(spelling.PARTS_SAME, 2, held.size)] if len(other) == size else [(spelling.PARTS_NEXT, 1, np.minimum(size, len(other)) + 0 * held.size)]
                for parts, out, shorter in kind:
                    sides = zip(spelling._halves(held, shorter), ("first", "last"))
                    assert any(h[0] == h[1] for h, _ in sides)
                    assert any(p[0] == p[1] for p in spelling._projections(held, {}, parts, out))


def test_chains_and_ties(spark):
    n = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aaaaac": 5, "zzzzzz": 9}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    rows = {r[0]: r for r in found(spelling.variants(words))}
    assert rows["aaaaaa"][1:3] == ("aaaaab", "aaabbb")
    assert rows["zzzzzz"] == ("zzzzzz", None, "zzzzzz", 9, 0, None)
    linked = stage(spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(50)], "word string, form string"), "t")
    assert {r["root"] for r in spelling.roots(linked).collect()} == {"w050"}


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    words = spelling.word_counts(odd, least=3, count=1, spoil=3)
    n = plain_counts(rows, 3, 3)
    assert {r["word"]: r["n"] for r in words.collect()} == n
    assert found(spelling.variants(words)) == plain_variants(n)
    assert spelling.variants(spelling.word_counts(odd.limit(0))).count() == 0
