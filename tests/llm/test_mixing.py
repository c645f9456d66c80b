import re
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from tripgrid.llm import mixing, queries

LEVELS = ("domain", "lang", "source")


def md5_of(*parts):
    return md5("|".join(parts).encode()).hexdigest()


def weight(mix, path):
    out = 1.0
    for node, w in mix.weights.items():
        if len(node) == len(path) and all(a is ... or a == b for a, b in zip(node, path)):
            out = float(w)
    return out


def poured(caps, weights, budget):
    """Shares of siblings: fill all by weight, fix those that overflow, and share the rest anew."""
    share, open_ = {}, dict(weights)
    while open_:
        level = budget / sum(open_.values())
        full = [k for k in open_ if caps[k] <= level * open_[k]]
        if not full:
            return share | {k: level * w for k, w in open_.items()}
        for k in full:
            share[k] = caps[k]
            budget -= caps[k]
            del open_[k]
    return share


def chosen(rows, mix, seed_key):
    """Copies of each row by the rules, with loops; rows are (doc_id, text, domain, lang, source)."""
    n = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    use = [i for i, r in enumerate(rows) if all(weight(mix, r[2 : 3 + d]) > 0 for d in range(3))]
    tokens = defaultdict(int)
    for i in use:
        for d in range(4):
            tokens[tuple(rows[i][2 : 2 + d])] += n[i]
    nodes = {tuple(rows[i][2 : 2 + d]) for i in use for d in range(1, 4)}
    shares = {(): float(tokens[()] if mix.budget is None else mix.budget)}
    for d in range(1, 4):
        for parent in [p for p in shares if len(p) == d - 1]:
            kids = [k for k in nodes if len(k) == d and k[: d - 1] == parent]
            shares |= poured({k: float(tokens[k] * mix.epochs) for k in kids}, {k: weight(mix, k) for k in kids}, shares[parent])
    copies = [0] * len(rows)
    for leaf in [k for k in shares if len(k) == 3]:
        members = [i for i in use if tuple(rows[i][2:5]) == leaf]
        if not tokens[leaf]:
            continue
        epochs, rest = divmod(int(shares[leaf] + 1e-9), tokens[leaf])
        place = defaultdict(list)
        for i in members:
            place[seed_key(epochs, rows[i])].append(i)
        done, going = 0, True
        for key in sorted(place):
            done += sum(n[i] for i in place[key])
            going = going and done <= rest
            for i in place[key]:
                copies[i] = epochs + going
    return copies


def key_of(mix):
    def key(epoch, r):
        own = md5_of("null" if r[0] is None else str(r[0]), r[1] or "")
        return md5_of(str(mix.seed), str(epoch), own)

    return key


def compare(spark, rows, mix):
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string")
    taken, copies = mixing.choose(df, mix)
    found = Counter()
    for r in taken.collect():
        found[(r["doc_id"], r["text"], r["domain"], r["lang"], r["source"], r[copies])] += 1
    want = Counter((*r, c) for r, c in zip(rows, chosen(rows, mix, key_of(mix))) if c)
    assert found == want
    return want


@pytest.mark.parametrize("budget, epochs", [(None, 2), (2000, 1), (50_000, 3), (10**9, 2), (0, 2)])
def test_documents(spark, docs, budget, epochs):
    rows = [(r["doc_id"], r["text"], "w" if int(r["source"][3:]) < 10 else "f", r["lang"], r["source"]) for r in docs.collect()]
    mix = mixing.Mix(weights={("w",): 3, ("f",): 1, (..., "en"): 6, ("f", "de"): 0, (..., ..., "src0"): 5}, budget=budget, epochs=epochs)
    want = compare(spark, rows, mix)
    taken = sum(len(re.findall(r"[^\x20\x09-\x0D]+", k[1])) * k[-1] * n for k, n in want.items())
    if budget is not None:
        assert taken <= budget
    if budget == 10**9:
        assert all(k[-1] == epochs for k in want)


def test_shortages_stay_among_siblings():
    assert poured({"a": 10.0, "b": 100.0, "c": 100.0}, {"a": 2, "b": 1, "c": 1}, 60.0) == {"a": 10.0, "b": 25.0, "c": 25.0}


def test_share_out(spark):
    rows = [("p", "a", 10.0, 2.0, 60.0), ("p", "b", 100.0, 1.0, 60.0), ("p", "c", 100.0, 1.0, 60.0), ("q", "d", 5.0, 1.0, 60.0)]
    df = spark.createDataFrame(rows, "up string, k string, cap double, weight double, budget double")
    assert {r["k"]: r["share"] for r in mixing.share_out(df, ["up"], ["k"]).collect()} == {"a": 10, "b": 25, "c": 25, "d": 5}


def test_repeats_nulls_and_empty(spark, odd):
    rows = [(1, "a b c", None, "en", "s")] * 4 + [(2, None, None, "en", "s"), (None, "x y", None, None, None), (3, "", "d", None, "s")]
    for budget in (3, 7, 12, None):
        compare(spark, rows, mixing.Mix(budget=budget, epochs=1))
    df = odd.withColumn("domain", queries.domain_of(F.col("source")))
    out = mixing.resample(df, mixing.Mix(epochs=1))
    assert out.schema == df.schema and out.count() <= odd.count()
    assert mixing.resample(df.limit(0), mixing.Mix()).count() == 0


def test_resample_repeats_rows(docs):
    df = docs.withColumn("domain", F.lit("d"))
    out = mixing.resample(df, mixing.Mix(budget=10**9, epochs=3))
    assert out.count() == 3 * df.count()
