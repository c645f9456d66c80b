import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripgrid.llm import quality

WORD, BLANK = re.compile(r"[^\x20\x09-\x0D]+"), r"[^\x20\x09-\x0D]"


def measured(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if re.search(BLANK, x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 5))
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_stutters": sum(a == b for a, b in zip(words, words[1:])),
        "n_letters": sum(c.isalpha() for c in text or ""),
        "n_capitals": sum(c.isupper() for c in text or ""),
    }


def rejected(m):
    return (
        m["n_words"] < 10
        or m["n_repeat_words"] * 100 > m["n_words"] * 20
        or m["n_symbols"] * 10 > m["n_words"]
        or m["n_dup_lines"] * 2 > m["n_lines"]
        or m["n_capitals"] * 2 > m["n_letters"]
        or m["n_stutters"] * 2 > m["n_words"]
        or not m["n_words"] * 2 <= m["word_chars"] <= m["n_words"] * 20
    )


def test_measures_and_verdicts_equal_brute_force(docs, texts):
    for row in quality.judge(docs).collect():
        want = measured(texts[row["doc_id"]])
        assert {k: row[k] for k in want} == want
        assert row["kept"] == (not rejected(want))


def test_other_measures_wait_for_their_rule(docs, texts):
    """Only the named measures are computed for every row; the others stand behind conditions."""
    given = ("n_words", "n_repeat_words")
    judged = quality.judge(docs, measures=given)
    assert judged.columns == ["doc_id", *given, "kept"]
    assert all(r["kept"] == (not rejected(measured(texts[r["doc_id"]]))) for r in judged.collect())
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "Lu}" in plan
    assert all("CASE WHEN" in line[: line.index("Lu}")] for line in plan.splitlines() if "Lu}" in line)
    lazy = quality._Lazy(F.col("text"), F.col("w"), given)
    assert [r.name for r in quality.RULES if lazy.has_all_of(r)] == ["few_words", "repeats"]


def test_odd_rows(odd):
    rows = quality.judge(odd).collect()
    assert len(rows) == odd.count()
    given = Counter((r["doc_id"], r["text"]) for r in odd.collect())
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in given.elements())
    by_id = {r["doc_id"]: r for r in rows}
    for (doc_id, text), _ in given.items():
        want = measured(text)
        assert {k: by_id[doc_id][k] for k in want} == want
    assert not by_id[2]["kept"] and by_id[2]["n_words"] == 0
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["kept"])


def test_empty_table(odd):
    assert quality.judge(odd.limit(0)).count() == 0
    assert quality.filter_documents(odd.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a b c d e " * 3, "a b c d e f a b c d e", "x " * 30, "a b c d e f g h i j k", "a b c d a b c d a b c d"])
def test_windows(spark, text):
    row = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_repeat_words"] == measured(text)["n_repeat_words"]


def test_order_is_by_rejections_left_per_second():
    seconds = {"few_words": 1.0, "repeats": 4.0, "symbols": 1.0}
    rejected = {frozenset({"few_words", "symbols"}): 8, frozenset({"symbols"}): 4, frozenset({"repeats"}): 8, frozenset(): 80}
    rules = [r for r in quality.RULES if r.name in seconds]
    # After symbols, few_words rejects nothing more.
    assert [r.name for r in quality.ordered(quality.Profile(seconds, rejected), rules)] == ["symbols", "repeats", "few_words"]


def test_every_order_gives_one_result(docs):
    body, words = F.col("text"), F.col("w")
    df = docs.withColumn("w", quality.words_of(body))
    counts = {
        df.filter(quality.kept(rules, quality._Lazy(body, words))).count()
        for rules in (quality.RULES, quality.RULES[::-1], quality.RULES[3:] + quality.RULES[:3])
    }
    assert len(counts) == 1


def test_no_python_in_the_plan(docs):
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
