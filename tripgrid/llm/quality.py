"""Quality rules as a short-circuit cascade, in column expressions only.

Each rule compares measures of a text. ``estimate`` times every rule alone on a sample
and counts which rules reject which sampled rows together; ``ordered`` then puts first,
again and again, the rule that rejects most of what is left per second. ``kept`` joins
the rules in that order, so that a row stops at the first rule that rejects it. The
order decides the cost only: a row is kept if no rule rejects it.

A null text has no words and fails like any text under ten words. Rows are judged one
by one, so repeated rows, ties and extra columns have no effect, and an empty table
gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripgrid.llm.common import free, let, whole, words_of
from tripgrid.operators.cleaning import computed_once
from tripgrid.session import remove, stage

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
# Rows on which the rules are timed and their rejections counted; it never decides a verdict.
SAMPLE_ROWS = 2_000
SEED = 17

Measures = Mapping[str, Column]


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))


def _covered(starts: Column) -> Column:
    """Words in the windows at the sorted ``starts``, each word once; none follows the last start."""
    gaps = F.zip_with(F.slice(starts, 2, F.size(starts)), starts, lambda b, a: F.least(b - a, F.lit(WINDOW)))
    return F.aggregate(gaps, F.lit(0), lambda acc, gap: acc + gap)


def _repeated_starts(words: Column) -> Column:
    """Sorted starts of windows whose words occur as a window elsewhere in the text.

    Sorting the windows puts equal ones side by side.
    """
    windows = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.size(words) - WINDOW),
            lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("w"), i.alias("i")),
        )
    )

    def twice(x: Column) -> Column:
        same = lambda item, k: (F.get(x, k)["w"] == item["w"])
        found = F.filter(x, lambda item, k: F.coalesce(same(item, k - 1), F.lit(False)) | F.coalesce(same(item, k + 1), F.lit(False)))
        return F.array_sort(F.transform(found, lambda item: item["i"]))

    return let(windows, twice)


def _repeat_words(words: Column) -> Column:
    """Hashes tell whether any window repeats; only then are the windows themselves compared."""

    def count(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
        )
        suspect = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        starts = let(_repeated_starts(w), lambda s: F.when(F.size(s) > 0, _covered(s)).otherwise(0))
        return F.when(F.size(w) < WINDOW, 0).when(suspect, starts).otherwise(0)

    return let(words, count)


def _stutters(words: Column) -> Column:
    """Words equal to the word before."""
    return let(
        words,
        lambda w: F.when(F.size(w) < 2, 0).otherwise(
            F.size(F.filter(F.zip_with(F.slice(w, 2, F.size(w)), w, lambda a, b: a == b), lambda same: same))
        ),
    )


#: Each measure as a function of the text and its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words),
    "word_chars": lambda text, words: F.length(F.array_join(words, "")),
    "n_symbols": lambda text, words: F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, "")),
    "n_lines": lambda text, words: _lines(text),
    "n_dup_lines": lambda text, words: _dup_lines(text),
    "n_repeat_words": lambda text, words: _repeat_words(words),
    "n_stutters": lambda text, words: _stutters(words),
    "n_letters": lambda text, words: F.length(F.regexp_replace(text, r"\P{L}+", "")),
    "n_capitals": lambda text, words: F.length(F.regexp_replace(text, r"\P{Lu}+", "")),
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], Column]


FEW_WORDS = Rule("few_words", lambda m: m["n_words"] < 10)
REPEATS = Rule("repeats", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 20)
RULES: tuple[Rule, ...] = (
    FEW_WORDS,
    REPEATS,
    Rule("symbols", lambda m: m["n_symbols"] * 10 > m["n_words"]),
    Rule("dup_lines", lambda m: m["n_dup_lines"] * 2 > m["n_lines"]),
    Rule("capitals", lambda m: m["n_capitals"] * 2 > m["n_letters"]),
    Rule("stutters", lambda m: m["n_stutters"] * 2 > m["n_words"]),
    Rule("word_length", lambda m: (m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 20)),
)


class _Lazy(dict):
    """Measures that become expressions when a rule asks for them, but for those that are columns already."""

    def __init__(self, text: Column, words: Column, given: Sequence[str] = ()):
        super().__init__({name: F.col(name) for name in given})
        self.of, self.asked = (text, words), False

    def __missing__(self, name: str) -> Column:
        self.asked = True
        return MEASURES[name](*self.of)

    def has_all_of(self, rule: Rule) -> bool:
        self.asked = False
        rule.rejects(self)
        return not self.asked


def _with_words(docs: DataFrame, text: str) -> tuple[DataFrame, str, str]:
    body = free("__text", docs.columns)
    words = free("__words", docs.columns)
    return docs.withColumn(body, whole(text)).withColumn(words, words_of(F.col(body))), body, words


@dataclass(frozen=True)
class Profile:
    """What a sample says: seconds a rule takes alone, and rows by the set of rules that reject them."""

    seconds: dict[str, float]
    rejected: dict[frozenset[str], int]


def estimate(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> Profile:
    total = docs.count()
    # The scan keeps its tasks; only the sampled rows meet in one file.
    held = stage(docs.select(text).sample(False, min(1.0, rows / max(total, 1)), SEED).repartition(1), "sample")
    df, body, words = _with_words(held.df, text)
    m = _Lazy(F.col(body), F.col(words))

    def seconds(*columns: Column) -> float:
        began = time.perf_counter()
        df.agg(F.sum(F.size(words)), F.sum(F.length(body)), *columns).collect()
        return time.perf_counter() - began

    count = {r.name: F.sum(r.rejects(m).cast("int")) for r in rules}
    seconds(*count.values())
    base = min(seconds() for _ in range(2))
    cost = {name: max(min(seconds(c) for _ in range(2)) - base, 1e-3) for name, c in count.items()}
    # At most one group for each set of rules.
    sets = df.groupBy(*[r.rejects(m).alias(r.name) for r in rules]).count().collect()
    remove(docs.sparkSession, held.path)
    return Profile(cost, {frozenset(r.name for r in rules if row[r.name]): row["count"] for row in sets})


def ordered(profile: Profile, rules: Sequence[Rule] = RULES) -> list[Rule]:
    left, out, rows = list(rules), [], dict(profile.rejected)
    while left:
        gain = lambda r: sum(n for names, n in rows.items() if r.name in names) / profile.seconds[r.name]
        out.append(best := max(left, key=gain))
        left.remove(best)
        rows = {names: n for names, n in rows.items() if best.name not in names}
    return out


def kept(rules: Sequence[Rule], measures: Measures) -> Column:
    """True if no rule rejects; later rules are not computed for rows rejected before."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(measures), F.lit(False)).otherwise(verdict)
    return verdict


def filter_documents(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that no rule rejects, with the columns they came with."""
    order = ordered(estimate(docs, text, rules), rules)
    df, body, words = _with_words(docs, text)
    # Otherwise the filter moves below the words, with a copy of them for each rule.
    return computed_once(df).filter(kept(order, _Lazy(F.col(body), F.col(words)))).select(*docs.columns)


def judge(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES, measures: Sequence[str] = tuple(MEASURES)
) -> DataFrame:
    """The named measures and the verdict of every row: id, the measures, kept.

    Rules that need no other measures come first, since those are there for every row;
    other measures are computed only for rows that reach their rule.
    """
    order = ordered(estimate(docs, text, rules), rules)
    df, body, words = _with_words(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), "text")
    named = [MEASURES[name](F.col(body), F.col(words)).cast("long").alias(name) for name in measures]
    lazy = _Lazy(F.col(body), F.col(words), measures)
    order.sort(key=lambda rule: not lazy.has_all_of(rule))
    return df.select("doc_id", body, words, *named).select("doc_id", *measures, kept(order, lazy).alias("kept"))
