import math
import re
from collections import defaultdict

import pytest

from tripgrid.llm import sanitise as s

BASE = ("email", "ip", "card", "phone")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base(text):
    """Spans by the patterns as they are stated."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    out = [(k, m.start(), m.end()) for k, p, ok in tests for m in re.finditer(p, text) if ok(m)]
    return sorted(out, key=lambda x: (x[1], BASE.index(x[0])))


TEXTS = [
    "",
    "a@b.c.d x@y a.b%c+d-e_f@g-h.ij_k@l.m ..@-.-.. @a.b",
    "a@b.c@d.e aa@bb@cc.dd é@x.y \U0001f600z@q.rs",
    "1.2.3.4.5.6.7.8 256.1.1.1 00255.0.0.1 1.2.3 1.2.3.99999999999999999999 999.1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 41 11 1111111111 11  4111111111111111 0000000000000",
    "+1 (555) 010-9999 +12 +1.2.3.4.5.6.7.8.9 +1 2 3 4 5 6 7 8 9 (1) ++15550109999- +155501099991234567",
    "x" * 3000 + "@" + "y" * 3000 + " " + "1" * 3000 + " " + "1." * 2000,
    " ".join(f"user{i}@mail.example.com" for i in range(1300)),
    "5 4 3 2 1 " * 500,
    "é" * 50 + " mail: j.doe@example.org, call +44 (20) 7946-0958; ip 10.1.2.3",
]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in s.scan(df).collect()}


def test_base_spans(spark):
    assert found(spark, TEXTS) == {i: base(t) for i, t in enumerate(TEXTS)}


def test_documents(docs, texts):
    for r in s.scan(docs).collect():
        assert [tuple(x) for x in r["spans"] if x["kind"] in BASE] == base(texts[r["doc_id"]])


def risky(texts, contexts, generalise, remove):
    """All spans, with disclosures counted by loops over whole texts."""
    term = re.compile(r"[^\W\d_]{3,}")
    near, with_e, around = defaultdict(set), defaultdict(set), defaultdict(set)
    places = defaultdict(list)
    for i, text in enumerate(texts):
        spans = base(text)
        for kind, start, end in spans:
            name = text[start:end].lower() if kind == "email" else text[start:end] if kind == "ip" else re.sub("[^0-9]", "", text[start:end])
            entity = (kind, name)
            with_e[entity].add(i)
            low = max([e for k, _, e in spans if k == kind and e <= start], default=0)
            high = min([b for k, b, _ in spans if k == kind and b >= end], default=len(text))
            for m in term.finditer(text, max(low, start - s.REACH - 1), min(high, end + s.REACH + 1)):
                if m.end() <= start and m.start() == start - s.REACH - 1 or m.start() >= end and m.end() > end + s.REACH:
                    continue
                if m.end() <= start or m.start() >= end:
                    t = m[0].lower()
                    near[(t, entity)].add(i)
                    around[(t, entity, i)].add((text[max(low, start - s.REACH - 1) : start], text[end : min(high, end + s.REACH + 1)]))
                    places[(t, entity)].append((i, m.start(), m.end()))
    total = len(texts)
    with_t = defaultdict(int)
    for text in texts:
        for t in set(term.findall(text.lower())):
            with_t[t] += 1
    best = {}
    for (t, e), rows in near.items():
        if len({min(around[(t, e, i)]) for i in rows}) < contexts:
            continue
        pmi = math.log2(len(rows) * total / (with_t[t] * len(with_e[e])))
        share = pmi / math.log2(total / len(with_e[e]))
        if share >= generalise:
            for place in places[(t, e)]:
                best[place] = max(best.get(place, 0), share)
    out = {i: base(t) for i, t in enumerate(texts)}
    for (i, start, end), share in best.items():
        out[i].append(("remove" if share >= remove else "generalise", start, end))
    return {i: sorted(x, key=lambda p: (p[1], s.KINDS.index(p[0]))) for i, x in out.items()}


def corpus():
    filler = [f"plain words number {'abcdefghij'[i % 10] * 4} about nothing" for i in range(80)]
    telling = [f"today {'klmnopqrst'[i] * 5} the Zanzibar office wrote boss@corp.example.com about {'uvwxyz'[i % 6] * 4}" for i in range(8)]
    leaks = ["a trip to zanzibar alone"]
    copies = ["exactly the quokka notes from copy@corp.example.com were copied"] * 20
    return filler + telling + leaks + copies


def test_terms_that_disclose(spark):
    texts = corpus()
    got = found(spark, texts)
    assert got == risky(texts, s.CONTEXTS, s.GENERALISE, s.REMOVE)
    kinds = lambda i: [k for k, _, _ in got[i]]
    # zanzibar is known from one text without the entity; office occurs beside it only.
    marked = {texts[80][a:b]: k for k, a, b in got[80]}
    assert marked["Zanzibar"] == marked["office"] == "remove" and marked["boss@corp.example.com"] == "email"
    assert all(kinds(i) == [] for i in range(80))
    # Copies repeat their words beside an entity without telling more.
    assert all(kinds(i) == ["email"] for i in range(89, 109))


def test_rewrite(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    out = s.rewrite(df)
    assert out.columns == df.columns
    clean = {r["doc_id"]: r["text"] for r in out.collect()}
    assert all(clean[i] == texts[i] for i in range(80))
    assert "[EMAIL]" in clean[80] and "Zanzibar" not in clean[80] and "@" not in clean[80]
    assert clean[89] == texts[89].replace("copy@corp.example.com", "[EMAIL]")


def test_odd_rows(odd):
    rows = s.scan(odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())
    for r in rows:
        texts = [x["text"] or "" for x in odd.collect() if x["doc_id"] == r["doc_id"]]
        assert [tuple(x) for x in r["spans"]] == base(texts[0])
    assert s.scan(odd.limit(0)).count() == 0 and s.rewrite(odd.limit(0)).count() == 0
    assert s.rewrite(odd).schema == odd.schema


@pytest.mark.parametrize("digits", ["4111111111111111", "4111111111111112", "378282246310005", "0" * 19, "1" * 12])
def test_luhn(spark, digits):
    assert bool(found(spark, [digits])[0]) == luhn(digits)


def test_no_python_in_the_plan(docs):
    plan = s.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def disclosing(texts):
    """Marked terms of every text, by loops over whole documents and both ways to estimate p(e | t)."""
    inside = lambda m, spans: any(m.start() < e and b < m.end() for _, b, e in spans)
    group = list(range(len(texts)))
    first = {}
    for i, text in enumerate(texts):
        words = "".join(" " if any(b <= j < e for _, b, e in base(text)) else c for j, c in enumerate(text)).split()
        for j in range(max(1, len(words) - s.PASSAGE + 1)):
            other = group[first.setdefault(tuple(words[j : j + s.PASSAGE]), i)]
            group = [other if g == group[i] else g for g in group] if other != group[i] else group
    term, holds, says, where = re.compile(r"[^\W\d_]{3,}"), defaultdict(dict), defaultdict(set), defaultdict(list)
    for i, text in enumerate(texts):
        spans = base(text)
        for kind, b, e in spans:
            holds[text[b:e].lower()].setdefault(i, (text[max(0, b - s.REACH - 1) : b], text[e : e + s.REACH + 1]))
        for m in term.finditer(text):
            says[m[0].lower()].add(i)
            if not inside(m, spans):
                where[(i, m[0].lower())].append((m.start(), m.end()))
    out = defaultdict(dict)
    for e, rows in holds.items():
        content = math.log2(len(texts) / len(rows))
        for t in {t for i, t in where if i in rows}:
            both = [i for i in rows if (i, t) in where]
            k = min(len({rows[i] for i in both}), len({group[i] for i in both}))
            if k >= s.CONTEXTS:
                likely = len(both) / len(says[t])
            else:
                n, z = len(says[t]) - len(both) + k, s.Z
                likely = (2 * k + z * z - 1 - z * math.sqrt(z * z - 1 / n + 4 * k * (1 - k / n) + 4 * k / n - 2)) / (2 * (n + z * z))
            share = (math.log2(likely) + content) / content
            for i in both if share >= s.GENERALISE else ():
                for place in where[(i, t)]:
                    out[i][place] = max(out[i].get(place, 0), share)
    return {i: {p: "remove" if d >= s.REMOVE else "generalise" for p, d in marks.items()} for i, marks in out.items()}


def numbered(i):
    return "".join(chr(97 + int(c)) for c in f"{i:04}")


def rare_and_far():
    filler = [f"plain words {numbered(i)} about nothing" for i in range(1500)]
    rare = [f"{numbered(9000 + i)} the Quagga keeper is rare@corp.example.com {numbered(8000 + i)}" for i in range(3)]
    copies = ["only Wombat friends know copy@corp.example.com here"] * 3
    once = ["single Numbat sighting once@corp.example.com"]
    gap = lambda i, n: " ".join(numbered(n + 30 * i + j) for j in range(30))
    far = [f"{numbered(7000 + i)} write to far@corp.example.com {gap(i, 5000)} signed Okapi, {gap(i, 6000)} okapi" for i in range(6)]
    near = [" ".join("other" + numbered(i) if j % 20 == 5 + i else "near@corp.example.com" if j == 4 + i else numbered(4000 + j) for j in range(200)) for i in range(4)]
    return filler + rare + copies + once + far + near


def test_rare_entities_are_protected(spark):
    texts = rare_and_far()
    got = found(spark, texts)
    want = disclosing(texts)
    assert {i: {(b, e): k for k, b, e in x if k not in BASE} for i, x in got.items()} == {i: want.get(i, {}) for i in range(len(texts))}
    # Three documents tell the keeper; three copies of one text, or one text, do not.
    marked = lambda i: {texts[i][b:e] for k, b, e in got[i] if k not in BASE}
    assert all("Quagga" in marked(i) for i in range(1500, 1503))
    assert not any(marked(i) for i in range(1503, 1507))
    # Nor do copies with some words changed, the entity's neighbours among them.
    assert not any(marked(i) for i in range(1513, 1517))


def test_terms_far_from_the_entity(spark):
    texts = rare_and_far()
    got = found(spark, texts)
    for i in range(1507, 1513):
        assert [k for k, b, e in got[i] if texts[i][b:e].lower() == "okapi"] == ["remove", "remove"]
