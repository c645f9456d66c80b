import numpy as np
import pytest

from tripgrid.llm import links
from tripgrid.llm.queries import RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i, c in enumerate(rest) if c in "/?#"] + [len(rest)])
    stop = min([i for i, c in enumerate(rest) if c in "?#"] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    return host, rest[end:stop]


def ruled(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


URLS = [
    None, "", "example.com/en/", "http://", "http://WWW.Example.com/en/x?y", "http://example.com/en/x#://", "https://a.example.com",
    "x://example.net/es/", "x://net/fr/a", "x://notnet/fr/a", "x://example.com/EN/", "x://ÉXAMPLE.com/a/b#c?d", "a://b://c/d", "x://h?/en/",
    "x://www.example.com/en/" + "y" * 5000, "http://example.org:80/en/", "http://line\nbreak.com/en/",
]


def test_host_path_and_rule(spark):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in links.judge(df, RULES).collect()}
    for i, url in enumerate(URLS):
        host, path = parts(url)
        rule = ruled(host, path)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule and rule.name)
        if rule:
            assert rows[i]["verdict"] == rule.verdict
        elif not host:
            assert rows[i]["verdict"] == "allow"


def rank(hosts, edges, seeds):
    """Personalised PageRank by dense matrix products."""
    place = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for s, d, n in edges:
        m[place[d], place[s]] += n
    seed = np.array([seeds.get(h, 0.0) for h in hosts])
    seed = seed / seed.sum()
    sums = m.sum(axis=0)
    x = seed
    for _ in range(links.ROUNDS):
        kept = x[sums == 0].sum()
        sent = m @ np.where(sums > 0, x / np.where(sums > 0, sums, 1), 0)
        new = links.DAMPING * sent + seed * (1 - links.DAMPING + links.DAMPING * kept)
        done = np.abs(new - x).sum() < links.CHANGE
        x = new
        if done:
            break
    return dict(zip(hosts, x))


def test_propagation_equals_matrix_products(spark):
    rng = np.random.default_rng(4)
    hosts = [f"h{i}" for i in range(30)]
    edges = {}
    for _ in range(90):
        a, b = rng.choice(29, 2, replace=False)  # h29 has no links
        edges[(hosts[a], hosts[b])] = int(rng.integers(1, 5))
    edges = [(a, b, n) for (a, b), n in edges.items()]
    seeds = {"h0": 1.0, "h3": 0.5, "h29": 0.25}
    found = links.propagate(
        spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, seed double")
    ).df.collect()
    want = rank(hosts, edges, seeds)
    got = {r["host"]: r["score"] for r in found}
    for h in hosts:
        assert got.get(h, 0.0) == pytest.approx(want[h], abs=1e-9)


def page(i, url, *targets):
    return (i, url, "".join(f"<a class=x HREF = \"{t}\">y</a>" for t in targets))


def test_verdicts_follow_links(spark):
    pages = [
        page(1, "http://good.example.com/", "https://near.org/x", "//Near.org/y", "/own"),
        page(2, "http://near.org/a"),
        page(3, "http://bad.net/es/a", "http://victim.org"),
        page(4, "http://farm.org/a", "http://bad.net/es/b"),
        page(5, "http://victim.org/"),
        page(6, "http://alone.org/", "mailto:x@bad.net", "/relative//path", "javascript:void(0)"),
        page(7, "http://bad.net/de/a"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {(r["src"], r["dst"]): r["n"] for r in links.host_links(df.withColumn("host", links.host_of(df["url"]))).collect()} == {
        ("good.example.com", "near.org"): 2,
        ("bad.net", "victim.org"): 1,
        ("farm.org", "bad.net"): 1,
    }
    verdicts = {r["page_id"]: r["verdict"] for r in links.judge(df, RULES).collect()}
    # Those that link to a blocked host are blocked, those it links to are not.
    assert verdicts == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block"}


def test_odd_rows(spark):
    rows = [(1, "http://a.com/x", None, "h"), (1, "http://a.com/x", None, "h"), (None, "http://a.net/es/", "", "h"), (2, None, "<a href=//b.org>", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = links.judge(df, RULES)
    assert sorted((str(r["page_id"]), r["verdict"]) for r in found.collect()) == [("1", "allow"), ("1", "allow"), ("2", "allow"), ("None", "block")]
    assert links.judge(df.limit(0), RULES).count() == 0


def test_scores_reach_the_end_of_a_chain(spark):
    hosts = [f"h{i}" for i in range(100)]
    edges = [(a, b, 1) for a, b in zip(hosts, hosts[1:])]
    found = links.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([("h0", 1.0)], "host string, seed double"))
    got = {r["host"]: r["score"] for r in found.df.collect()}
    assert set(got) == set(hosts)
    share = sum(links.DAMPING**i for i in range(100))
    for i in range(100):
        assert got[f"h{i}"] == pytest.approx(links.DAMPING**i / share, abs=links.CHANGE)


def test_scores_that_do_not_settle_are_an_error(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    with pytest.raises(RuntimeError):
        links.propagate(edges, spark.createDataFrame([("a", 1.0)], "host string, seed double"), rounds=3)
