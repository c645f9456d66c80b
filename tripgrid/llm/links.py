"""URL rules, and verdicts of hosts without a rule by trust and distrust along links.

Rules name a host and the start of a path; a rule fits its host and all subdomains, and
the longest that fits decides. Where none fits, the page's host decides: trust starts
at hosts with allowed pages and flows along links (personalised PageRank), distrust
starts at hosts with blocked pages and flows against links, to those that link there.
A host is blocked if its distrust is more than ``TOLERANCE`` times its trust; a host
that neither reaches is allowed.

Host, path and rule are empty, empty and null for a null url or one without ``://``;
such a page has no host and is allowed. A null ``html`` has no links. Repeated rows are
judged alike and as often as they occur; their links count as often, too. Extra columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripgrid.llm.common import free, uneven_join
from tripgrid.session import Staged, remove, stage

DAMPING = 0.85
# The rounds end when all scores together change by less and no further host is reached.
CHANGE = 1e-6
# Changes shrink by the damping in every round, so that about 90 suffice; more than this is an error.
ROUNDS = 1000
TOLERANCE = 1.0
# Tasks over which the links of one host are spread.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# An absolute link in an href attribute, with or without a scheme.
HREF = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]*)"""


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Host of a url in lower case, empty without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, from pages (host, html)."""
    found = pages.filter(F.col("host") != "").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("href"))
    target = F.regexp_replace("href", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "://")
    linked = found.select("src", host_of(target).alias("dst"))
    return linked.filter((F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, change: float = CHANGE) -> Staged:
    """Personalised PageRank (host, score) of ``seeds`` (host, seed) along ``edges`` (src, dst, n).

    Seeds are scaled to one together; a host without links hands its score back to them.
    Rounds go on until scores change by less than ``change`` and every host that links
    lead to has one; ``rounds`` that change them by more are an error.
    Scores are sent along links in salted joins, so a host with many links is spread over
    tasks, and what arrives is summed before it is shuffled.
    """
    spark = seeds.sparkSession
    total = seeds.agg(F.sum("seed")).first()[0] or 0.0
    start = stage(seeds.select("host", (F.col("seed") / (total or 1.0)).alias("seed")).filter("seed > 0"), "seeds")
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    salt = F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int").alias("salt")
    parts = stage(edges.select("src", "dst", "n", salt), "edges")
    sums = stage(out, "out")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    scores = stage(start.df.select("host", F.col("seed").alias("score")), "scores")
    n = 0
    while parts.rows and start.rows:
        sending = scores.df.join(sums.df.withColumnRenamed("src", "host"), "host", "left")
        # What hosts without links hold goes back to the seeds.
        kept = sending.agg(F.sum(F.when(F.col("all").isNull(), F.col("score")))).first()[0] or 0.0
        sent = (
            sending.filter(F.col("all").isNotNull())
            .select(F.col("host").alias("src"), (F.col("score") / F.col("all")).alias("each"), copies)
            .join(parts.df, ["src", "salt"])
            .select(F.col("dst").alias("host"), (F.col("each") * F.col("n") * damping).alias("score"))
        )
        back = start.df.select("host", (F.col("seed") * (1 - damping + damping * kept)).alias("score"))
        after = stage(sent.unionByName(back).groupBy("host").agg(F.sum("score").alias("score")), "scores")
        moved = after.df.withColumnRenamed("score", "new").join(scores.df, "host", "full")
        delta = moved.agg(F.sum(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("score", F.lit(0.0))))).first()[0] or 0.0
        remove(spark, scores.path)
        # A host once reached keeps a score, so the same number of hosts is the same hosts.
        further, scores = after.rows > scores.rows, after
        if delta < change and not further:
            break
        n += delta >= change
        if n >= rounds:
            raise RuntimeError(f"scores of hosts still change by {delta} after {n} rounds")
    for gone in (start, parts, sums):
        remove(spark, gone.path)
    return scores


def host_verdicts(pages: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust, blocked) from pages (host, html, ruled)."""
    edges = stage(host_links(pages), "hostlinks")
    hosts = stage(
        pages.filter(F.col("host") != "")
        .groupBy("host")
        .agg(F.avg((F.col("ruled") == "allow").cast("int")).alias("good"), F.avg((F.col("ruled") == "block").cast("int")).alias("bad")),
        "hosts",
    )
    seed = lambda c: hosts.df.select("host", F.coalesce(c, F.lit(0.0)).alias("seed"))
    trust = propagate(edges.df, seed("good"))
    against = edges.df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(against, seed("bad"))
    scored = hosts.df.select("host").join(trust.df.withColumnRenamed("score", "trust"), "host", "left")
    scored = scored.join(distrust.df.withColumnRenamed("score", "distrust"), "host", "left").fillna(0.0, ["trust", "distrust"])
    return scored.withColumn("blocked", F.col("distrust") > F.col("trust") * tolerance)


def judge(pages: DataFrame, rules: Sequence[UrlRule], id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    address = F.col(url).cast("string")
    own = pages.select(F.col(id).alias("page_id"), host_of(address).alias("host"), path_of(address).alias("path"), F.col(html).alias("html"))
    found = free("found", own.columns)
    own = own.withColumn(found, rule_of(F.col("host"), F.col("path"), rules))
    hosts = stage(host_verdicts(own.select("host", "html", F.coalesce(f"{found}.verdict", F.lit("")).alias("ruled"))), "verdicts")
    small = own.select("page_id", "host", "path", f"{found}.rule", F.col(f"{found}.verdict").alias("ruled"))
    by_host = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    joined = uneven_join(small, hosts.df, "host")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "trust", "distrust")
