"""Mixing sources to target weights by hierarchical budgeting.

A tree of domain, language and source has weights at each level. The token budget is
handed down from the root: siblings share their parent's budget by weight, none gets
more than its leaves can give (their tokens times ``epochs``), and what a short one
leaves is shared out among its siblings again. Because a parent never gets more than
its children can give together, a shortage only passes to the parent's own siblings
once all its children are full. A leaf then takes whole epochs of its documents and,
of one more, a prefix by tokens in an order seeded for that epoch.

Sharing is exact, without loops: siblings sorted by capacity per weight are full up to
the first one whose share at the common level stays below its capacity, which running
sums over the siblings show. Only leaf totals are sorted this way. Documents are cut by
bands of the seeded order, so no leaf is ever sorted as a whole.

A null domain, language or source is a value of its own. A null text has no tokens; a
document without tokens goes with the order like any other, and a leaf without any
tokens gives nothing. Rows with equal id and text have one place in the order and stay
or go together. Extra columns stay. An empty table, or a budget under one document,
gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripgrid.llm.common import free, whole, words_of
from tripgrid.operators.lookup import lookup_join
from tripgrid.session import Staged, remove, stage

#: Hexadecimal digits of an order key that name its band: 4,096 bands in a leaf.
BAND_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """The tree's levels from the root down, node weights by path, and how much to take.

    Nodes without a weight weigh 1; one with weight 0 gives nothing. Without a budget,
    as many tokens are taken as there are.
    """

    levels: Sequence[str] = ("domain", "lang", "source")
    weights: Mapping[tuple, float] = field(default_factory=dict)
    budget: int | None = None
    epochs: int = 2
    seed: int = 11

    def weight(self, depth: int) -> Column:
        """Weight of a node at ``depth``; a path may leave its upper nodes open by ``...``."""
        out = F.lit(1.0)
        for path, weight in self.weights.items():
            if len(path) == depth:
                hit = F.lit(True)
                for level, value in zip(self.levels, path, strict=False):
                    hit = hit if value is ... else hit & F.col(level).eqNullSafe(F.lit(value))
                out = F.when(hit, F.lit(float(weight))).otherwise(out)
        return out


def share_out(nodes: DataFrame, parent: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The nodes of one level, each with its ``share`` of its parent's ``budget``.

    ``nodes`` has ``cap`` and a ``weight`` above 0.
    """
    siblings = Window.partitionBy(*parent)
    sorted_ = siblings.orderBy(F.col("cap") / F.col("weight"), *order)
    before = F.coalesce(F.sum("cap").over(sorted_.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(sorted_.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.col("budget") - F.col("before")) / F.col("after")
    full = F.col("cap") <= F.col("weight") * F.col("level")
    # Behind the first node that is not full the level only falls, so the largest is the common one.
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(siblings)
    return (
        nodes.withColumn("before", before)
        .withColumn("after", after)
        .withColumn("level", level)
        .withColumn("full", full)
        .withColumn("common", common)
        .withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("common")))
        .drop("before", "after", "level", "full", "common")
    )


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves`` (the levels and ``tokens``) with the whole tokens that each is to give, as ``target``."""
    levels = list(mix.levels)
    for depth in range(1, len(levels) + 1):
        leaves = leaves.filter(mix.weight(depth) > 0)
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    above, parent = None, []
    for depth in range(1, len(levels) + 1):
        own = levels[:depth]
        nodes = leaves.groupBy(*own).agg((F.sum("tokens") * mix.epochs).cast("double").alias("cap"))
        nodes = nodes.withColumn("weight", mix.weight(depth))
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(float(total if mix.budget is None else mix.budget)))
        else:
            up = above.select(*[F.col(c).alias(f"__{c}") for c in parent], F.col("share").alias("budget"))
            same = F.lit(True)
            for c in parent:
                same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
            nodes = nodes.join(up, same).drop(*[f"__{c}" for c in parent])
        above, parent = share_out(nodes, parent, own), own
    return above.select(*levels, F.floor("share").cast("long").alias("target"), (F.col("cap") / mix.epochs).cast("long").alias("tokens"))


def _key(mix: Mix, epoch: Column, own: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(mix.seed)), epoch.cast("string"), own))


def _own(id: str, text: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col(id).cast("string"), F.lit("null")), text))


def plan(docs: DataFrame, mix: Mix, id: str = "doc_id", text: str = "text", tokens: Column | None = None) -> Staged:
    """One row per leaf: its levels, the epochs taken whole, and the last key taken of one more (or null)."""
    levels = list(mix.levels)
    count = F.size(words_of(whole(text))) if tokens is None else tokens
    leaf = F.xxhash64(*levels, *[F.col(c).isNull() for c in levels]).alias("leaf")
    small = docs.select(*levels, leaf, _own(id, whole(text)).alias("own"), count.cast("long").alias("n"))
    held = stage(small, "mix")
    leaves = held.df.groupBy("leaf", *levels).agg(F.sum("n").alias("tokens"))
    wanted = budgets(stage(leaves, "leaves").df, mix)
    whole_epochs = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(0).cast("long")
    goals = wanted.select(leaf, *levels, whole_epochs.alias("epochs"), "target", "tokens").withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("tokens")
    )
    goals = stage(goals, "goals")

    keyed = lookup_join(held.df.select("leaf", "own", "n"), Staged(goals.df.select("leaf", "epochs", "rest"), goals.rows, goals.path), ["leaf"])
    keyed = keyed.withColumn("key", _key(mix, F.col("epochs"), F.col("own"))).withColumn("band", F.substring("key", 1, BAND_DIGITS))
    running = Window.partitionBy("leaf").orderBy("band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bands = keyed.groupBy("leaf", "band").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")).withColumn("sum", F.sum("n").over(running))
    # The first band that does not fit whole, and what the bands before it leave for it.
    cut = stage(
        bands.filter(F.col("sum") > F.col("rest"))
        .groupBy("leaf")
        .agg(F.min(F.struct("band", (F.col("rest") - F.col("sum") + F.col("n")).alias("room"))).alias("c"))
        .select("leaf", F.col("c.band").alias("cut"), F.col("c.room").alias("room")),
        "cut",
    )
    inside = Window.partitionBy("leaf").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        lookup_join(keyed.select("leaf", "band", "key", "n"), cut, ["leaf"])
        .filter(F.col("band") == F.col("cut"))
        .groupBy("leaf", "key", "room")
        .agg(F.sum("n").alias("n"))
        .withColumn("sum", F.sum("n").over(inside))
        .filter(F.col("sum") <= F.col("room"))
        .groupBy("leaf")
        .agg(F.max("key").alias("last"))
    )
    # Without a key inside the cut band the prefix ends before it: every key below the bare band name.
    last = F.coalesce("last", "cut")
    planned = goals.df.join(cut.df, "leaf", "left").join(ends, "leaf", "left").select("leaf", "epochs", last.alias("last"))
    out = stage(planned, "plan")
    for gone in (held, goals, cut):
        remove(docs.sparkSession, gone.path)
    return out


def choose(docs: DataFrame, mix: Mix, id: str = "doc_id", text: str = "text", tokens: Column | None = None) -> tuple[DataFrame, str]:
    """``docs`` that the mix takes and the column that says how often, whose name is returned too.

    Documents are compared with their leaf's last key where they are; texts never move.
    """
    planned = plan(docs, mix, id, text, tokens)
    leaf, copies, epochs, last = (free(c, docs.columns) for c in ("__leaf", "copies", "__epochs", "__last"))
    names = {"leaf": leaf, "epochs": epochs, "last": last}
    lookup = Staged(planned.df.withColumnsRenamed(names), planned.rows, planned.path)
    levels = list(mix.levels)
    marked = docs.withColumn(leaf, F.xxhash64(*levels, *[F.col(c).isNull() for c in levels]))
    joined = lookup_join(marked, lookup, [leaf])
    key = _key(mix, F.col(epochs), _own(id, whole(text)))
    more = F.coalesce(key <= F.col(last), F.lit(False)).cast("long")
    return joined.withColumn(copies, F.col(epochs) + more).filter(F.col(copies) > 0).select(*docs.columns, copies), copies


def resample(docs: DataFrame, mix: Mix, id: str = "doc_id", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """``docs`` as the mix takes them, a row for each time."""
    taken, copies = choose(docs, mix, id, text, tokens)
    again = free("__again", taken.columns)
    return taken.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
