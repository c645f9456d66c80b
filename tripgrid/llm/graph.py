"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripgrid.llm.common import hot_keys, uneven_join
from tripgrid.session import Staged, remove, stage


def components(edges: DataFrame) -> DataFrame:
    """One row (node, root) for each node of ``edges`` (a, b); root is the smallest node it reaches.

    Every set of nodes with one label looks for the smallest label beside it and takes it
    over, until no label changes. The sets at least halve wherever one has a smaller
    neighbour, so rounds grow with the logarithm of the nodes when node numbers are
    spread like hashes. Each round is written to the shared folder, which cuts the
    lineage. A set's smallest neighbour is an aggregate, combined before it is shuffled,
    and a label that many nodes carry, or a node that many links lead to, is joined by
    ``uneven_join``; no task holds a whole component or all links of a hub.

    Repeated links, loops and links with a null end change nothing.
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    links = stage(
        edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.explode(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b")))).alias("l"))
        .select("l.*")
        .distinct(),
        "links",
    )
    hubs = hot_keys(links.df, "b")
    # The first round needs no join: every node is its own label.
    labels: Staged = stage(
        links.df.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")),
        "labels",
    )
    while True:
        near = (
            uneven_join(links.df, labels.df.select(F.col("node").alias("b"), "label"), "b", hot=hubs)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        moves = stage(
            labels.df.join(near, "node")
            .groupBy("label")
            .agg(F.min("near").alias("to"))
            .filter(F.col("to") < F.col("label")),
            "moves",
        )
        if moves.rows == 0:
            remove(spark, moves.path)
            remove(spark, links.path)
            return labels.df.withColumnRenamed("label", "root")
        moved = stage(
            uneven_join(labels.df, moves.df, "label").select("node", F.coalesce("to", "label").alias("label")), "labels"
        )
        remove(spark, labels.path)
        remove(spark, moves.path)
        labels = moved
