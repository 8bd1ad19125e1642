"""Connected components of an edge list, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.plans.shared import stage


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)``; returns (node, label), label the smallest node reached.

    Each round joins every edge with the labels of its ends and lowers both ends' labels and the labels of
    those labels (pointer jumping), so a chain of length n takes about log n rounds. Labels live in a table of
    the shared folder; a round's joins are on node ids, where Spark splits the partitions of a hub, and the
    minimum is aggregated before its shuffle. Nothing but one count a round reaches the driver.

    Rows with a null end, loops and repeats of an edge are without effect. An empty edge list gives no rows.
    Raises if ``rounds`` rounds do not suffice, rather than return labels that are not final.
    """
    edges = edges.select("a", "b").where("a <> b")
    both = stage(edges.union(edges.select("b", "a")).distinct().toDF("a", "b"), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(seen, labels.node == seen.a, "left").select("node", "label", F.least("label", "near").alias("low"))
        # what a node learns, the node that was its label learns too
        told = hooked.where("low < label").groupBy(F.col("label").alias("node")).agg(F.min("low").alias("told"))
        lowered = hooked.join(told, "node", "left").select("node", "label", F.least("low", "told").alias("low"))
        lowered = stage(lowered, "hooked")
        jumped = lowered.join(lowered.select(F.col("node").alias("low"), F.col("low").alias("next")), "low", "left")
        after = stage(jumped.select("node", F.least("low", "next").alias("label"), (F.least("low", "next") < F.col("label")).alias("moved")), "labels")
        labels = after.select("node", "label")
        if not after.where("moved").limit(1).count():
            return labels
    raise RuntimeError(f"labels still move after {rounds} rounds")


def joined_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of ``links(a, b)`` and of what ``labels(node, label)``, an earlier result, already joins.

    Only the components that the links connect are looked at, as single nodes, not the links that made them.
    """
    if labels is None:
        return connected_components(links)
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    labels = stage(labels.select("node", "label").union(new.select("node", F.col("node").alias("label"))), "joined")
    named = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
    between = links.join(named("a"), "a").join(named("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    over = connected_components(between.where("a <> b").distinct())
    out = labels.join(over.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left")
    return stage(out.select("node", F.coalesce("least", "label").alias("label")), "joined")
