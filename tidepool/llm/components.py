"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest node id reachable from each node of ``edges`` (columns ``a`` and ``b``).

    Returns ``node`` and ``component`` for every node that has an edge.  Each round takes
    the least label of a node's neighbours and then follows labels twice, so the number of
    rounds grows with the logarithm of a component's diameter.  A round is two joins and a
    pre-aggregated minimum: no component is ever gathered in one task, and the only value
    that reaches the driver is the number of labels that changed.
    """
    both = scratch.table(
        edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().toDF("node", "other"), "links"
    )
    labels = scratch.table(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("component")), "labels")
    while True:
        old = labels
        near = both.join(old.select(F.col("node").alias("other"), F.col("component").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        step = old.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        step = scratch.table(step, "step")
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        labels = scratch.table(step.join(jump, "component", "left").select("node", F.coalesce("up", "component").alias("component"), "was"), "labels")
        scratch.drop(old, step)
        if not labels.where("component <> was").limit(1).count():
            scratch.drop(both)
            return labels.select("node", "component")


def merged_components(labels: DataFrame, fresh: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (node, component) after the edges ``fresh`` (a, b) were added: only components that these touch are looked at again."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    links = fresh.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    links = scratch.table(links.select("a", "b", F.coalesce("c_a", "a").alias("c_a"), F.coalesce("c_b", "b").alias("c_b")), "joined")
    moved = connected_components(links.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).where("a <> b").distinct(), scratch)
    moved = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    every = labels.select("node", "component").union(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("component")))
    return scratch.table(every.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
