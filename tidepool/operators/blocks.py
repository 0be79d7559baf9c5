"""Canonical chain, frontier, holes and ranges over block tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.ordered import with_previous
from tidepool.operators.walks import walked


def links(heads: DataFrame) -> DataFrame:
    """chain, block, to: blocks with their parents; those that name themselves as parent are roots."""
    return heads.where("parent is not null and parent <> block").select("chain", "block", F.col("parent").alias("to"))


def canonical(heads: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """chain, block and distance of every block on the path from each chain's highest block (or its block in ``starts``) to its root.

    Regions of blocks are followed in tasks and only the steps between them are joined (``walks``).
    ``heads`` holds each block once.  Blocks that name themselves as parent are roots.  A chain whose
    path runs into a cycle has none.
    """
    starts = heads.groupBy("chain").agg(F.max("block").alias("block")) if starts is None else starts
    inner, ends = walked(links(heads), starts)
    return inner.union(ends)


def frontier(blocks: DataFrame, least_authority: int) -> DataFrame:
    """chain, frontier: the last block before the first that is both unreadable and touched; the tip without one.

    Null where the first block already is.
    """
    hole = F.min(F.when((F.col("authority") < least_authority) & F.col("touched"), F.col("number")))
    first = blocks.groupBy("chain").agg(hole.alias("hole"))
    return blocks.join(first, "chain").groupBy("chain").agg(F.max(F.when(F.col("hole").isNull() | (F.col("number") < F.col("hole")), F.col("number"))).alias("frontier"))


def holes(blocks: DataFrame, least_authority: int) -> DataFrame:
    return blocks.where((F.col("authority") < least_authority) & F.col("touched")).select("chain", "number", "authority")


def missing_ranges(blocks: DataFrame) -> DataFrame:
    """chain, first and last of every run of absent block numbers between present ones."""
    rows = with_previous(blocks.select("chain", "number").distinct(), "chain", "number", [])
    return rows.where("before.number < number - 1").select("chain", (F.col("before.number") + 1).alias("first"), (F.col("number") - 1).alias("last"))


def missing_parents(heads: DataFrame) -> DataFrame:
    """chain, parent: parents that are named by a block but are not present themselves."""
    named = heads.where("parent is not null").select("chain", "parent").distinct()
    return named.join(heads.select("chain", F.col("block").alias("parent")), ["chain", "parent"], "left_anti")


def best_authority(logs: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the highest ``authority`` of each block: complete replaces streamed, never the reverse."""
    best = logs.groupBy(*keys).agg(F.max("authority").alias("authority"))
    return logs.join(best, [*keys, "authority"], "left_semi")


def admission(deliveries: DataFrame) -> DataFrame:
    """chain, block, arrival, parent, outcome: the first delivery of a block wins, blocks that name themselves never do."""
    itself = F.coalesce(F.col("parent") == F.col("block"), F.lit(False))
    first = F.min(F.when(~itself, F.struct("arrival", "parent"))).over(Window.partitionBy("chain", "block"))
    rows = deliveries.withColumn("first", first)
    outcome = F.when(itself, "self_parent").when(F.col("arrival") == F.col("first.arrival"), "admitted").when(F.col("parent").eqNullSafe(F.col("first.parent")), "duplicate").otherwise("conflicting_parent")
    return rows.select("chain", "block", "arrival", "parent", outcome.alias("outcome"))
