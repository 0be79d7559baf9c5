"""Block graphs above an anchor: connection, the present path, finalisation, re-rooting, orphaned anchors, seeding.

``nodes`` holds each delivered block once (chain, block, parent, number, authority, touched); ``anchors`` and
``observed`` hold one block of each chain.  The anchor itself is no node: rows that name it are passed over.
Walks go by regions of (chain, block) (``walks``), so that a chain with most of the blocks is spread as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.blocks import links
from tidepool.operators.ordered import with_previous
from tidepool.operators.walks import arriving, walked
from tidepool.plans.lineage import cut

KEY = ["chain", "block"]
COMPLETE = 2


def connected(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """chain, block of the nodes whose parents lead to the anchor.

    The others are pending: above a gap, on a fork from below the anchor, or in a cycle.
    """
    return arriving(links(nodes).join(F.broadcast(anchors.select(*KEY)), KEY, "left_anti"), anchors)  # one row for each chain


def observed_heads(observations: DataFrame, nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """chain, block: the last observation (by seq) that names a node or the anchor; the anchor without any."""
    present = nodes.select(*KEY).union(anchors.select(*KEY))
    last = observations.join(present, KEY, "left_semi").groupBy("chain").agg(F.max_by("block", "seq").alias("seen"))
    return anchors.join(last, "chain", "left").select("chain", F.coalesce("seen", "block").alias("block"))


def present_path(nodes: DataFrame, observed: DataFrame, anchors: DataFrame) -> DataFrame:
    """chain, block, depth from the observed head (0) down to the anchor or a gap, through connected and pending nodes.

    A chain whose walk meets a block twice has no path.
    """
    above = nodes.join(F.broadcast(anchors.select(*KEY)), KEY, "left_anti")  # one row for each chain
    inner, ends = walked(links(above), observed)
    ends = above.select(*KEY).join(F.broadcast(ends), KEY)  # at most one row for each chain; others than these have parents
    return inner.union(ends).select(*KEY, F.col("distance").alias("depth"))


def anchored_path(nodes: DataFrame, observed: DataFrame, anchors: DataFrame) -> DataFrame:
    """The present path of the chains whose observed head is connected."""
    whole = cut(connected(nodes, anchors).join(F.broadcast(observed), KEY, "left_semi").select("chain"))
    return present_path(nodes, observed, anchors).join(F.broadcast(whole), "chain", "left_semi")  # one row for each chain


def block_candidates(path: DataFrame, logs: DataFrame) -> DataFrame:
    """chain, block, depth, pool_id: pools that readable logs (authority above 0) name on the path, each once a block."""
    named = logs.where("authority > 0").select(*KEY, "pool_id").distinct()
    return path.select(*KEY, "depth").join(named, KEY)


def _blocks_fold(least: int):
    return (F.coalesce("authority", F.lit(0)) < least) & F.coalesce("touched", F.lit(True))


def finalized(nodes: DataFrame, observed: DataFrame, anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """chain, block, number, moved: anchors after finalisation towards ``targets`` (chain, block).

    An anchor moves to the last block at or below its target before the first that isn't complete and may
    hold watched logs; without a header (touched is null) it may.  A target off the anchored path moves nothing.
    """
    path = cut(anchored_path(nodes, observed, anchors).join(nodes.select(*KEY, "number", "authority", "touched"), KEY))
    aim = path.join(targets, KEY, "left_semi").select("chain", F.col("depth").alias("least"))
    below = path.join(F.broadcast(aim), "chain").where("depth >= least")  # one row for each chain, here and below
    hole = below.groupBy("chain").agg(F.max(F.when(_blocks_fold(COMPLETE), F.col("depth"))).alias("hole"))
    free = below.join(F.broadcast(hole), "chain").where("hole is null or depth > hole").groupBy("chain").agg(F.min(F.struct("depth", "block", "number")).alias("to"))
    to = lambda c: F.coalesce(F.col(f"to.{c}"), F.col(c)).alias(c)
    return anchors.join(free, "chain", "left").select("chain", to("block"), to("number"), F.col("to").isNotNull().alias("moved"))


def rerooted(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Nodes that ``finalized`` anchors leave: descendants of a moved anchor; all nodes where it stayed."""
    moved = cut(anchors.where("moved").select(*KEY))
    chains = F.broadcast(moved.select("chain"))  # one row for each chain
    kept = connected(nodes.join(chains, "chain", "left_semi"), moved)
    return nodes.join(kept, KEY, "left_semi").union(nodes.join(chains, "chain", "left_anti"))


def surviving_heads(observed: DataFrame, kept: DataFrame, anchors: DataFrame) -> DataFrame:
    """chain, block: observed heads that are still nodes; else the anchor."""
    alive = observed.join(kept, KEY, "left_semi").select("chain", F.col("block").alias("head"))
    return anchors.join(alive, "chain", "left").select("chain", F.coalesce("head", "block").alias("block"))


def orphan_suspects(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """chain, block, number: pending nodes at most one above the anchor, which must descend from below it."""
    low = nodes.join(F.broadcast(anchors.select("chain", F.col("number").alias("height"))), "chain").where("number <= height + 1")
    return low.join(F.broadcast(anchors.select(*KEY)), KEY, "left_anti").join(connected(nodes, anchors), KEY, "left_anti").select("chain", "block", "number")


def orphaned(anchors: DataFrame, probes: DataFrame) -> DataFrame:
    """chain, block, number of the new anchor where a probe at the anchor's height names another block.

    Such a chain starts anew without nodes, its registries stay; probes at other heights are stale.
    """
    own = anchors.select("chain", "number", F.col("block").alias("was"))
    return probes.join(own, ["chain", "number"]).where("block <> was").select("chain", "block", "number").distinct()


def seeded(window: DataFrame, anchors: DataFrame, tip_trim: int) -> DataFrame:
    """chain, block, parent, number, filler: blocks above the anchor linked by number, gaps bridged by a filler each.

    Of several blocks of a number the first (by seq) counts; the top ``tip_trim`` numbers are left out.
    A filler stands below the block after the gap; its name is a digest of the two that it links.
    """
    roots = F.broadcast(anchors.select("chain", F.col("number").alias("root"), F.col("block").cast("string").alias("root_block")))  # one row for each chain
    once = window.join(roots, "chain").where("number > root").groupBy("chain", "number").agg(F.min_by("block", "seq").cast("string").alias("block"))
    once = cut(once)
    tips = once.groupBy("chain").agg(F.max("number").alias("tip"))
    kept = once.join(F.broadcast(tips), "chain").where(F.col("number") <= F.greatest(F.col("tip") - tip_trim, F.lit(0))).drop("tip")
    linked = with_previous(kept, "chain", "number", ["block"]).join(roots, "chain")
    below, low = F.coalesce("before.block", "root_block"), F.coalesce("before.number", "root")
    linked = linked.select("chain", "block", "number", below.alias("below"), (F.col("number") > low + 1).alias("gap"))
    name = F.sha2(F.concat_ws("|", F.lit("filler"), "below", "block"), 256)
    own = F.struct("block", F.when(F.col("gap"), name).otherwise(F.col("below")).alias("parent"), "number", F.lit(False).alias("filler"))
    bridge = F.struct(name.alias("block"), F.col("below").alias("parent"), (F.col("number") - 1).alias("number"), F.lit(True).alias("filler"))
    return linked.select("chain", F.explode(F.when(F.col("gap"), F.array(bridge, own)).otherwise(F.array(own))).alias("node")).select("chain", "node.*")


def unreadable_ranges(path: DataFrame, excluded: DataFrame, least: int) -> DataFrame:
    """chain, first, last: runs of numbers on ``path`` whose blocks must be fetched; excluded (chain, number) ones split runs."""
    hole = path.where(_blocks_fold(least)).select("chain", "number").join(excluded, ["chain", "number"], "left_anti")
    hole = cut(hole.distinct())
    beside = lambda by: hole.select("chain", (F.col("number") + by).alias("number"))
    first, last = (hole.join(beside(by), ["chain", "number"], "left_anti") for by in (1, -1))
    # Firsts and lasts alternate: the row before a last is the first of its run.
    ends = first.select("chain", (F.col("number") * 2).alias("at")).union(last.select("chain", (F.col("number") * 2 + 1).alias("at")))
    return with_previous(ends, "chain", "at", []).where("at % 2 <> 0").select("chain", F.expr("before.at div 2").alias("first"), F.expr("at div 2").alias("last"))


def refreshes(lengths: DataFrame, target: int, stride: int) -> DataFrame:
    """chain, seq, length, refresh: where a path's length reaches the target or a further stride beyond it.

    Not while it is unknown (null) or below the target; from an unknown or shorter one, at once.
    """
    before, bucket = F.col("before.length"), lambda c: F.floor((c - target) / stride)
    edge = before.isNull() | (before < target) | (bucket(before) < bucket(F.col("length")))
    return with_previous(lengths, "chain", "seq", ["length"]).select("chain", "seq", "length", F.coalesce((F.col("length") >= target) & edge, F.lit(False)).alias("refresh"))


def frontier_changes(frontiers: DataFrame) -> DataFrame:
    """chain, seq, frontier: the readings that differ from the last that wasn't null."""
    known = frontiers.where("frontier is not null")
    return with_previous(known, "chain", "seq", ["frontier"]).where(~F.col("frontier").eqNullSafe(F.col("before.frontier"))).select("chain", "seq", "frontier")


def candidate_owners(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """chain, pool_id, block: pools that no registry knows (chain, pool_id), each owned by the newest block that names it."""
    return candidates.groupBy("chain", "pool_id").agg(F.min_by("block", "depth").alias("block")).join(known, ["chain", "pool_id"], "left_anti")


def unknown_tokens(candidates: DataFrame, metadata: DataFrame, known: DataFrame) -> DataFrame:
    """chain, token: tokens of candidates that have metadata (chain, pool_id, token0, token1), without those known."""
    pairs = candidates.select("chain", "pool_id").distinct().join(metadata, ["chain", "pool_id"])
    return pairs.select("chain", F.explode(F.array("token0", "token1")).alias("token")).distinct().join(known, ["chain", "token"], "left_anti")
