"""Token-graph pruning to what can lie on a route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.plans.lineage import cut, drop


def _edges(pools: DataFrame, source: int, output: int, bridges: DataFrame | None) -> DataFrame:
    """edge, a, b: one for each pool, for each pair of bridged tokens in either order, and between source and output if they differ.

    ``edge`` is a struct of kind and number, unique.
    """
    name = lambda kind, *of: F.struct(F.lit(kind).alias("kind"), *(c.alias(n) for c, n in zip(of, ("one", "two"), strict=True)))
    none = F.lit(None).cast("long")
    out = pools.select(name("pool", F.col("pool_id").cast("long"), none).alias("edge"), F.col("token0").alias("a"), F.col("token1").alias("b"))
    if bridges is not None:
        low, high = F.least("token_in", "token_out"), F.greatest("token_in", "token_out")
        pairs = bridges.where("token_in <> token_out").select(low.alias("a"), high.alias("b")).distinct()
        out = out.unionByName(pairs.select(name("bridge", F.col("a").cast("long"), F.col("b").cast("long")).alias("edge"), "a", "b"))
    if source != output:
        one = pools.sparkSession.range(1).select(name("demand", none, none).alias("edge"), F.lit(source).cast("long").alias("a"), F.lit(output).cast("long").alias("b"))
        out = out.unionByName(one)
    return out


def _dangling(left: DataFrame) -> DataFrame | None:
    """edge of every edge on a path of tokens with two edges that begins at a token with one; None if no token has one.

    A dart is an edge in one direction.  Before the dart that leaves a token with two edges comes the one
    that enters it by the other edge; doubling these pointers finds where each path begins.
    """
    darts = left.select("edge", F.col("a").alias("start"), F.col("b").alias("to")).union(left.select("edge", "b", "a"))
    ends = darts.groupBy("start").agg(F.count(F.lit(1)).alias("degree"), F.min(F.struct("edge", "to")).alias("one"), F.max(F.struct("edge", "to")).alias("two"))
    ends = cut(ends.where("degree <= 2"))
    leaves = ends.where("degree = 1").select("one.edge", "start")
    if leaves.isEmpty():
        drop(ends)
        return None
    two = ends.where("degree = 2")
    before = lambda own, other: two.select(f"{own}.edge", "start", F.col(f"{other}.edge").alias("p_edge"), F.col(f"{other}.to").alias("p_start"))
    found, going = cut(leaves), cut(before("one", "two").union(before("two", "one")))
    every = [found]
    while True:
        # A pointer to a leaf's dart has arrived, one to a dart still under way takes over its pointer, any other leads nowhere.
        home = found.select(F.col("edge").alias("p_edge"), F.col("start").alias("p_start"))
        fresh = cut(going.join(home, ["p_edge", "p_start"], "left_semi").select("edge", "start"))
        if fresh.isEmpty():
            break
        every.append(fresh)
        ahead = going.select(F.col("edge").alias("p_edge"), F.col("start").alias("p_start"), F.col("p_edge").alias("n_edge"), F.col("p_start").alias("n_start"))
        moved = cut(going.join(fresh, ["edge", "start"], "left_anti").join(ahead, ["p_edge", "p_start"]).select("edge", "start", F.col("n_edge").alias("p_edge"), F.col("n_start").alias("p_start")))
        drop(going)
        found, going = cut(found.union(fresh)), moved
        every.append(found)
    out = cut(found.select("edge").distinct())
    drop(ends, going, fresh, *every)
    return out


def components(links: DataFrame) -> DataFrame:
    """token, component: the smallest token that each can reach over ``links`` (a, b), in about log(longest path) rounds."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("token", "to"))
    labels = cut(both.groupBy("token").agg(F.min("to").alias("to")).select("token", F.least("token", "to").alias("component")))
    while True:
        near = both.join(labels.select(F.col("token").alias("to"), F.col("component").alias("near")), "to").groupBy("token").agg(F.min("near").alias("near"))
        step = cut(labels.join(near, "token").select("token", F.col("component").alias("was"), F.least("component", "near").alias("component")))
        jump = step.select(F.col("token").alias("component"), F.col("component").alias("up"))
        after = cut(step.join(jump, "component", "left").select("token", F.coalesce("up", "component").alias("component"), "was"))
        drop(labels, step)
        labels = after
        if labels.where("component <> was").isEmpty():
            drop(both)
            return labels.select("token", "component")


def two_core(edges: DataFrame, source: int, output: int, bridges: DataFrame | None = None) -> DataFrame:
    """Edges (pool_id, token0, token1) that survive removing tokens of degree 1, again and again.

    A virtual edge joins source and output, so an open path counts as a cycle.  Parallel pools
    count each, the two directions of one pool once; self-loops never lie on a route.  ``bridges``
    (token_in, token_out) are edges too, once for both orders.  Of what is left, the part
    that is connected with the source stays; if that is no pool, or the source itself is removed, the
    input is returned.  A round removes whole dangling paths, and at least halves the dangling ends.
    """
    pairs = edges.where("token0 <> token1").withColumns({"low": F.least("token0", "token1"), "high": F.greatest("token0", "token1")})
    pools = cut(pairs.dropDuplicates(["pool_id", "low", "high"]).select("pool_id", "token0", "token1"))
    left = cut(_edges(pools, source, output, bridges))
    while (gone := _dangling(left)) is not None:
        after = cut(left.join(gone, "edge", "left_anti"))
        drop(left, gone)
        left = after
    whole = components(left)
    own = whole.where(F.col("token") == source).select("component").join(whole, "component").select("token")
    kept = cut(own)
    for side in ("token0", "token1"):
        pools = pools.join(kept.withColumnRenamed("token", side), side, "left_semi")
    pools = cut(pools.select("pool_id", "token0", "token1"))
    return edges.select("pool_id", "token0", "token1") if pools.isEmpty() else pools


def reachable(edges: DataFrame, source: int) -> DataFrame:
    """token, hops: fewest pools from the source, in breadth-first rounds."""
    both = cut(edges.select("token0", "token1").union(edges.select("token1", "token0")).toDF("token", "to").distinct())
    seen = cut(edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("token"), F.lit(0).cast("long").alias("hops")))
    fresh, hop = seen, 0
    while True:
        hop += 1
        near = fresh.join(both, "token").select(F.col("to").alias("token")).distinct().join(seen, "token", "left_anti")
        fresh = cut(near.withColumn("hops", F.lit(hop).cast("long")))
        if fresh.isEmpty():
            return seen
        after = cut(seen.union(fresh))
        drop(seen)
        seen = after
