"""Registries, whitelists and projections over validated metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def registry_view(results: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """key, status and seq: verified once any result is ok (later failures don't undo it), else rejected."""
    at = F.struct(*order)
    rows = results.groupBy(key).agg(F.max(F.when(F.col("ok"), at)).alias("good"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n_results"))
    return rows.select(key, F.when(F.col("good").isNotNull(), "verified").otherwise("rejected").alias("status"), F.coalesce("good", "last")[order[-1]].alias("decided_by"), "n_results")


def whitelist_gate(pools: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Pools both of whose tokens are allowed; no table allows all, an empty one allows none."""
    if allowed is None:
        return pools
    tokens = allowed.select("token").distinct()
    for side in ("token0", "token1"):
        pools = pools.join(tokens.withColumnRenamed("token", side), side, "left_semi")
    return pools


def referenced_tokens(pools: DataFrame) -> DataFrame:
    return pools.select("chain", F.explode(F.array("token0", "token1")).alias("token")).distinct()


def directional(reserves: DataFrame) -> DataFrame:
    """Both directions of every reserve row, each with the limit of what enters."""
    way = lambda a, b: F.struct(F.col(f"token{a}").alias("token_in"), F.col(f"token{b}").alias("token_out"), F.col(f"r{a}").alias("r_in"), F.col(f"r{b}").alias("r_out"), F.col(f"max{a}").alias("cap"))
    rows = reserves.select("chain", "pool_id", "fee", F.inline(F.array(way(0, 1), way(1, 0))))  # not a union, which would derive the reserves twice
    return rows.select("chain", "pool_id", "token_in", "token_out", "r_in", "r_out", "fee", "cap")


def all_or_nothing(rows: DataFrame, group: str, good: Column) -> DataFrame:
    """Rows of the groups in which every row is good."""
    bad = rows.where(~F.coalesce(good, F.lit(False))).select(group).distinct()
    return rows.join(bad, group, "left_anti")


def gated(results: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """``results`` (ok, failure, token0, token1 and others) with outcome and reason_token after the whitelist.

    Failures pass through; of a pool's tokens the first that isn't allowed is the reason.  No table allows
    all, an empty one none.
    """
    failed = F.when(~F.coalesce("ok", F.lit(False)), F.coalesce("failure", F.lit("failed")))
    if allowed is None:
        return results.withColumns({"outcome": F.coalesce(failed, F.lit("ok")), "reason_token": F.lit(None).cast(results.schema["token0"].dataType)})
    tokens, rows = allowed.select("token").distinct(), results
    for side in ("0", "1"):
        rows = rows.join(tokens.select(F.col("token").alias(f"token{side}"), F.lit(True).alias(f"_in{side}")), f"token{side}", "left")
    first = F.when(F.col("_in0").isNull(), F.col("token0")).when(F.col("_in1").isNull(), F.col("token1"))
    reason = F.when(failed.isNull(), first)
    outcome = F.coalesce(failed, F.when(reason.isNotNull(), "token_not_whitelisted"), F.lit("ok"))
    return rows.withColumns({"outcome": outcome, "reason_token": reason}).select(*results.columns, "outcome", "reason_token")


def whole_chains(states: DataFrame, decimals: DataFrame) -> DataFrame:
    """``states`` (chain, token0, token1, tick and others) with decimals0 and decimals1, of the chains in which no pool lacks a state or decimals."""
    rows = states
    for side in ("0", "1"):
        rows = rows.join(decimals.select(F.col("token").alias(f"token{side}"), F.col("decimals").alias(f"decimals{side}")), f"token{side}", "left")
    there = F.col("tick").isNotNull() & F.col("decimals0").isNotNull() & F.col("decimals1").isNotNull()
    return all_or_nothing(rows, "chain", there).select(*states.columns, "decimals0", "decimals1")


def catalog_tokens(pools: DataFrame, tokens: DataFrame) -> DataFrame:
    """chain, token, decimals of the tokens that verified pools name and a registry row validates; the native token needs a row too."""
    return referenced_tokens(pools).join(tokens.select("chain", "token", "decimals"), ["chain", "token"])
