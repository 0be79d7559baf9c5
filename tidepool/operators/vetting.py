"""Offline token vetting: merge candidates, flag risks, decide by an ordered list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_TVL = 10_000


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One row for each token: the first non-null value by source order, for a TVL the first that is above 0; trusted if any source says so."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("source_order", c)))[c]
    rows = candidates.withColumn("tvl", F.when(~F.isnan("tvl") & (F.col("tvl") > 0), F.col("tvl")))
    return rows.groupBy("token").agg(first("symbol").alias("symbol"), first("tvl").alias("tvl"), F.max("trusted").alias("trusted"), F.count(F.lit(1)).alias("n_sources"))


#: Risk flag -> what a lower-cased source text holds (fixed values, in the order of flags).
SOURCE_RISKS = {
    "transfer-tax": ("buytax", "selltax", "transfertax", "transferfee", "taxfee", "feeontransfer", "takefee", "_tax", "liquidityfee", "marketingfee"),
    "blacklist": ("blacklist", "isblacklisted", "botlist"),
    "trading-gate": ("tradingenabled", "enabletrading", "tradingopen", "cooldown", "maxwallet", "maxtransaction", "maxtx", "antibot"),
    "rebase-or-reflection": ("rebase", "reflection", "_rowned", "_towned", "deliver("),
    "pausable": ("pausable", "paused", "pause()"),
    "upgradeable": ("delegatecall", "upgradeability", "upgradeable", "implementation"),
}
NATIVE = "0" * 40


def contract_flags(source: Column) -> Column:
    """Names of the risks that a contract's source shows, in fixed order; empty for a null (only A-Z are lowered)."""
    text = F.translate(source, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [F.when(F.coalesce(F.greatest(*(F.contains(text, F.lit(n)) for n in needles)), F.lit(False)), F.lit(flag)) for flag, needles in SOURCE_RISKS.items()]
    return F.array_compact(F.array(*found))


def examine(candidates: DataFrame, exceptions: DataFrame, listed: DataFrame) -> DataFrame:
    """token, approved, reason, decimals: the first rung that holds decides.

    ``candidates``: token (40 hex digits), decimals (claimed), trusted, tvl, and the evidence:
    inspect_error, code (hex digits), chain_decimals, proxy_target, source.  A managed exception
    (token) needs no code or decimals, a listed token no TVL.  Rows without evidence have null columns.
    """
    managed = exceptions.select("token", F.lit(True).alias("managed")).distinct()
    popular = listed.select("token", F.lit(True).alias("listed")).distinct()
    rows = candidates.join(managed, "token", "left").join(popular, "token", "left").withColumn("flags", contract_flags(F.col("source")))
    on_chain, claimed = F.col("chain_decimals"), F.col("decimals")
    unpopular = ~(F.coalesce(F.col("tvl") >= LEAST_TVL, F.lit(False)) | F.coalesce("listed", F.lit(False)))
    reason = (
        F.when(F.col("token") == NATIVE, "native").when(F.col("inspect_error").isNotNull(), "inspection_failed").when(F.col("managed"), "managed_exception")
        .when(F.coalesce("code", F.lit("")).isin("", "0"), "no_code").when(on_chain.isNull(), "no_decimals").when(claimed != on_chain, "decimals_disagree")
        .when(F.col("proxy_target").isNotNull(), "proxy").when(F.col("source").isNull(), "unverified_source").when(~F.coalesce("trusted", F.lit(False)), "not_trusted")
        .when(unpopular, "unpopular").when(F.size("flags") > 0, F.concat(F.lit("risk:"), F.array_join("flags", ","))).otherwise("plain")
    )
    out = rows.withColumn("reason", reason).withColumn("approved", F.col("reason").isin("native", "managed_exception", "plain"))
    return out.select("token", "approved", "reason", F.when(F.col("reason") == "native", 18).when(F.col("approved"), on_chain).alias("decimals"))
