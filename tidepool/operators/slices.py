"""Answers to requests for the state of pools: one entry for each asked pool, in order, or the fault of the whole request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.cache import PROTOCOLS
from tidepool.operators.frames import hex_bytes

#: Bytes of a pool's id by protocol.
ID_BYTES = {name: digits // 2 for name, (_, digits) in PROTOCOLS.items()}


def answers(asked: DataFrame, states: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request, status, block_hash, confirmations) of every request, and the entries of those with status 200.

    ``asked``: request, chain, ordinal, protocol and id (0x and digits; a request without pools has one row with a null
    ordinal); ``states``: chain, protocol, id (digits), sqrt_price, tick, liquidity; ``chains``: chain, anchored, frontier and behind.
    503 before the chain has an anchor, then 400 if any id is malformed or of an unknown protocol.  Entries:
    request, ordinal, protocol, id, completeness, sqrt_price, tick, liquidity; repeated ids are answered each.
    Confirmations are 0 where the lag is unknown.
    """
    known = F.coalesce(*(F.when(F.col("protocol") == name, hex_bytes(F.col("id"), size)) for name, size in ID_BYTES.items()))
    rows = asked.withColumn("key", known)
    bad = F.bool_or(F.col("ordinal").isNotNull() & F.col("key").isNull())
    requests = rows.groupBy("request", "chain").agg(bad.alias("bad")).join(chains, "chain", "left")
    status = F.when(~F.coalesce("anchored", F.lit(False)), 503).when(F.col("bad"), 400).otherwise(200)
    requests = requests.withColumn("status", status)
    served = F.col("status") == 200
    heads = requests.select("request", "status", F.when(served, F.col("frontier")).alias("block_hash"), F.when(served, F.coalesce("behind", F.lit(0)).cast("long")).alias("confirmations"))
    found = states.select("chain", "protocol", F.lower("id").alias("key"), "sqrt_price", "tick", "liquidity")
    whole = rows.where("ordinal is not null").join(requests.where(served).select("request"), "request", "left_semi").join(found, ["chain", "protocol", "key"], "left")
    there = F.when(F.col("tick").isNull(), "incomplete").otherwise("complete")
    return heads, whole.select("request", "ordinal", "protocol", "id", there.alias("completeness"), "sqrt_price", "tick", "liquidity")
