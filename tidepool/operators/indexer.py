"""Responses of indexers and lists as JSON: pool keys, popular tokens, baseline tokens, claims against a factory, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.decode import key_outcomes
from tidepool.sources.market import TIERS

MOST_FEE, LEAST_TICK, MOST_TICK = 2**24 - 1, -(2**23), 2**23 - 1
POOLS = "data struct<pools: array<struct<id: string, token0: struct<id: string>, token1: struct<id: string>, feeTier: string, tickSpacing: string, hooks: string>>>, errors array<struct<message: string>>, _corrupt string"
TOKENS = "included array<struct<type: string, attributes: struct<address: string, symbol: string, decimals: int, coingecko_coin_id: string>>>, _corrupt string"
#: USDC and wrapped ether of each chain (fixed values); the native token is the zero address.
BASELINE = {
    "ethereum": ("a0b86991c6218b36c1d19d4a2e9eb0ce3606eb48", "c02aaa39b223fe8d0a0e5c4f27ead9083c756cc2"),
    "arbitrum": ("af88d065e77c8cc2239327c5edb3a432268e5831", "82af49447d8a07e3bd95bd0d56f35241523fbab1"),
    "base": ("833589fcd6edb6e08f4c7c32d4f71b54bda02913", "4200000000000000000000000000000000000006"),
    "optimism": ("0b2c639c533813f4aa9d7837caf62653d097ff85", "4200000000000000000000000000000000000006"),
    "polygon": ("3c499c542cef5e3811e1192ce70d8cc03d5c3359", "7ceb23fd6bc0add59e62ac25578270cff1b9f619"),
    "bnb": ("8ac76a51cc950d9822d68b83fe1ad97b32cd580d", "2170ed0880ac9a755fd29b2688956bd959f933f8"),
    "avalanche": ("b97ef9ef8734c71904d8002f8b6bc66dd9c48a6e", "49d5c2bdffac6ce2bfdb6640f4f80f226bc10bab"),
}


def _parsed(bodies: DataFrame, schema: str) -> DataFrame:
    return bodies.withColumn("parsed", F.from_json("body", schema, {"columnNameOfCorruptRecord": "_corrupt"}))


def _whole(text: Column, digits: str, low: int, high: int) -> Column:
    """The number that a text holds, null if it holds none between the bounds."""
    number = F.when(text.rlike(f"^{digits}$"), text.try_cast("long"))
    return F.when(number.between(low, high), number)


def pool_responses(responses: DataFrame, requested: DataFrame) -> DataFrame:
    """chain, response, fault and entries of each response (chain, response, body).

    fault: malformed (no JSON, or an entry without a field), errors, no_data, bad_number (of a requested
    entry: no fee of 24 bits, no spacing of 24 bits with sign), else null; a faulty response has no entries.
    Entries that weren't asked for (chain, id) are dropped; ids that are asked for and absent are left out.
    """
    rows = _parsed(responses, POOLS)
    lacks = lambda e: e.id.isNull() | e.token0.id.isNull() | e.token1.id.isNull() | e.feeTier.isNull() | e.tickSpacing.isNull() | e.hooks.isNull()
    pools = F.col("parsed.data.pools")
    fault = (
        F.when(F.col("parsed").isNull() | F.col("parsed._corrupt").isNotNull() | F.coalesce(F.exists(pools, lacks), F.lit(False)), "malformed")
        .when(F.size(F.coalesce("parsed.errors", F.array())) > 0, "errors").when(F.col("parsed.data").isNull(), "no_data").when(pools.isNull(), "malformed")
    )
    rows = rows.select("chain", "response", fault.alias("fault"), F.when(fault.isNull(), pools).alias("pools"))
    entries = rows.select("chain", "response", F.explode("pools").alias("e")).select(
        "chain", "response", F.col("e.id").alias("id"), F.col("e.token0.id").alias("currency0"), F.col("e.token1.id").alias("currency1"),
        _whole(F.col("e.feeTier"), r"\+?[0-9]+", 0, MOST_FEE).alias("fee"), _whole(F.col("e.tickSpacing"), "[+-]?[0-9]+", LEAST_TICK, MOST_TICK).alias("tick_spacing"), F.col("e.hooks").alias("hooks"),
    ).join(requested.select("chain", "id").distinct(), ["chain", "id"], "left_semi")
    entry = F.struct("id", "currency0", "currency1", "fee", "tick_spacing", "hooks")
    wrong = (F.col("fee").isNull() | F.col("tick_spacing").isNull()).alias("wrong")
    found = entries.select("chain", "response", entry.alias("entry"), wrong).groupBy("chain", "response").agg(F.bool_or("wrong").alias("wrong"), F.collect_list("entry").alias("entries"))
    rows = rows.drop("pools").join(found, ["chain", "response"], "left")
    fault = F.coalesce("fault", F.when(F.col("wrong"), "bad_number"))
    return rows.select("chain", "response", fault.alias("fault"), F.when(fault.isNull(), F.coalesce("entries", F.array())).alias("entries"))


def pool_metadata(responses: DataFrame, requested: DataFrame) -> DataFrame:
    """chain, id, currency0, currency1, fee, tick_spacing, hooks and outcome (as in ``key_outcomes``) of the entries that responses hold."""
    entries = pool_responses(responses, requested).select("chain", F.explode("entries").alias("e")).select("chain", "e.*")
    return key_outcomes(entries).drop("derived")


def popular_tokens(pages: DataFrame) -> DataFrame:
    """page, token, symbol, decimals, trusted of the pages (page, body): included items of the type token.

    A page that is no JSON, or holds an item without a type or address or with decimals outside a byte, is skipped.
    """
    items = F.col("parsed.included")
    bad = F.exists(items, lambda i: i.type.isNull() | i.attributes.address.isNull() | ~F.coalesce(i.attributes.decimals.between(0, 255), F.lit(True)))
    rows = _parsed(pages, TOKENS).where(F.col("parsed").isNotNull() & F.col("parsed._corrupt").isNull() & ~F.coalesce(bad, F.lit(False)))
    found = rows.select("page", F.explode(items).alias("i")).where("i.type = 'token'")
    return found.select("page", F.lower("i.attributes.address").alias("token"), "i.attributes.symbol", F.col("i.attributes.decimals").cast("long").alias("decimals"), F.col("i.attributes.coingecko_coin_id").isNotNull().alias("trusted"))


def baseline(spark: SparkSession) -> DataFrame:
    """chain, token: what is always proposed and trusted."""
    return spark.createDataFrame([(chain, token) for chain, own in BASELINE.items() for token in (own[0], "0" * 40, own[1])], "chain string, token string")


def factory_outcomes(claims: DataFrame, factory: DataFrame) -> DataFrame:
    """Claims (chain, pool, token0, token1, fee) with outcome: a fee of a tier, and the same pool at the factory; a factory without one answers with another."""
    rows = claims.join(factory.select("chain", "token0", "token1", "fee", F.col("pool").alias("own")), ["chain", "token0", "token1", "fee"], "left")
    outcome = F.when(~F.coalesce(F.col("fee").isin(*TIERS), F.lit(False)), "unsupported_tier").when(~F.col("pool").eqNullSafe(F.col("own")), "factory_mismatch").otherwise("ok")
    return rows.select("chain", "pool", outcome.alias("outcome"))


def split_bridges(bridges: DataFrame, allowed: DataFrame, source: int) -> DataFrame:
    """Bridges (token_in, token_out) with ``kept``: whether both ends are allowed.  A source that isn't allowed is an error."""
    tokens = allowed.select("token").distinct()
    if tokens.where(F.col("token") == source).isEmpty():
        raise ValueError(f"the source token {source} is not allowed")
    rows = bridges.select("token_in", "token_out").distinct()
    for end in ("token_in", "token_out"):
        rows = rows.join(tokens.select(F.col("token").alias(end), F.lit(True).alias(f"has_{end}")), end, "left")
    return rows.select("token_in", "token_out", (F.col("has_token_in").isNotNull() & F.col("has_token_out").isNotNull()).alias("kept"))
