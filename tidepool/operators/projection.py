"""Pool states as the reserves that routes are made of: scaled by decimals, with fee multiplier and swap limits, or a typed failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import ticks, wide

#: Decimals beyond this have no scale in the reference's number type (fixed value).
MOST_DECIMALS = 36


def fee_multiplier(fee_pips: Column) -> Column:
    """What a fee leaves of an amount, in single precision."""
    return (F.lit(1).cast("float") - (fee_pips / 1e6).cast("float")).cast("double")


def projected(states: DataFrame, decimals: DataFrame, price: Column | str = "price") -> DataFrame:
    """chain, pool_id, token0, token1, fee_pips, r0, r1, fee, max0, max1, failure, failed_token and failed_field of every pool whose tokens are known.

    ``states``: chain, pool_id, token0, token1, fee_pips, tick_spacing, tick, liquidity and price (decimal text, Q64.96),
    unless ``price`` is made of the others; ``decimals``: token and decimals.  Pools with a token that has no decimals, or more than
    ``MOST_DECIMALS``, aren't there.  Reserves are computed in whole units without limit of size and
    rounded once, to single precision.  Failures come in the order reserve0, reserve1, max_swap0,
    max_swap1: ``swap_limit`` where the price lies outside the tick's range, ``overflow`` beyond single
    precision, ``bad_tick`` where a bound of the range has no price.
    """
    known = decimals.where(F.col("decimals").between(0, MOST_DECIMALS))
    rows = states
    for side in ("0", "1"):
        rows = rows.join(known.select(F.col("token").alias(f"token{side}"), F.col("decimals").alias(f"d{side}")), f"token{side}")
    low = ticks.tick_floor(F.col("tick"), F.col("tick_spacing"))
    rows = rows.withColumns({"price": F.col(price) if isinstance(price, str) else price, "low": ticks.sqrt_price_text(low), "high": ticks.sqrt_price_text(low + F.col("tick_spacing"))})
    rows = rows.withColumn("p", wide.projection(F.col("liquidity").cast("string"), "price", "low", "high", "d0", "d1"))
    token = F.when(F.col("p.field").isin("reserve0", "max_swap0"), F.col("token0")).when(F.col("p.field").isNotNull(), F.col("token1"))
    return rows.select("chain", "pool_id", "token0", "token1", "fee_pips", "p.r0", "p.r1", fee_multiplier(F.col("fee_pips")).alias("fee"), "p.max0", "p.max1", "p.failure", token.alias("failed_token"), F.col("p.field").alias("failed_field"))
