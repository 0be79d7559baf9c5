"""Checks before routing and fetching: pages, coverage, snapshot errors, bridges; codecs of storage words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands around the target's address in the code of a minimal proxy (fixed values of EIP-1167).
PROXY = ("363d3d373d3d3d363d73", "5af43d82803e903d91602b57fd5bf3")
MOST_DECIMALS = 36


def pages(blocks: DataFrame, sizes: dict[int, int], other: int) -> DataFrame:
    """chain, page_from, page_to: inclusive windows over each chain's blocks, of its own size."""
    size = F.lit(other)
    for chain, n in sizes.items():
        size = F.when(F.col("chain") == chain, n).otherwise(size)
    ends = blocks.groupBy("chain").agg(F.min("number").alias("lo"), F.max("number").alias("hi")).withColumn("size", size.cast("long"))
    return ends.select("chain", "hi", "size", F.explode(F.sequence("lo", "hi", "size")).alias("page_from")).select("chain", "page_from", F.least(F.col("page_from") + F.col("size") - 1, F.col("hi")).alias("page_to"))


def coverage(reserves: DataFrame, keys: Sequence[str], source: int, output: int) -> DataFrame:
    """Whether any row gives the output token, and whether any touches the source on either side."""
    at_source = (F.col("token0") == source) | (F.col("token1") == source)
    return reserves.groupBy(*keys).agg(F.bool_or(F.col("token1") == output).alias("to_output"), F.bool_or(at_source).alias("at_source"))


def validate(asked: DataFrame, reserves: DataFrame, source: int, output: int) -> DataFrame:
    """chain, outcome of each request (chain, amount): the first error in a fixed order, or ok."""
    rows = reserves.groupBy("chain", "pool_id", "token0", "token1").agg(F.count(F.lit(1)).alias("n"))
    repeats = rows.groupBy("chain").agg(F.max("n").alias("n"))
    joined = asked.join(repeats, "chain", "left").join(coverage(reserves, ["chain"], source, output), "chain", "left")
    outcome = F.when(~F.coalesce(F.col("amount") > 0, F.lit(False)), "bad_amount").when(F.col("n").isNull(), "empty").when(F.col("n") > 1, "duplicate").when(~F.col("to_output"), "no_output").when(~F.col("at_source"), "no_source").otherwise("ok")
    return joined.select("chain", outcome.alias("outcome"))


def bridges(pairs: DataFrame, decimals: DataFrame) -> DataFrame:
    """token, other, outcome: a bridge needs known and equal decimals on both sides."""
    own = decimals.withColumnRenamed("decimals", "d0")
    far = decimals.select(F.col("token").alias("other"), F.col("decimals").alias("d1"))
    joined = pairs.join(own, "token", "left").join(far, "other", "left")
    outcome = F.when(F.col("d0").isNull() | F.col("d1").isNull(), "unknown_decimals").when(F.col("d0") != F.col("d1"), "decimals_differ").otherwise("ok")
    return joined.select("token", "other", outcome.alias("outcome"))


def quantity(number: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(number)))


def word_address(word: Column) -> Column:
    return F.right(word, F.lit(40))


def word_decimals(word: Column) -> Column:
    """The number in a word of hex digits; null above 36.  A word of zeros is 0."""
    digits = F.ltrim(word, F.lit("0"))
    number = F.conv(F.when(F.length(digits) <= 4, F.concat(F.lit("0"), digits)), 16, 10).cast("long")
    return F.when(number <= MOST_DECIMALS, number)


def proxy_target(code: Column) -> Column:
    """The address that a minimal proxy forwards to; empty for other code."""
    return F.regexp_extract(code, f"^{PROXY[0]}([0-9a-f]{{40}}){PROXY[1]}$", 1)


def slot_target(code: Column, implementation: Column, beacon: Column) -> Column:
    """Where a contract forwards to: a minimal proxy's target, else the address in its implementation slot, else in its beacon slot.

    Slots are words of 64 hex digits, null where reading failed; words of another form and zero addresses lead nowhere.
    """
    address = lambda word: F.when(word.rlike("^[0-9a-fA-F]{64}$"), F.lower(word_address(word)))
    code_target = proxy_target(F.lower(code))
    found = F.coalesce(F.when(code_target != "", code_target), address(implementation), address(beacon))
    # As the readers do: the first that gives an address decides, and only then is zero none.
    return F.when(found != "0" * 40, found)


def transient(outcome: Column) -> Column:
    """Whether a snapshot's error goes by itself: its route's ends just aren't there yet."""
    return outcome.isin("empty", "no_source", "no_output")
