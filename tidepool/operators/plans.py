"""Execution plans: build from flows, replay in stages, verify against exact reserves.

A plan's steps are a column set: plan_id, stage, token_in, token_out, kind (swap, carry, bridge),
pool_id, weight.  Plans are spread over tasks by id and stream through each in order: a task holds the
steps of one plan, as many as its layout has cells, which doesn't grow with the number of plans.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.wide import BILLION, MILLION, fixed_share

LEAST_WEIGHT = 0.01
EPSILON = np.finfo(np.float32).eps
LARGEST = (1 << 256) - 1


def build(flows: DataFrame, bridges: DataFrame, least_weight: float = LEAST_WEIGHT) -> DataFrame:
    """Steps of flows (plan_id, stage, token_in, token_out, pool_id, weight, amount_in, amount_out), weights adding up to 1 at every (plan, stage, token_in).

    A configured bridge (token_in, token_out) goes before the pool at its cell; without a pool a token
    carries to itself, and other cells are padding and go.  Small flows go before equal ones are merged.
    """
    pairs = bridges.select("token_in", "token_out", F.lit(True).alias("bridged")).where("token_in <> token_out").distinct()
    kind = F.when(F.col("bridged"), "bridge").when(F.col("pool_id").isNotNull(), "swap").when(F.col("token_in") == F.col("token_out"), "carry")
    rows = flows.join(pairs, ["token_in", "token_out"], "left").withColumn("kind", kind).where(F.col("kind").isNotNull() & ~(F.col("weight") < least_weight))
    rows = rows.withColumn("pool_id", F.when(F.col("kind") == "swap", F.col("pool_id")))
    steps = rows.groupBy("plan_id", "stage", "token_in", "token_out", "kind", "pool_id").agg(*(F.sum(c).alias(c) for c in ("weight", "amount_in", "amount_out")))
    total = F.sum("weight").over(Window.partitionBy("plan_id", "stage", "token_in"))
    return steps.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(0.0))


class PoolMissing(Exception):
    """A step names a pool without reserves."""


class TokenMissing(Exception):
    """A step enters a pool with a token that it doesn't hold."""


def _stages(steps: list, source, output, entry, zero, portion: Callable, swap: Callable):
    """What reaches the output token: every stage reads the balances the last one wrote, and what no step routes is gone.

    Stages count from 0; one without steps passes nothing on.
    """
    balances = defaultdict(lambda: zero, {source: entry})
    for place, (number, stage) in enumerate(groupby(steps, attrgetter("stage"))):
        if number != place:
            return zero
        after = defaultdict(lambda: zero)
        for step in stage:
            amount = portion(balances[step.token_in], step.weight)
            if amount <= 0:
                continue
            if step.kind == "swap":
                after[step.token_out] += swap(step.pool_id, step.token_in, amount)
            elif step.kind == "bridge" or step.token_in == step.token_out:
                after[step.token_out] += amount
        balances = after
    return balances[output]


def _single(pools: dict, pool, token, amount):
    if pool not in pools:
        raise PoolMissing
    tokens, reserves, caps, fee = pools[pool]
    if token not in tokens:
        raise TokenMissing
    i = tokens.index(token)
    used = min(np.float32(amount * fee), caps[i])
    out = max(np.float32(reserves[1 - i] * used / (reserves[i] + used + EPSILON)), np.float32(0))
    reserves[i] += amount
    reserves[1 - i] -= out
    return out


def _exact(pools: dict, hit: list, pool, token, amount):
    if pool not in pools:
        raise PoolMissing
    tokens, reserves, caps, fee = pools[pool]
    if token not in tokens:
        raise TokenMissing
    i = tokens.index(token)
    net = amount * max(MILLION - fee, 0) // MILLION
    used = min(net, caps[i])
    hit[0] |= net > caps[i]
    depth = reserves[i] + used
    out = reserves[1 - i] * used // depth if depth else 0
    reserves[i] = min(reserves[i] + amount, LARGEST)
    reserves[1 - i] = max(reserves[1 - i] - out, 0)
    return out


REPLAYED = T.StructType([T.StructField("plan_id", T.LongType()), T.StructField("amount_out", T.StringType()), T.StructField("hit_limit", T.BooleanType()), T.StructField("failure", T.StringType())])


def replay(plans: DataFrame, steps: DataFrame, reserves: DataFrame, exact: bool) -> DataFrame:
    """plan_id, amount_out (text), hit_limit and failure (pool_missing, token_missing; else null) of every plan.

    ``plans``: plan_id, source, output, entry; ``reserves``: pool_id, token0, token1, r0, r1, cap0, cap1
    and fee_pips, one row a pool.  ``exact``: entry, reserves and caps are whole units as text, weights
    become billionths, and bridges move units as they are; otherwise all runs in single precision.
    A plan without steps keeps its entry where source and output are one token, else gives nothing.
    Within a stage, steps run by pool (as text), tokens and kind.  Exact replay looks all pools of a plan up first.
    """
    number = int if exact else np.float32

    def one(rows: list) -> tuple:
        head, hit, failure = rows[0], [False], None
        rows = [s for s in rows if s.kind is not None]
        pools = {}
        for s in rows:
            if s.token0 is not None and s.pool_id not in pools:
                fee = int(s.fee_pips) if exact else np.float32(1) - np.float32(s.fee_pips) / np.float32(MILLION)
                pools[s.pool_id] = ((int(s.token0), int(s.token1)), [number(s.r0), number(s.r1)], [number(s.cap0), number(s.cap1)], fee)
        try:
            if exact and any(s.kind == "swap" and s.pool_id not in pools for s in rows):
                raise PoolMissing
            if exact:
                got = _stages(rows, head.source, head.output, int(head.entry), 0, lambda balance, weight: balance * fixed_share(weight) // BILLION, lambda *hop: _exact(pools, hit, *hop))
            else:
                got = _stages(rows, head.source, head.output, np.float32(head.entry), np.float32(0), lambda balance, weight: balance * np.float32(weight), lambda *hop: _single(pools, *hop))
        except PoolMissing:
            got, failure = None, "pool_missing"
        except TokenMissing:
            got, failure = None, "token_missing"
        return head.plan_id, None if got is None else str(got), None if got is None else hit[0], failure

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = chain.from_iterable(batch.astype(object).where(batch.notna(), None).itertuples(index=False) for batch in batches)
        done = []
        for _, plan in groupby(rows, attrgetter("plan_id")):
            done.append(one(list(plan)))
            if len(done) == 10_000:
                yield pd.DataFrame(done, columns=REPLAYED.names)
                done = []
        yield pd.DataFrame(done, columns=REPLAYED.names)

    sizes = ("r0", "r1", "cap0", "cap1")
    pool = F.col("pool_id").cast("string").alias("pool_id")  # pandas would turn long ids beside nulls into doubles
    book = reserves.select(pool, "token0", "token1", "fee_pips", *(F.col(c).cast("string" if exact else "float").alias(c) for c in sizes))
    rows = steps.select("plan_id", "stage", "token_in", "token_out", "kind", pool, F.col("weight").cast("float").alias("weight")).join(book, "pool_id", "left")
    heads = plans.select("plan_id", "source", "output", F.col("entry").cast("string" if exact else "float").alias("entry"))
    joined = heads.join(rows, "plan_id", "left").repartition("plan_id").sortWithinPartitions("plan_id", "stage", "pool_id", "token_in", "token_out", "kind")
    return joined.mapInPandas(run, REPLAYED)


def raw_units(amount: float, decimals: int) -> int | None:
    """A single-precision amount in whole units, rounded down; null if it is negative, not finite, or of 128 bits and more."""
    scaled = float(np.float32(amount)) * float(10**decimals)
    return int(scaled) if 0 <= scaled < float(1 << 128) and np.isfinite(np.float32(amount)) else None


def from_units(raw: int, decimals: int) -> float | None:
    """Whole units as a single-precision amount: whole part and rest divided apart; null where that overflows."""
    whole, rest = divmod(raw, 10**decimals)
    value = float(whole) + float(rest) / float(10**decimals)
    return float(np.float32(value)) if value <= float(np.finfo(np.float32).max) else None


@F.pandas_udf(T.StringType())
def raw_units_text(amount: pd.Series, decimals: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(d) else None if (n := raw_units(a, int(d))) is None else str(n) for a, d in zip(amount, decimals, strict=True)], dtype=object)


@F.pandas_udf(T.FloatType())
def from_units_float(raw: pd.Series, decimals: pd.Series) -> pd.Series:
    return pd.Series([None if n is None or pd.isna(d) else from_units(int(n), int(d)) for n, d in zip(raw, decimals, strict=True)], dtype="float32")


def verify(plans: DataFrame, steps: DataFrame, reserves: DataFrame, decimals: DataFrame) -> DataFrame:
    """plan_id, profit (float), hit_limit and failure of every plan, its entry being a float of the source token.

    The first that holds is the failure: asset_unknown (source's or output's decimals), bridge_unknown or
    bridge_decimals (the first bad bridge by stage and tokens), amount (entry), pool_missing,
    token_missing, amount (output).
    """
    known = decimals.select("token", "decimals")
    of = lambda c, name: known.select(F.col("token").alias(c), F.col("decimals").alias(name))
    heads = plans.join(of("source", "d_source"), "source", "left").join(of("output", "d_output"), "output", "left")
    bad = F.when(F.col("d_in").isNull() | F.col("d_out").isNull(), "bridge_unknown").when(F.col("d_in") != F.col("d_out"), "bridge_decimals")
    crossed = steps.where("kind = 'bridge'").join(of("token_in", "d_in"), "token_in", "left").join(of("token_out", "d_out"), "token_out", "left").withColumn("bad", bad)
    first = crossed.where("bad is not null").groupBy("plan_id").agg(F.min(F.struct("stage", "token_in", "token_out", "bad"))["bad"].alias("bad"))
    heads = heads.withColumn("raw", raw_units_text("entry", "d_source")).join(first, "plan_id", "left")
    gate = F.when(F.col("d_source").isNull() | F.col("d_output").isNull(), "asset_unknown").when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("raw").isNull(), "amount")
    gated = heads.withColumn("gate", gate)
    open_ = gated.where("gate is null").select("plan_id", "source", "output", F.col("raw").alias("entry"))
    done = replay(open_, steps, reserves, exact=True).withColumnRenamed("failure", "replay_failure")
    rows = gated.join(done, "plan_id", "left").withColumn("back", from_units_float("amount_out", "d_output"))
    failure = F.coalesce("gate", "replay_failure", F.when(F.col("back").isNull(), "amount"))
    return rows.select("plan_id", F.when(failure.isNull(), (F.col("back") - F.col("entry").cast("float")).cast("float")).alias("profit"), F.when(failure.isNull(), F.col("hit_limit")).alias("hit_limit"), failure.alias("failure"))
