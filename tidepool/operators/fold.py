"""Pool state from ordered logs, folded in block buckets whose summaries combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Block numbers in a bucket: a pool's logs of so many blocks are one window, and a pool with most logs is many tasks.
WIDTH = 4096
#: Halves of a long are summed apart, so that no sum of them overflows.
HALF, LOWER = 31, (1 << 31) - 1
WHOLE = T.DecimalType(38, 0)


def _halves(x: Column) -> tuple[Column, Column]:
    return F.shiftright(x, HALF), x.bitwiseAND(F.lit(LOWER).cast("long"))


def _whole(s: Column) -> Column:
    return s["h"].cast(WHOLE) * (1 << HALF) + s["l"].cast(WHOLE)


def _carried(high: Column, low: Column) -> Column:
    """(h, l) with l below 2 ** 31: negative where h is, ordered as numbers are."""
    return F.struct((high + F.shiftright(low, HALF)).alias("h"), low.bitwiseAND(F.lit(LOWER).cast("long")).alias("l"))


def fold_logs(logs: DataFrame, keys: Sequence[str], order: Sequence[str], base: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """keys, tick, liquidity (38 digits) and n_logs of every pool that has a derivable state.

    Swap and initialize set the state (initialize with liquidity 0); mint and burn add and
    subtract where lower <= tick < upper; those before any state change nothing.  A liquidity
    below 0 or over 38 digits at any prefix makes the whole pool underivable.  With ``base`` (keys, tick,
    liquidity) the logs go on from there, and pools without logs keep their base with n_logs 0.

    The first of ``order`` is a block number.  A bucket's last state tells the next ones at which tick they
    begin; with that each is folded by itself, and its summary (what it adds before it sets the
    state, how low that gets, where it ends) is combined with the others' by running sums of
    summaries.  Logs are sorted once; only summaries are looked at across buckets.
    """
    keys, bucket = list(keys), [*keys, "_bucket"]
    narrow = all(isinstance(logs.schema[c].dataType, T.LongType | T.IntegerType) for c in ("liquidity", "amount"))
    absolute = F.col("kind").isin("swap", "initialize")
    rows = logs.select(*keys, *order, "kind", "tick", "liquidity", "amount", "tick_lower", "tick_upper", F.floor(F.col(order[0]) / width).alias("_bucket"))
    seeds = logs.select(*keys).limit(0).withColumns({"b_tick": F.lit(None).cast(logs.schema["tick"].dataType), "b_liquidity": F.lit(None).cast(WHOLE)})
    if base is not None:
        seeds = base.select(*keys, F.col("tick").cast(logs.schema["tick"].dataType).alias("b_tick"), F.col("liquidity").cast(WHOLE).alias("b_liquidity"))

    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*bucket).agg(F.max(F.when(absolute, F.struct(*order, "tick"))).alias("last"))
    if base is not None:
        last = last.join(seeds, keys, "left")
    carried = F.last("last.tick", True).over(before)
    starts = last.select(*bucket, (F.coalesce(carried, "b_tick") if base is not None else carried).alias("_in"))

    run = Window.partitionBy(*bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(starts, bucket).withColumn("_own", F.last(F.when(absolute, F.col("tick")), True).over(run))
    rows = rows.withColumn("_at", F.coalesce("_own", "_in"))
    inside = (F.col("tick_lower") <= F.col("_at")) & (F.col("_at") < F.col("tick_upper"))
    step = F.when(inside & (F.col("kind") == "mint"), F.col("amount")).when(inside & (F.col("kind") == "burn"), -F.col("amount")).otherwise(0)
    level = F.when(F.col("kind") == "swap", F.col("liquidity")).otherwise(0)
    if narrow:
        high, low = _halves(step.cast("long"))
        rows = rows.withColumns({"_h": F.sum(high).over(run), "_l": F.sum(low).over(run)})
        a, b = _halves(level.cast("long"))
        # The sums run on; what they were at the last level is taken off again.
        rows = rows.withColumn("_set", F.last(F.when(absolute, F.struct((a - F.col("_h")).alias("h"), (b - F.col("_l")).alias("l"))), True).over(run))
        rows = rows.withColumn("_sum", _carried(F.col("_h") + F.coalesce("_set.h", F.lit(0)), F.col("_l") + F.coalesce("_set.l", F.lit(0))))
    else:
        part = Window.partitionBy(*bucket, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("_part", F.count_if(absolute).over(run))
        rows = rows.withColumn("_sum", F.try_sum(F.when(absolute, level).otherwise(step).cast(WHOLE)).over(part))
    own = F.col("_own").isNotNull()
    at_end = lambda cond: F.max(F.when(cond, F.struct(*order, "_sum")))["_sum"]
    parts = rows.where("_at is not null").groupBy(*bucket).agg(
        at_end(~own).alias("pre"), F.min(F.when(~own, F.col("_sum"))).alias("pre_low"), at_end(own).alias("end"), F.min(F.when(own, F.col("_sum"))).alias("low"),
        F.count_if(F.col("_sum").isNull()).alias("over"), F.max(F.when(own, F.struct(*order, "_at")))["_at"].alias("tick"), F.count(F.lit(1)).alias("n"),
    )
    if narrow:
        parts = parts.withColumns({c: F.when(F.col(c).isNotNull(), _whole(F.col(c))) for c in ("pre", "pre_low", "end", "low")})

    zero = F.lit(0).cast(WHOLE)
    if base is not None:
        # The base is a bucket before all others, which sets the state.
        first = seeds.select(*keys, F.lit(None).cast("long").alias("_bucket"), F.col("b_liquidity").alias("end"), F.col("b_liquidity").alias("low"), F.lit(0).cast("long").alias("over"), F.col("b_tick").alias("tick"), F.lit(0).cast("long").alias("n"))
        parts = first.unionByName(parts, allowMissingColumns=True)
    chain = Window.partitionBy(*keys).orderBy(F.col("_bucket").asc_nulls_first())
    so_far = chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sets = F.col("end").isNotNull()
    parts = parts.withColumn("_block", F.count_if(sets).over(so_far))
    since = Window.partitionBy(*keys, "_block").orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("_out", F.try_sum(F.when(sets, F.col("end")).otherwise(F.coalesce("pre", zero))).over(since))
    parts = parts.withColumn("_came", F.coalesce(F.lag("_out").over(chain), zero))
    lowest = F.least("low", F.try_add(F.col("_came"), F.col("pre_low")))
    broken = F.col("_out").isNull() | (F.col("over") > 0) | F.coalesce(lowest < 0, F.lit(False)) | (F.col("pre_low").isNotNull() & F.try_add(F.col("_came"), F.col("pre")).isNull())
    end = F.max(F.struct(F.coalesce("_bucket", F.lit(-(1 << 62))).alias("k"), F.col("_out")))["_out"]
    tick = F.max(F.when(F.col("tick").isNotNull(), F.struct(F.coalesce("_bucket", F.lit(-(1 << 62))).alias("k"), "tick")))["tick"]
    out = parts.groupBy(*keys).agg(tick.alias("tick"), end.alias("liquidity"), F.max(broken).alias("broken"), F.sum("n").alias("n_logs"))
    return out.where(~F.col("broken")).select(*keys, "tick", "liquidity", "n_logs")


def overlay(base: DataFrame, over: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of ``over`` where there are any, else those of ``base``."""
    values = [c for c in base.columns if c not in keys]
    joined = base.alias("b").join(over.alias("o"), list(keys), "full")
    present = F.col(f"o.{values[0]}").isNotNull()
    return joined.select(*keys, *(F.when(present, F.col(f"o.{v}")).otherwise(F.col(f"b.{v}")).alias(v) for v in values), F.when(present, "overlay").otherwise("base").alias("origin"))
