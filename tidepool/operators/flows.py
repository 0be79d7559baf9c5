"""From optimizer flows to executable steps: weights, pruning, merging, replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def softmax(cells: DataFrame, column: str, logit: str = "logit") -> DataFrame:
    """``weight`` of each cell: softmax over the cells of a layout column, shifted by its largest logit."""
    w = Window.partitionBy(column)
    e = F.exp(F.col(logit) - F.max(logit).over(w))
    return cells.withColumn("e", e).withColumn("weight", F.col("e") / F.sum("e").over(w)).drop("e")


def plan_steps(flows: DataFrame, keys: Sequence[str], least_weight: float) -> DataFrame:
    """Flows of at least the weight, merged: small flows go before duplicates are added up."""
    kept = flows.where(~(F.col("weight") < least_weight))
    return kept.groupBy(*keys).agg(F.sum("amount_in").alias("amount_in"), F.sum("amount_out").alias("amount_out"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_merged"))


def normalized(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``share``: each step's part of the weight at its keys; 0 where the weights there add up to nothing."""
    total = F.sum("weight").over(Window.partitionBy(*keys))
    return steps.withColumn("total", total).withColumn("share", F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(0.0)).drop("total")


def quote(amount, r_in, r_out, fee):
    """Output of a constant-product swap, in double precision; ``fee`` is what is left of an amount."""
    net = amount * fee
    return r_out * net / (r_in + net)


def entropy(flows: DataFrame, keys: Sequence[str], over: str) -> DataFrame:
    """Shannon entropy (nats) and perplexity of how the entering amounts are spread ``over`` a column, to six digits."""
    sums = flows.groupBy(*keys, over).agg(F.sum("amount_in").cast("double").alias("s")).where("s > 0")
    e = F.ln(F.sum("s")) - F.sum(F.col("s") * F.ln("s")) / F.sum("s")
    rows = sums.groupBy(*keys).agg(e.alias("e"), F.count(F.lit(1)).alias("n_pools"))
    return rows.select(*keys, F.round("e", 6).alias("entropy"), F.round(F.exp("e"), 6).alias("perplexity"), "n_pools")
