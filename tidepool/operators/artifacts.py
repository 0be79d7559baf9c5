"""The whitelist as an artifact by chain, the report of decisions, and counts for active chains."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_artifact(tokens: DataFrame, path: str) -> None:
    """Tokens (chain, token, symbol) as JSON lines in a folder for each chain."""
    tokens.write.mode("overwrite").partitionBy("chain").json(path)


def read_artifact(spark: SparkSession, path: str, chains: Iterable[str]) -> DataFrame:
    """chain, token, symbol of an artifact; a chain that isn't one of ``chains`` is an error."""
    tokens = spark.read.schema("token long, symbol string, chain string").json(path)
    unknown = tokens.where(~F.col("chain").isin(*chains)).select("chain").first()
    if unknown is not None:
        raise ValueError(f"unknown chain {unknown['chain']}")
    return tokens.select("chain", "token", "symbol")


def write_report(decisions: DataFrame, path: str) -> None:
    """Every decision as a line of JSON, absent fields written as null."""
    decisions.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def chain_counts(active: DataFrame, tokens: DataFrame) -> DataFrame:
    """chain, n_tokens, warn for each active chain; one without a token is warned of."""
    counts = active.join(tokens.groupBy("chain").agg(F.count_distinct("token").alias("n")), "chain", "left")
    return counts.select("chain", F.coalesce("n", F.lit(0)).alias("n_tokens"), F.col("n").isNull().alias("warn"))
