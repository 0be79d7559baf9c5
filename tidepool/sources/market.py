"""A deterministic market over the star-schema tables: pools, ordered logs, blocks, candidates.

The tables hold no chain data, so chains are regions, tokens nations, pools suppliers and logs
line items.  Every relation is made of expressions that any SQL engine can repeat; ``CTES`` has
the same relations as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.operators.ordered import WIDTH

#: Fee in pips -> tick spacing (fixed values).
TIERS = {100: 1, 500: 10, 3000: 60, 10000: 200}
FIRST_DAY = "1995-01-01"
#: Order of logs within a pool.
LOG_ORDER = ("number", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain, pool_id, token0, token1, fee_pips, tick_spacing."""
    fees, spacings = F.array(*map(F.lit, TIERS)), F.array(*map(F.lit, TIERS.values()))
    tier = (F.col("s_suppkey") % 4).cast("int")
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").cast("long").alias("chain"), F.col("s_suppkey").alias("pool_id"), F.col("s_nationkey").cast("long").alias("token0"),
        ((F.col("s_nationkey") + 1 + F.col("s_suppkey") % 24) % 25).cast("long").alias("token1"), F.get(fees, tier).cast("long").alias("fee_pips"), F.get(spacings, tier).cast("long").alias("tick_spacing"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log for each line item, with the order columns of ``LOG_ORDER``."""
    percent = lambda c: F.round(F.col(c) * 100).cast("long")
    flag = F.col("l_returnflag")
    opened = (flag == "A") & (F.col("l_quantity") == 1) & (F.col("l_linestatus") == "O")
    kind = F.when(opened, "initialize").when(flag == "A", "swap").when(flag == "N", "mint").otherwise("burn")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pool_id"), F.datediff(F.col("l_shipdate"), F.lit(FIRST_DAY)).cast("long").alias("number"), *LOG_ORDER[1:], kind.alias("kind"),
        (F.col("l_quantity") - 25).cast("long").alias("tick"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("liquidity"),
        (-5 * (percent("l_discount") + 1)).alias("tick_lower"), (5 * (percent("l_tax") + 1)).alias("tick_upper"), (F.col("l_quantity") * 1000).cast("long").alias("amount"),
    )


def blocks(pool_rows: DataFrame, log_rows: DataFrame, watched: int = 4) -> DataFrame:
    """chain, number, authority (0 unknown, 1 streamed, 2 complete) and whether a watched pool is touched."""
    rows = log_rows.join(pool_rows.select("pool_id", "chain"), "pool_id").groupBy("chain", "number").agg(F.max((F.col("pool_id") % watched == 0).cast("int")).alias("touched"))
    return rows.select("chain", "number", F.pmod(F.col("number") * 7 + F.col("chain"), F.lit(3)).alias("authority"), (F.col("touched") == 1).alias("touched"))


def numbered_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain, block, parent, number: a header stream with forks, from events, numbered by chain; every fifth header skips its predecessor.

    Windows span buckets of blocks; only the last two rows and the count of each bucket are looked at across buckets.
    """
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("chain"), F.col("event_id").alias("block"))
    none = F.lit(-(2**62))
    rows = rows.select("*", F.coalesce("chain", none).alias("_chain"), F.coalesce(F.floor(F.col("block") / WIDTH), none).alias("_bucket"))
    own = Window.partitionBy("_chain", "_bucket").orderBy("block")
    near = rows.select("*", F.lag("block", 1).over(own).alias("_near1"), F.lag("block", 2).over(own).alias("_near2"), F.row_number().over(own).alias("_own"))
    last = near.groupBy("_chain", "_bucket").agg(F.max(F.struct("_own", "block", "_near1")).alias("l"))
    over = Window.partitionBy("_chain").orderBy("_bucket")
    before = F.lag("l").over(over)
    far2 = F.when(before["_own"] > 1, before["_near1"]).otherwise(F.lag("l", 2).over(over)["block"])
    count = F.coalesce(F.sum("l._own").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = last.select("_chain", "_bucket", before["block"].alias("_far1"), far2.alias("_far2"), count.alias("_count"))
    one = F.when(F.col("_own") > 1, F.col("_near1")).otherwise(F.col("_far1"))
    two = F.when(F.col("_own") > 2, F.col("_near2")).when(F.col("_own") > 1, F.col("_far1")).otherwise(F.col("_far2"))
    parent = F.when(F.col("block") % 5 == 0, F.coalesce(two, one)).otherwise(one)
    return near.join(last, ["_chain", "_bucket"]).select("chain", "block", parent.alias("parent"), (F.col("_count") + F.col("_own")).cast("long").alias("number"))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain, block, parent of ``numbered_heads``."""
    return numbered_heads(spark, sf_dir).drop("number")


CTES = f"""
pools AS (SELECT n_regionkey::BIGINT AS chain, s_suppkey AS pool_id, s_nationkey::BIGINT AS token0, ((s_nationkey + 1 + s_suppkey % 24) % 25)::BIGINT AS token1,
  ([{', '.join(map(str, TIERS))}])[(s_suppkey % 4 + 1)::INT]::BIGINT AS fee_pips, ([{', '.join(map(str, TIERS.values()))}])[(s_suppkey % 4 + 1)::INT]::BIGINT AS tick_spacing
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
logs AS (SELECT l_suppkey AS pool_id, date_diff('day', DATE '{FIRST_DAY}', l_shipdate::DATE)::BIGINT AS number, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  CASE WHEN l_returnflag = 'A' AND l_quantity = 1 AND l_linestatus = 'O' THEN 'initialize' WHEN l_returnflag = 'A' THEN 'swap' WHEN l_returnflag = 'N' THEN 'mint' ELSE 'burn' END AS kind,
  (l_quantity - 25)::BIGINT AS tick, round(l_extendedprice * 100)::BIGINT AS liquidity,
  -5 * (round(l_discount * 100)::BIGINT + 1) AS tick_lower, 5 * (round(l_tax * 100)::BIGINT + 1) AS tick_upper, (l_quantity * 1000)::BIGINT AS amount FROM lineitem),
blocks AS (SELECT chain, number, (((number * 7 + chain) % 3) + 3) % 3 AS authority, max((pool_id % 4 = 0)::INT) = 1 AS touched FROM logs JOIN pools USING (pool_id) GROUP BY chain, number),
heads AS (SELECT chain, block, CASE WHEN block % 5 = 0 THEN coalesce(p2, p1) ELSE p1 END AS parent FROM (SELECT chain, block,
  lag(block, 1) OVER (PARTITION BY chain ORDER BY block) AS p1, lag(block, 2) OVER (PARTITION BY chain ORDER BY block) AS p2 FROM (SELECT user_id % 20 AS chain, event_id AS block FROM events)))
"""
