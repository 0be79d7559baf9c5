"""Chains and their policies, contracts and ids: one table that everything by chain reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pending blocks a chain may hold, as a multiple of its finality depth (fixed value).
PENDING_MARGIN = 8
#: Chains (fixed values): name, id, whether active, blocks in a page of logs, finality depth, margin that is retained above it,
#: stride of retries, tip blocks left out of seeds, ticks until a start gives up, v3 factory, v4 manager, v4 state view.
_CANONICAL = "1f98431c8ad98523631ae4a59f267346ea31f984"
CHAINS = [
    ("ethereum", 1, True, 5000, 64, 8, 8, 4, 180, _CANONICAL, "000000000004444c5dc75cb358380d2e3de08a90", "7ffe42c4a5deea5b0fec41c94c136cf115597227"),
    ("arbitrum", 42161, False, 5000, 1000, 64, 32, 8, 180, _CANONICAL, "360e68faccca8ca495c1b759fd9eee466db9fb32", "76fd297e2d437cd7f76d50f01afe6160f86e9990"),
    ("base", 8453, True, 100, 200, 32, 16, 8, 180, "33128a8fc17869897dce68ed026d694621f6fdfd", "498581ff718922c3f8e6a244956af099b2652b2b", "a3c0c9b65bad0b08107aa264b0f3db444b867a71"),
    ("optimism", 10, True, 250, 200, 32, 16, 8, 180, _CANONICAL, "9a13f98cb987694c9f086b1f5eb990eea8264ec3", "c18a3169788f4f75a170290584eca6395c75ecdb"),
    ("polygon", 137, False, 5000, 400, 64, 32, 16, 180, _CANONICAL, "67366782805870060151383f4bbff9dab53e5cd6", "5ea1bd7974c8a611cbab0bdcafcb1d9cc9b3ba5a"),
    ("bnb", 56, False, 5000, 150, 32, 16, 12, 180, "db1d10011ad0ff90774d0c6bb92e5c5c8b4461f7", "28e2ea090877bf75740558f6bfb36a5ffee9e9df", "d13dd3d6e93f276fafc9db9e6bb47c1180aee0c4"),
    ("avalanche", 43114, True, 5000, 80, 16, 8, 6, 180, "740b1c1de25031c31ff4fc9a62f554a55cdc1bad", "06380c0e0912312b5150364b9dc4542ba0dbbc85", "c3c9e198c735a4b97e3e683f391ccbdd60b69286"),
]
COLUMNS = "slug string, chain_id long, active boolean, page long, depth long, margin long, stride long, tip_trim long, deadline long, v3_factory string, v4_manager string, v4_view string"


def chains(spark: SparkSession) -> DataFrame:
    """``COLUMNS``, with most_pending and refresh_at (the length of a path at which the finalised header is asked for)."""
    rows = spark.createDataFrame(CHAINS, COLUMNS)
    return rows.withColumns({"most_pending": F.col("depth") * PENDING_MARGIN, "refresh_at": F.col("depth") + F.col("margin")})


def by_id(rows: DataFrame, chain_id: str) -> DataFrame:
    """``rows`` with the slug of the chain whose id is in the column ``chain_id``; null for ids of no chain."""
    names = F.broadcast(chains(rows.sparkSession).select(F.col("chain_id").alias("_id"), "slug"))  # seven rows
    return rows.join(names, rows[chain_id] == F.col("_id"), "left").drop("_id")


def is_manager(rows: DataFrame, address: str) -> DataFrame:
    """``rows`` with ``manager_of``: the active chain whose v4 manager emitted, null for other addresses and inactive chains."""
    own = F.broadcast(chains(rows.sparkSession).where("active").select(F.col("v4_manager").alias("_address"), F.col("slug").alias("manager_of")))
    return rows.join(own, F.lower(address) == F.col("_address"), "left").drop("_address")


def limits(blocks: DataFrame) -> DataFrame:
    """slug, lowest, tip, final_at, seed_top, n_pages, most_pending and refresh_at of the chains in ``blocks`` (slug, number).

    final_at: the height that the depth makes final; seed_top: the highest number that a seed takes in; n_pages: windows of logs
    from the lowest block to the tip.  Inactive chains aren't there.
    """
    ends = blocks.groupBy("slug").agg(F.min("number").alias("lowest"), F.max("number").alias("tip"))
    rows = ends.join(F.broadcast(chains(blocks.sparkSession).where("active")), "slug")
    return rows.select(
        "slug", "lowest", "tip", F.greatest(F.col("tip") - F.col("depth"), F.lit(0)).alias("final_at"), F.greatest(F.col("tip") - F.col("tip_trim"), F.lit(0)).alias("seed_top"),
        F.expr("(tip - lowest) div page + 1").alias("n_pages"), "most_pending", "refresh_at",
    )
