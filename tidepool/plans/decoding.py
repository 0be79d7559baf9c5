"""Registered queries of log decoding, pool identities and bloom tests over encoded logs of the derived market."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions.keccak import bloom_bits
from tidepool.operators import decode as D
from tidepool.plans import catalog as C
from tidepool.plans.catalog import query
from tidepool.plans.lineage import cut
from tidepool.sources import market as M

#: Emitter of the derived market's v4 logs on every chain.
MANAGER = "00" * 19 + "04"
_TOPIC = {(event[0], event[1]): t for t, event in D.TOPICS.items()}


def _word(number):
    """Two's complement of a long in 64 hex digits."""
    return F.lpad(F.lower(F.hex(number)), D.WORD, F.when(number < 0, "f").otherwise("0"))


def _raw_logs(spark, d):
    """The market's logs as a node would send them; odd pools are v4.

    Some come from a foreign emitter, without an index, removed, without a block, with data that ends
    early, or change liquidity by more than 128 bits.
    """
    n = lambda c: _word(F.col(c))
    zero = F.lit("0" * D.WORD)
    v4, kind = F.col("pool_id") % 2 == 1, F.col("kind")
    own = F.lpad(F.lower(F.hex("pool_id")), 40, "0")
    pool, signed = F.lpad(own, D.WORD, "0"), _word(F.when(kind == "burn", -F.col("amount")).otherwise(F.col("amount")))
    huge = F.when(F.col("l_partkey") % 19 == 0, F.concat(F.when(kind == "burn", "8").otherwise("7"), F.substring(signed, 2, 63))).otherwise(signed)
    t = lambda p, k: F.lit(_TOPIC[p, k])
    both = [
        (kind == "swap", F.array(t("v4", "swap"), pool, zero), F.concat(zero, zero, n("l_partkey"), n("liquidity"), n("tick"), zero), F.array(t("v3", "swap"), zero, zero), F.concat(zero, zero, n("l_partkey"), n("liquidity"), n("tick"))),
        (kind == "initialize", F.array(t("v4", "initialize"), pool, zero, zero), F.concat(zero, zero, zero, n("l_partkey"), n("tick")), F.array(t("v3", "initialize")), F.concat(n("l_partkey"), n("tick"))),
        (kind == "mint", F.array(t("v4", "modify"), pool, zero), F.concat(n("tick_lower"), n("tick_upper"), huge, zero), F.array(t("v3", "mint"), zero, n("tick_lower"), n("tick_upper")), F.concat(zero, n("amount"), zero, zero)),
        (kind == "burn", F.array(t("v4", "modify"), pool, zero), F.concat(n("tick_lower"), n("tick_upper"), huge, zero), F.array(t("v3", "burn"), zero, n("tick_lower"), n("tick_upper")), F.concat(n("amount"), zero, zero)),
    ]
    topics = F.coalesce(*(F.when(when, F.when(v4, a).otherwise(b)) for when, a, _, b, _ in both))
    data = F.coalesce(*(F.when(when, F.when(v4, a).otherwise(b)) for when, _, a, _, b in both))
    raw = C._placed(spark, d).select(
        "chain", F.when(v4 & (F.col("l_linenumber") != 5), F.lit(MANAGER)).otherwise(own).alias("address"), topics.alias("topics"),
        F.when(F.col("l_partkey") % 23 == 0, F.left(data, F.length(data) - 1)).otherwise(data).alias("data"),
        F.when(F.col("l_partkey") % 29 != 0, _word(F.col("number"))).alias("block_hash"), F.col("number").alias("block_number"),
        F.when(F.col("l_partkey") % 17 != 0, F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("log_index"), (F.col("l_linenumber") == 6).alias("removed"),
    )
    return cut(raw)


def _managers(spark):
    return spark.range(1).select(F.lit(MANAGER).alias("address"))


@query(f""", {C._PLACED}, ok AS (SELECT *, CASE WHEN pool_id % 2 = 1 THEN 'v4' ELSE 'v3' END AS protocol FROM placed WHERE l_linenumber <> 6 AND l_partkey % 29 <> 0 AND l_partkey % 17 <> 0 AND l_partkey % 23 <> 0
  AND NOT (pool_id % 2 = 1 AND (l_linenumber = 5 OR (kind IN ('mint', 'burn') AND l_partkey % 19 = 0))))
SELECT chain, number AS block_number, l_orderkey * 8 + l_linenumber AS log_index, protocol, lpad(lower(to_hex(pool_id)), CASE protocol WHEN 'v3' THEN 40 ELSE 64 END, '0') AS pool, kind,
  CASE WHEN kind IN ('swap', 'initialize') THEN lpad(lower(to_hex(l_partkey)), 40, '0') END AS sqrt_price, CASE WHEN kind IN ('swap', 'initialize') THEN tick END AS tick,
  CASE WHEN kind = 'swap' THEN lpad(lower(to_hex(liquidity)), 32, '0') END AS liquidity, CASE WHEN kind IN ('mint', 'burn') THEN tick_lower END AS tick_lower,
  CASE WHEN kind IN ('mint', 'burn') THEN tick_upper END AS tick_upper, CASE WHEN kind IN ('mint', 'burn') THEN lpad(lower(to_hex(amount)), 32, '0') END AS amount FROM ok""")
def decoded_logs(spark, d):
    """Encoded logs through admission and decoding; the SQL reads the fields before they were encoded."""
    return D.decode(D.admitted(_raw_logs(spark, d)), _managers(spark))


def _claimed(spark, d):
    """Keys of all pools with claimed ids; some are dynamic, hooked, claimed wrongly or spaced badly."""
    pools = M.pools(spark, d)
    address = lambda c: F.lpad(F.lower(F.hex(c)), 40, "0")
    spacing = F.when(F.col("pool_id") % 11 == 0, -F.col("tick_spacing")).when(F.col("pool_id") % 13 == 0, 0).otherwise(F.col("tick_spacing"))
    keys = pools.select(
        "pool_id", address("token0").alias("currency0"), address("token1").alias("currency1"), (F.col("fee_pips") + F.when(F.col("pool_id") % 5 == 0, D.DYNAMIC_FEE).otherwise(0)).alias("fee"),
        spacing.cast("long").alias("tick_spacing"), F.when(F.col("pool_id") % 7 == 0, address("pool_id")).otherwise("0" * 40).alias("hooks"),
    )
    return keys.withColumn("id", F.when(F.col("pool_id") % 9 == 0, F.lpad(F.lower(F.hex("pool_id")), D.WORD, "0")).otherwise(D.pool_key(keys)))


@query("SELECT pool_id, CASE WHEN pool_id % 5 = 0 THEN 'dynamic_fee' WHEN pool_id % 7 = 0 THEN 'hooked_pool' WHEN pool_id % 9 = 0 THEN 'id_mismatch' WHEN pool_id % 11 = 0 OR pool_id % 13 = 0 THEN 'bad_spacing' ELSE 'ok' END AS outcome FROM pools")
def pool_key_outcomes(spark, d):
    return D.key_outcomes(_claimed(spark, d)).select("pool_id", "outcome")


@query("SELECT p_partkey, CASE WHEN 100 * p_size IN (100, 500, 3000, 10000) THEN 'supported' ELSE 'unsupported_tier' END AS outcome FROM part")
def fee_tiers(spark, d):
    return M.table(spark, d, "part").select("p_partkey", D.tier_check((100 * F.col("p_size")).cast("long")).alias("outcome"))


def _emitters(spark, d):
    """chain, protocol and pool (its emitter's address) of all pools; chain 4 has no manager."""
    return M.pools(spark, d).select("chain", "pool_id", F.when(F.col("pool_id") % 2 == 1, "v4").otherwise("v3").alias("protocol"), F.lpad(F.lower(F.hex("pool_id")), 40, "0").alias("pool"))


def _chain_managers(spark, d):
    return M.table(spark, d, "region").where("r_regionkey <> 4").select(F.col("r_regionkey").cast("long").alias("chain"), F.lit(MANAGER).alias("address"))


@query(f"SELECT DISTINCT chain, CASE pool_id % 2 WHEN 1 THEN '{MANAGER}' ELSE lpad(lower(to_hex(pool_id)), 40, '0') END AS address FROM pools WHERE pool_id % 2 = 0 OR chain <> 4")
def watched_addresses(spark, d):
    return D.watched_addresses(_emitters(spark, d), _chain_managers(spark, d))


def _bloomed(spark, d):
    """Blocks with the bits of their emitters; every seventh block number came without a header."""
    emitters = M.pools(spark, d).select("pool_id", bloom_bits(F.lpad(F.lower(F.hex("pool_id")), 40, "0")).alias("bits"))
    bits = C._placed(spark, d).select("chain", "number", "pool_id").distinct().join(emitters, "pool_id").select("chain", "number", F.explode("bits").alias("bit"))
    return bits.groupBy("chain", "number").agg(F.collect_set("bit").alias("bloom")).withColumn("bloom", F.when(F.col("number") % 7 != 0, F.col("bloom")))


@query()
def bloom_touches(spark, d):
    """Blocks that may hold a log of a watched pool (every fourth one is, on all chains but 4)."""
    watched = _emitters(spark, d).where("pool_id % 4 = 0 and chain <> 4").select("chain", F.col("pool").alias("address"))
    return D.may_touch(_bloomed(spark, d), watched)
