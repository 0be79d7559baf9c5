"""Registered queries of frames, block logs, slices and chain limits over the derived market."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import ticks
from tidepool.operators import dims, frames, slices
from tidepool.plans import catalog as C
from tidepool.plans.catalog import query
from tidepool.sources import market as M
from tidepool.streaming import logs as S

SLUGS = [c[0] for c in dims.CHAINS]


def _hex(c, digits=40):
    return F.lpad(F.lower(F.hex(c)), digits, "0")


@query("""SELECT event_id, CASE WHEN event_id % 17 = 5 THEN 'fault' WHEN event_id % 19 = 6 OR event_id % 5 = 0 THEN 'foreign' WHEN event_id % 23 = 7 OR event_id % 11 = 3 OR event_id % 13 = 4 THEN 'fault' ELSE 'sound' END AS kind,
  CASE WHEN event_id % 17 = 5 THEN 'not_json' WHEN event_id % 19 = 6 OR event_id % 5 = 0 THEN NULL WHEN event_id % 23 = 7 THEN 'missing_result' WHEN event_id % 11 = 3 THEN 'bad_data' WHEN event_id % 13 = 4 THEN 'bad_quantity' END AS reason,
  CASE WHEN NOT (event_id % 17 = 5 OR event_id % 19 = 6 OR event_id % 5 = 0 OR event_id % 23 = 7 OR event_id % 11 = 3 OR event_id % 13 = 4) THEN user_id END AS number FROM events""")
def frame_kinds(spark, d):
    """A stream of frames split in three tables: cut ones, other subscriptions, frames without a result, odd data and quantities."""
    e, user = F.col("event_id"), F.col("user_id")
    log = F.struct(
        F.concat(F.lit("0x"), _hex(user)).alias("address"), F.array(F.concat(F.lit("0x"), _hex(e, 64))).alias("topics"), F.when(e % 11 == 3, "0xabc").otherwise(F.concat(F.lit("0x"), _hex(e, 64))).alias("data"),
        F.concat(F.lit("0x"), _hex(user, 64)).alias("blockHash"), F.when(e % 13 == 4, "12").otherwise(F.concat(F.lit("0x"), F.hex(user))).alias("blockNumber"), F.lit("0x0").alias("logIndex"),
    )
    params = F.struct(F.when(e % 5 == 0, "0xother").otherwise("0xown").alias("subscription"), F.when(e % 23 != 7, log).alias("result"))
    frame = F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.when(e % 19 != 6, params).alias("params")))
    frame = F.when(e % 17 == 5, F.substring(frame, F.lit(1), F.length(frame) - 3)).otherwise(frame)
    parts = frames.split(S.event_stream(spark, d).select("event_id", frame.alias("frame")), "0xown")
    none = F.lit(None).cast("string")
    sound = parts["sound"].select("event_id", F.lit("sound").alias("kind"), none.alias("reason"), F.col("number").cast("long").alias("number"))
    foreign = parts["foreign"].select("event_id", F.lit("foreign"), none, F.lit(None).cast("long"))
    return sound.union(foreign).union(parts["fault"].select("event_id", F.lit("fault"), "reason", F.lit(None).cast("long")))


@query("""SELECT l_orderkey AS request, CASE WHEN l_orderkey % 17 = 6 THEN 'not_json' WHEN l_orderkey % 7 = 2 THEN 'error' WHEN l_orderkey % 11 = 3 THEN 'other_id' WHEN l_orderkey % 19 = 7 THEN 'not_a_list'
  WHEN l_orderkey % 23 = 8 AND bool_or(l_linenumber = 2) THEN 'bad_data' WHEN l_orderkey % 13 = 5 AND bool_or(l_linenumber = 1) THEN 'other_block' END AS fault,
  CASE WHEN fault IS NULL THEN count(*) END AS n_logs FROM lineitem GROUP BY l_orderkey""")
def block_log_faults(spark, d):
    """Every order's lines as the logs of a block: one bad log fails its response."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    block = lambda c: F.concat(F.lit("0x"), _hex(c, 64))
    log = F.struct(
        F.concat(F.lit("0x"), _hex("l_suppkey")).alias("address"), F.array(block(F.col("l_partkey"))).alias("topics"), F.when((key % 23 == 8) & (line == 2), "0x0").otherwise("0x").alias("data"),
        block(F.when((key % 13 == 5) & (line == 1), key + 1).otherwise(key)).alias("blockHash"), F.concat(F.lit("0x"), F.hex(line)).alias("logIndex"),
    )
    rows = M.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(log).alias("result"))
    number = F.when(key % 11 == 3, key + 1).otherwise(key).alias("id")
    whole = F.to_json(F.struct(number, F.when(key % 7 != 2, F.col("result")).alias("result"), F.when(key % 7 == 2, F.struct(F.lit("busy").alias("message"))).alias("error")))
    body = F.when(key % 17 == 6, F.substring(whole, F.lit(1), F.length(whole) - 2)).when((key % 19 == 7) & (key % 7 != 2), F.to_json(F.struct(number, F.lit("none").alias("result")))).otherwise(whole)
    responses = rows.select(key.alias("request"), _hex(key, 64).alias("block_hash"), body.alias("body"))
    return frames.block_logs(responses).select("request", "fault", F.when(F.col("fault").isNull(), F.size("logs").cast("long")).alias("n_logs"))


def _slices(spark, d):
    """Eight parts ask a request for pools, some by malformed ids; chain 3 has no anchor yet, the lag of chain 2 is unknown."""
    part = F.col("p_partkey")
    pool = part * 7 % 121
    rows = M.table(spark, d, "part").select(F.expr("p_partkey div 8").alias("request"), part.alias("ordinal"), pool.alias("pool"))
    v4 = F.col("pool") % 2 == 1
    name = F.when(v4, _hex("pool", 64)).otherwise(F.upper(_hex("pool")))
    rows = rows.select("request", (F.col("request") % 5).alias("chain"), "ordinal", F.when(v4, "v4").otherwise("v3").alias("protocol"), F.concat(F.lit("0x"), F.when(F.col("ordinal") % 97 == 5, "zz").otherwise(name)).alias("id"))
    state = C.pool_state_fold(spark, d)
    odd = F.col("pool_id") % 2 == 1
    states = state.select("chain", F.when(odd, "v4").otherwise("v3").alias("protocol"), F.when(odd, _hex("pool_id", 64)).otherwise(_hex("pool_id")).alias("id"), ticks.sqrt_price_text("tick").alias("sqrt_price"), "tick", "liquidity")
    region = F.col("r_regionkey").cast("long")
    chains = M.table(spark, d, "region").select(region.alias("chain"), (region != 3).alias("anchored"), _hex(region, 64).alias("frontier"), F.when(region != 2, region * 2).alias("behind"))
    return slices.answers(rows, states, chains)


_ASKED = """asked AS (SELECT p_partkey // 8 AS request, p_partkey // 8 % 5 AS chain, p_partkey AS ordinal, p_partkey * 7 % 121 AS pool FROM part),
req AS (SELECT request, chain, CASE WHEN chain = 3 THEN 503 WHEN bool_or(ordinal % 97 = 5) THEN 400 ELSE 200 END AS status FROM asked GROUP BY request, chain)"""


@query(f", {_ASKED} SELECT request, status, CASE WHEN status = 200 THEN lpad(lower(to_hex(chain)), 64, '0') END AS block_hash, CASE WHEN status = 200 THEN CASE WHEN chain = 2 THEN 0 ELSE chain * 2 END END AS confirmations FROM req")
def slice_heads(spark, d):
    return _slices(spark, d)[0]


@query(f""", {C._PROJ}, {_ASKED} SELECT asked.request, ordinal, CASE pool % 2 WHEN 1 THEN 'v4' ELSE 'v3' END AS protocol, '0x' || CASE pool % 2 WHEN 1 THEN lpad(lower(to_hex(pool)), 64, '0') ELSE lpad(upper(to_hex(pool)), 40, '0') END AS id,
  CASE WHEN f.tick IS NULL THEN 'incomplete' ELSE 'complete' END AS completeness, prices.p::VARCHAR AS sqrt_price, f.tick, f.liquidity
FROM asked JOIN req USING (request) LEFT JOIN f ON f.chain = asked.chain AND f.pool_id = pool LEFT JOIN prices ON prices.t = f.tick WHERE status = 200""")
def slice_entries(spark, d):
    return _slices(spark, d)[1]


@query(f""", dim AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{c[0]}', {c[3]}, {c[4]}, {c[5]}, {c[7]})" for k, c in enumerate(dims.CHAINS) if c[2])}) v(number, slug, page, depth, margin, trim))
SELECT slug, min(b.number) AS lowest, max(b.number) AS tip, greatest(max(b.number) - any_value(depth), 0) AS final_at, greatest(max(b.number) - any_value(trim), 0) AS seed_top,
  (max(b.number) - min(b.number)) // any_value(page) + 1 AS n_pages, any_value(depth)::BIGINT * {dims.PENDING_MARGIN} AS most_pending, any_value(depth + margin)::BIGINT AS refresh_at FROM blocks b JOIN dim ON dim.number = chain GROUP BY slug""")
def chain_limits(spark, d):
    """What the policies of active chains make of their blocks; regions stand for chains in the table's order."""
    return dims.limits(C._blocks(spark, d).select(F.get(F.array(*map(F.lit, SLUGS)), F.col("chain").cast("int")).alias("slug"), "number"))
