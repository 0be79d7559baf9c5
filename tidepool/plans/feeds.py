"""Registered queries of caches, indexer responses, lists, factories and bridges over the derived market."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import artifacts as A
from tidepool.operators import cache as K
from tidepool.operators import decode as D
from tidepool.operators import indexer as I
from tidepool.plans import catalog as C
from tidepool.plans.catalog import query
from tidepool.plans.lineage import cut, folder
from tidepool.sources import market as M
from tidepool.streaming import chains
from tidepool.streaming import logs as S


def _hex(c, digits=40):
    return F.lpad(F.lower(F.hex(c)), digits, "0")


def _keyed(spark, d):
    """Pools with their cache keys; odd pools are v4."""
    v4 = F.col("pool_id") % 2 == 1
    identity = F.when(v4, _hex("pool_id", D.WORD)).otherwise(_hex("pool_id"))
    return M.pools(spark, d).withColumn("key", K.cache_key(F.col("chain"), F.when(v4, "v4").otherwise("v3"), identity))


_KEYED = "keyed AS (SELECT *, lpad(to_hex(chain), 2, '0') || CASE pool_id % 2 WHEN 1 THEN '01' || lpad(lower(to_hex(pool_id)), 64, '0') ELSE '00' || lpad(lower(to_hex(pool_id)), 40, '0') END AS key FROM pools)"


@query(f", {_KEYED} SELECT key, chain, CASE WHEN pool_id % 2 = 1 THEN 'v4' ELSE 'v3' END AS protocol, right(key, length(key) - 4) AS identity FROM keyed UNION ALL SELECT left(key, length(key) - 2), NULL, NULL, NULL FROM keyed UNION ALL SELECT left(key, 2) || '02' || right(key, length(key) - 4), NULL, NULL, NULL FROM keyed")
def cache_keys(spark, d):
    """Keys decoded again; also cut ones and ones of an unknown protocol."""
    keys = _keyed(spark, d).select("key")
    rest = F.expr("substring(key, 5)")
    keys = keys.union(keys.select(F.expr("left(key, length(key) - 2)"))).union(keys.select(F.concat(F.expr("left(key, 2)"), F.lit("02"), rest)))
    return keys.select("key", K.decoded_key(F.col("key")).alias("k")).select("key", "k.chain", "k.protocol", "k.identity")


def _cached(spark, d):
    """Every third pool is cached; even pools came anew, with failures among the later results."""
    rows = _keyed(spark, d)
    cached = rows.where("pool_id % 3 = 0").select("chain", "key", "fee_pips")
    return K.upserted(cached, _results(rows), "fee_pips")


def _results(rows):
    first = rows.where("pool_id % 2 = 0").select("chain", "key", F.lit(1).alias("seq"), (F.col("pool_id") % 5 != 0).alias("ok"), (F.col("fee_pips") + 1).alias("fee_pips"))
    second = rows.where("pool_id % 4 = 0").select("chain", "key", F.lit(2).alias("seq"), (F.col("pool_id") % 8 == 0).alias("ok"), (F.col("fee_pips") + 2).alias("fee_pips"))
    return first.union(second)


_CACHED = f"""{_KEYED}, cached AS (SELECT chain, key, CASE WHEN pool_id % 8 = 0 THEN fee_pips + 2 WHEN pool_id % 2 = 0 AND pool_id % 5 <> 0 THEN fee_pips + 1 ELSE fee_pips END AS fee_pips
  FROM keyed WHERE pool_id % 3 = 0 OR pool_id % 8 = 0 OR (pool_id % 2 = 0 AND pool_id % 5 <> 0))"""


@query(f", {_CACHED} SELECT * FROM cached")
def cache_upsert(spark, d):
    return _cached(spark, d)


def _written(spark, d):
    """The same cache kept in buckets: what was cached before, then the later results as a second version."""
    rows = _keyed(spark, d)
    store = K.Cache(spark, folder(spark, "cache"), "fee_pips long")
    store.upsert(rows.where("pool_id % 3 = 0").select("chain", "key", F.lit(0).alias("seq"), F.lit(True).alias("ok"), "fee_pips"))
    store.upsert(_results(rows))
    return store


@query(f", {_CACHED} SELECT * FROM cached WHERE chain = 2")
def cache_scan(spark, d):
    """One chain of the bucketed cache."""
    return _written(spark, d).read(2)


@query(f", {_CACHED} SELECT cached.* FROM cached JOIN keyed USING (chain, key) WHERE pool_id % 10 = 4")
def cache_lookup(spark, d):
    """Every tenth pool's entry, from the buckets that hold them."""
    return _written(spark, d).lookup(_keyed(spark, d).where("pool_id % 10 = 4"))


@query(", own AS (SELECT * FROM pools WHERE pool_id % 3 = 0) SELECT 'pool' AS kind, chain, pool_id AS key FROM own UNION ALL SELECT DISTINCT 'token', chain, t FROM (SELECT chain, unnest([token0, token1]) AS t FROM own) WHERE (t + chain) % 4 <> 0")
def cache_rehydrated(spark, d):
    chains = M.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("chain"))
    tokens = M.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("token"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rest"))
    known = tokens.join(F.broadcast(chains), (F.col("token") + F.col("chain")) % 4 == F.col("rest")).where("rest <> 0").select("chain", "token")  # five regions
    return K.rehydrated(M.pools(spark, d).where("pool_id % 3 = 0"), known)


@query("SELECT lpad(lower(to_hex(n_nationkey)), 40, '0') AS token, CASE WHEN n_nationkey % 3 = 1 THEN (6 + n_nationkey)::INT WHEN n_nationkey = 0 THEN 18 END AS decimals FROM nation")
def native_decimals(spark, d):
    tokens = M.table(spark, d, "nation").select(_hex("n_nationkey").alias("token"), "n_nationkey")
    return K.token_decimals(tokens.select("token"), tokens.where("n_nationkey % 3 = 1").select("token", (F.col("n_nationkey") + 6).cast("int").alias("decimals")))


def _indexed(spark, d):
    """Pool keys with the ids that the indexer claims, and the responses that hold them, eight pool ids each."""
    pools = M.pools(spark, d)
    keys = pools.select(
        "chain", "pool_id", F.floor(F.col("pool_id") / 8).alias("response"), _hex("pool_id").alias("currency0"), _hex("token1").alias("currency1"),
        (F.col("fee_pips") + F.when(F.col("pool_id") % 5 == 0, D.DYNAMIC_FEE).otherwise(0)).alias("fee"),
        F.when(F.col("pool_id") % 11 == 0, -F.col("tick_spacing")).otherwise(F.col("tick_spacing")).alias("tick_spacing"), F.when(F.col("pool_id") % 7 == 0, _hex("pool_id")).otherwise("0" * 40).alias("hooks"),
    )
    keys = cut(keys.withColumn("id", F.when(F.col("pool_id") % 9 == 0, _hex("pool_id", D.WORD)).otherwise(D.pool_key(keys))))
    entry = F.struct(
        "id", F.struct(F.col("currency0").alias("id")).alias("token0"), F.struct(F.col("currency1").alias("id")).alias("token1"), F.when(F.col("pool_id") % 23 == 3, "none").otherwise(F.col("fee").cast("string")).alias("feeTier"),
        F.when(F.col("pool_id") % 29 == 4, "8388608").otherwise(F.col("tick_spacing").cast("string")).alias("tickSpacing"), F.when(F.col("pool_id") % 31 != 5, F.col("hooks")).alias("hooks"),
    )
    bodies = keys.where("pool_id % 6 <> 2").groupBy("chain", "response").agg(F.collect_list(entry).alias("pools"))
    failed = F.when(F.col("response") % 7 == 3, F.array(F.struct(F.lit("busy").alias("message"))))
    body = F.to_json(F.struct(F.struct("pools").alias("data"), failed.alias("errors")))
    body = F.when(F.col("response") % 7 == 5, F.expr("left(body, length(body) - 2)")).when(F.col("response") % 7 == 6, "{}").otherwise(F.col("body"))
    bodies = bodies.withColumn("body", F.to_json(F.struct(F.struct("pools").alias("data"), failed.alias("errors")))).withColumn("body", body)
    return keys, bodies.select("chain", "response", "body"), keys.where("pool_id % 4 <> 1").select("chain", "id")


_INDEXED = """ent AS (SELECT *, pool_id // 8 AS response, pool_id % 4 <> 1 AS asked FROM pools WHERE pool_id % 6 <> 2),
resp AS (SELECT chain, response, CASE WHEN response % 7 = 5 THEN 'malformed' WHEN response % 7 = 6 THEN 'no_data' WHEN bool_or(pool_id % 31 = 5) THEN 'malformed' WHEN response % 7 = 3 THEN 'errors'
  WHEN bool_or(asked AND (pool_id % 23 = 3 OR pool_id % 29 = 4)) THEN 'bad_number' END AS fault, count_if(asked) AS n FROM ent GROUP BY chain, response)"""


@query(f", {_INDEXED} SELECT chain, response, fault, CASE WHEN fault IS NULL THEN n ELSE 0 END AS n_entries FROM resp")
def indexer_responses(spark, d):
    _, bodies, asked = _indexed(spark, d)
    return I.pool_responses(bodies, asked).select("chain", "response", "fault", F.greatest(F.coalesce(F.size("entries"), F.lit(0)), F.lit(0)).cast("long").alias("n_entries"))


@query(f""", {_INDEXED} SELECT ent.chain, pool_id, CASE WHEN pool_id % 5 = 0 THEN 'dynamic_fee' WHEN pool_id % 7 = 0 THEN 'hooked_pool' WHEN pool_id % 9 = 0 THEN 'id_mismatch' WHEN pool_id % 11 = 0 THEN 'bad_spacing' ELSE 'ok' END AS outcome
FROM ent JOIN resp ON resp.chain = ent.chain AND resp.response = ent.response WHERE asked AND fault IS NULL""")
def indexer_metadata(spark, d):
    """Outcomes of the pools that sound responses describe; pools that no response names are absent, not failed."""
    keys, bodies, asked = _indexed(spark, d)
    return I.pool_metadata(bodies, asked).join(keys.select("chain", "id", "pool_id"), ["chain", "id"]).select("chain", "pool_id", "outcome")


@query("""SELECT p_partkey // 20 AS page, lpad(lower(to_hex(p_partkey)), 40, '0') AS token, CASE WHEN p_size % 5 <> 0 THEN p_name END AS symbol, (p_size % 19)::BIGINT AS decimals, p_size % 3 = 0 AS trusted FROM part
WHERE p_size % 4 <> 0 AND p_partkey // 20 % 9 <> 4 AND p_partkey // 20 NOT IN (SELECT p_partkey // 20 FROM part WHERE p_partkey % 331 = 7 OR p_partkey % 211 = 9)""")
def popular_tokens(spark, d):
    """Pages of twenty items; some are cut short, hold an item without an address, or decimals beyond a byte."""
    key, size = F.col("p_partkey"), F.col("p_size")
    attributes = F.struct(
        F.when(key % 331 != 7, _hex("p_partkey")).alias("address"), F.when(size % 5 != 0, F.col("p_name")).alias("symbol"),
        F.when(key % 211 == 9, 300).otherwise(size % 19).alias("decimals"), F.when(size % 3 == 0, F.concat(F.lit("coin-"), key)).alias("coingecko_coin_id"),
    )
    items = M.table(spark, d, "part").select(F.floor(key / 20).alias("page"), F.struct(F.when(size % 4 == 0, "dex").otherwise("token").alias("type"), attributes.alias("attributes")).alias("item"))
    pages = items.groupBy("page").agg(F.to_json(F.struct(F.collect_list("item").alias("included"))).alias("body"))
    return I.popular_tokens(pages.withColumn("body", F.when(F.col("page") % 9 == 4, F.expr("left(body, length(body) div 2)")).otherwise(F.col("body"))))


@query("SELECT r_regionkey::BIGINT AS region, chain, token FROM region JOIN (VALUES " + ", ".join(f"({k}, '{c}', '{t}')" for k, (c, own) in enumerate(I.BASELINE.items()) for t in (own[0], "0" * 40, own[1])) + ") v(number, chain, token) ON number = r_regionkey")
def baseline_tokens(spark, d):
    """What is always proposed on the chains that regions stand for, in their order."""
    regions = M.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("region"), F.get(F.array(*map(F.lit, I.BASELINE)), "r_regionkey").alias("chain"))
    return regions.join(F.broadcast(I.baseline(spark)), "chain").select("region", "chain", "token")


@query(""", cl AS (SELECT chain, pool_id, token0, token1, CASE WHEN pool_id % 10 = 0 THEN 123 ELSE fee_pips END AS fee FROM pools)
SELECT cl.chain, cl.pool_id AS pool, CASE WHEN fee = 123 THEN 'unsupported_tier' WHEN f.pool IS DISTINCT FROM cl.pool_id THEN 'factory_mismatch' ELSE 'ok' END AS outcome
FROM cl LEFT JOIN (SELECT chain, token0, token1, fee_pips, min(pool_id) AS pool FROM pools WHERE pool_id % 13 <> 0 GROUP BY ALL) f ON f.chain = cl.chain AND f.token0 = cl.token0 AND f.token1 = cl.token1 AND f.fee_pips = cl.fee""")
def factory_checks(spark, d):
    """Claims of all pools against a factory that knows the first of equal ones and not every thirteenth."""
    pools = M.pools(spark, d)
    claims = pools.select("chain", F.col("pool_id").alias("pool"), "token0", "token1", F.when(F.col("pool_id") % 10 == 0, 123).otherwise(F.col("fee_pips")).cast("long").alias("fee"))
    factory = pools.where("pool_id % 13 <> 0").groupBy("chain", "token0", "token1", F.col("fee_pips").alias("fee")).agg(F.min("pool_id").alias("pool"))
    return I.factory_outcomes(claims, factory)


@query("SELECT DISTINCT token0 AS token_in, token1 AS token_out, token0 % 3 <> 1 AND token1 % 3 <> 1 AS kept FROM pools")
def bridge_split(spark, d):
    return I.split_bridges(M.pools(spark, d).select(F.col("token0").alias("token_in"), F.col("token1").alias("token_out")), C._allowed(spark, d), 5)


_SLUGS = list(I.BASELINE)
_LISTED = f"listed AS (SELECT ([{', '.join(repr(s) for s in _SLUGS)}])[(token % 6 + 1)::INT] AS chain, token, symbol FROM ex WHERE {C._YES})"


def _listed(spark, d):
    """Approved tokens dealt to six of the seven chains."""
    return C.whitelist_artifact(spark, d).select(F.get(F.array(*map(F.lit, _SLUGS)), (F.col("token") % 6).cast("int")).alias("chain"), "token", "symbol")


@query(f", {C._EXAMINED}, {_LISTED} SELECT * FROM listed")
def whitelist_round_trip(spark, d):
    """The whitelist written by chain and read back."""
    path = folder(spark, "whitelist")
    A.write_artifact(_listed(spark, d), path)
    return A.read_artifact(spark, path, _SLUGS)


@query(f", {C._EXAMINED}, {_LISTED} SELECT c.chain, count(DISTINCT token) AS n_tokens, count(token) = 0 AS warn FROM (SELECT unnest({_SLUGS}) AS chain) c LEFT JOIN listed ON listed.chain = c.chain GROUP BY c.chain")
def whitelist_summary(spark, d):
    active = spark.createDataFrame([(s,) for s in _SLUGS], "chain string")
    return A.chain_counts(active, _listed(spark, d))


@query(f", {C._EXAMINED} SELECT token, verdict, symbol, tvl FROM ex")
def vetting_report(spark, d):
    """The report of all decisions, written and read back."""
    path = folder(spark, "report")
    A.write_report(C._examined(spark, d).drop("approved"), path)
    return spark.read.schema("token long, verdict string, symbol string, tvl double").json(path)


@query("SELECT user_id % 20 AS chain, event_id AS block, event_type FROM events WHERE event_id % 3 <> 0 AND event_id % 5 IN (1, 2, 3)")
def staged_logs(spark, d):
    """Logs that wait for their block's head or it for them: every third head never comes, two in five too far apart."""
    stream = S.event_stream(spark, d).select((F.col("user_id") % 20).alias("chain"), F.col("event_id").alias("block"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    shifted = F.col("ts") + F.make_dt_interval(mins=(4 * (F.col("event_id") % 5 - 2)).cast("int"))
    heads = S.event_stream(spark, d).where("event_id % 3 <> 0").withColumn("ts", F.col("ts").cast("timestamp")).select((F.col("user_id") % 20).alias("head_chain"), F.col("event_id").alias("head_block"), shifted.alias("head_ts"))
    return S.append_to_table(S.staged(stream, heads), spark).select("chain", "block", "event_type")


def chain_events(spark, d):
    """Four chains out of the events: at each height a head, sometimes a late one or a fork, a log, a completed block, now and then finality."""
    e, user = F.col("event_id"), F.col("user_id")
    number = F.expr("event_id div 4") + 1001
    row = lambda kind, at, block, parent=None, index=None: F.struct(
        (F.expr("event_id div 4") * 10 + at).alias("seq"), F.lit(kind).alias("kind"), block.alias("block"), (F.lit(None).cast("long") if parent is None else parent).alias("parent"), number.alias("number"),
        (user % 3 != 0).alias("touched"), (F.lit(None).cast("long") if index is None else index).alias("log_index"), user.alias("pool_id"),
    )
    late = F.when(user % 37 == 5, 25).otherwise(0)
    rows = F.array_compact(F.array(
        row("log", F.lit(0), number + user % 3 - 1, index=user % 5), row("head", 1 + late, number, number - 1), F.when(user % 10 == 0, row("head", F.lit(2), number + 1_000_000, number - 1)),
        row("complete", F.lit(3), number - 2), F.when(number % 16 == 0, row("final", F.lit(4), number - 20)), F.when(user % 7 == 0, row("log", F.lit(5), number + user % 3 - 1, index=user % 5)),
    ))
    return M.table(spark, d, "events").select((e % 4).alias("chain"), F.explode(rows).alias("r")).select("chain", "r.*")


@query()
def chain_outcomes(spark, d):
    """What becomes of every event of the chains, in three deliveries between which the stream stops."""
    events = cut(chain_events(spark, d))
    last = events.agg(F.max("seq")).first()[0] or 0
    third = last // 3 + 1
    return chains.run_on(spark, [events.where((F.col("seq") >= k * third) & (F.col("seq") < (k + 1) * third)) for k in range(3)], 1000)
