"""Registered queries of gates, funnels, catalog and snapshot views, ranges of ticks and lines of logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import lines, ticks
from tidepool.functions.keccak import topic
from tidepool.operators import checks, dims, registry, routing
from tidepool.operators import blocks as B
from tidepool.operators import decode as D
from tidepool.operators.ordered import numbered
from tidepool.plans import catalog as C
from tidepool.plans.catalog import query
from tidepool.plans.lookups import OUTPUT, SOURCE
from tidepool.sources import market as M


@query("""SELECT chain, pool_id, CASE WHEN pool_id % 6 = 1 THEN 'unsupported_tier' WHEN token0 % 3 = 1 OR token1 % 3 = 1 THEN 'token_not_whitelisted' ELSE 'ok' END AS outcome,
  CASE WHEN pool_id % 6 <> 1 THEN CASE WHEN token0 % 3 = 1 THEN token0 WHEN token1 % 3 = 1 THEN token1 END END AS reason_token FROM pools""")
def discovery_gate(spark, d):
    """Pools as they are found: failures of their metadata, then the first token that the whitelist lacks."""
    found = M.pools(spark, d).withColumns({"ok": F.col("pool_id") % 6 != 1, "failure": F.when(F.col("pool_id") % 6 == 1, "unsupported_tier")})
    return registry.gated(found, C._allowed(spark, d)).select("chain", "pool_id", "outcome", "reason_token")


@query(", adm AS (SELECT * FROM pools WHERE token0 % 3 <> 1 AND token1 % 3 <> 1)" + C._core_sql("SELECT pool_id::VARCHAR AS id, token0 AS a, token1 AS b FROM adm WHERE token0 <> token1", "adm", 2, 5, 25))
def admission_funnel(spark, d):
    """The whitelist, then what can lie on a route."""
    admitted = registry.whitelist_gate(M.pools(spark, d).select("pool_id", "token0", "token1"), C._allowed(spark, d))
    return routing.two_core(admitted, 2, 5)


@query(f""", {C._WS}, sh AS (SELECT chain * 100 + token0 AS chain, pool_id, token0, token1, tick, liquidity FROM ws), bad AS (SELECT DISTINCT chain FROM sh WHERE tick IS NULL OR token0 % 12 = 11 OR token1 % 12 = 11)
SELECT sh.*, ([{', '.join(map(str, C._SCALES))}])[(token0 % 3 + 1)::INT] AS decimals0, ([{', '.join(map(str, C._SCALES))}])[(token1 % 3 + 1)::INT] AS decimals1 FROM sh WHERE chain NOT IN (SELECT chain FROM bad)""")
def projection_by_chain(spark, d):
    """States with both decimals, whole chains or none; a chain and first token stand for a chain here."""
    rows = C._with_state(spark, d).select((F.col("chain") * 100 + F.col("token0")).alias("chain"), "pool_id", "token0", "token1", "tick", "liquidity")
    return registry.whole_chains(rows, C._decimals(spark, d))


@query("SELECT chain, pool_id, row_number() OVER (ORDER BY pool_id % 2, pool_id, chain) - 1 AS position FROM pools")
def pool_order(spark, d):
    """The order in which every reader lists pools: protocol, id, chain."""
    rows = M.pools(spark, d).select("chain", "pool_id", (F.col("pool_id") % 2).alias("protocol"))
    return numbered(rows, "protocol", "pool_id", "chain").select("chain", "pool_id", "position")


_TICKED = "tk AS (SELECT p_partkey, (p_partkey * 8887) % 1800001 - 900000 AS tick, (p_size % 7 * 60)::BIGINT AS spacing FROM part UNION ALL SELECT -k, t, s FROM (VALUES (1, -887272, 60), (2, 887272, 60), (3, 887271, 200), (4, 0, -1)) v(k, t, s), (SELECT 1 FROM part LIMIT 1))"


@query(f""", {_TICKED}, fl AS (SELECT *, CASE WHEN tick NOT BETWEEN {ticks.MIN_TICK} AND {ticks.MAX_TICK} THEN 'out_of_bounds' WHEN spacing <= 0 THEN 'bad_spacing' END AS failure FROM tk),
lo AS (SELECT *, CASE WHEN failure IS NULL THEN greatest(tick - ((tick % spacing) + spacing) % spacing, {ticks.MIN_TICK}) END AS low FROM fl)
SELECT p_partkey, tick, spacing, low, CASE WHEN low IS NOT NULL THEN least(low + spacing, {ticks.MAX_TICK}) END AS high, failure FROM lo""")
def tick_ranges(spark, d):
    """Ranges of ticks over all that there can be and beyond, with spacings that aren't positive."""
    part = M.table(spark, d, "part")
    rows = part.select("p_partkey", (F.col("p_partkey") * 8887 % 1800001 - 900000).alias("tick"), (F.col("p_size") % 7 * 60).cast("long").alias("spacing"))
    edges = part.limit(1).select(F.explode(F.array(*(F.struct(F.lit(-k).cast("long").alias("p_partkey"), F.lit(t).cast("long").alias("tick"), F.lit(s).cast("long").alias("spacing")) for k, t, s in ((1, -887272, 60), (2, 887272, 60), (3, 887271, 200), (4, 0, -1))))).alias("e")).select("e.*")
    return rows.union(edges).withColumn("r", ticks.tick_range(F.col("tick"), F.col("spacing"))).select("p_partkey", "tick", "spacing", "r.*")


_SPACES = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+"


@query(f"""SELECT page_id, sha256(CASE WHEN length(l) > {lines.MOST_BODY} THEN substr(l, 1, {lines.MOST_BODY}) || '…' ELSE l END) AS line_sha256, sha256(CASE WHEN length(html) > {lines.MOST_DETAIL} THEN substr(html, 1, {lines.MOST_DETAIL}) || '…' ELSE html END) AS detail_sha256
FROM (SELECT page_id, html, trim(regexp_replace(html, '{_SPACES}', ' ', 'g')) AS l FROM pages)""")
def error_bodies(spark, d):
    """Pages as bodies of errors: on one line and cut, and cut alone."""
    rows = M.table(spark, d, "pages")
    return rows.select("page_id", F.sha2(lines.one_line(F.col("html")), 256).alias("line_sha256"), F.sha2(lines.cut(F.col("html")), 256).alias("detail_sha256"))


_NAMES = {c[0]: "BNB Chain" if c[0] == "bnb" else c[0].capitalize() for c in dims.CHAINS}


@query(f""", {C._FRONTIER.format(least=1)}, pc AS (SELECT chain, count(*) AS n FROM pools GROUP BY chain) SELECT chain, printf('%s: Active  pools=%s  behind=%s  window=%s  inflight=%s  ws_miss=%s', ({list(_NAMES.values())})[(chain + 1)::INT], any_value(n)::VARCHAR,
  coalesce((max(number) - any_value(frontier))::VARCHAR, '?'), (max(number) - min(number))::VARCHAR, count_if(authority = 0)::VARCHAR, count_if(authority = 1 AND touched)::VARCHAR) AS line FROM blocks JOIN front USING (chain) JOIN pc USING (chain) GROUP BY chain""")
def progress_lines(spark, d):
    """A line of text for each chain; a distance that isn't known is a question mark."""
    blocks = C._blocks(spark, d)
    rows = blocks.groupBy("chain").agg(F.max("number").alias("tip"), F.min("number").alias("low"), F.count_if(F.col("authority") == 0).alias("open"), F.count_if((F.col("authority") == 1) & F.col("touched")).alias("missed"))
    pools = M.pools(spark, d).groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(B.frontier(blocks, 1), "chain").join(pools, "chain")
    name = F.get(F.array(*map(F.lit, _NAMES.values())), F.col("chain").cast("int"))
    return rows.select("chain", lines.progress(name, F.col("n"), F.col("tip") - F.col("frontier"), F.col("tip") - F.col("low"), F.col("open"), F.col("missed")).alias("line"))


@query(f""", {C._RES}, per AS (SELECT chain, bool_or(token1 = {OUTPUT}) AS o, bool_or(token0 = {SOURCE} OR token1 = {SOURCE}) AS s FROM res GROUP BY chain)
SELECT r_regionkey::BIGINT AS chain, coalesce(NOT o, true) OR coalesce(NOT s, true) AS is_gap FROM region LEFT JOIN per ON chain = r_regionkey""")
def route_gaps(spark, d):
    """Whether a chain's snapshot lacks an end of the route, which the next one may have."""
    asked = M.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("chain"), F.lit(1000).alias("amount"))
    return checks.validate(asked, C._reserves(spark, d), SOURCE, OUTPUT).select("chain", checks.transient(F.col("outcome")).alias("is_gap"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 10 <> 0 THEN own END WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 9 <> 0 THEN own END WHEN p_partkey % 5 = 0 THEN own END AS target
FROM (SELECT p_partkey, lpad(lower(to_hex(p_partkey)), 40, '0') AS own FROM part)""")
def proxy_targets(spark, d):
    """Minimal proxies, implementation and beacon slots; some hold zero, reading others failed."""
    p = F.col("p_partkey")
    own, zero = F.lpad(F.lower(F.hex(p)), 40, "0"), F.lit("0" * 40)
    code = F.when(p % 2 == 0, F.concat(F.lit(checks.PROXY[0]), F.when(p % 10 == 0, zero).otherwise(own), F.lit(checks.PROXY[1]))).otherwise("6080")
    word = lambda a: F.lpad(a, 64, "0")
    slot = F.when(p % 3 == 0, word(F.when(p % 9 == 0, zero).otherwise(own)))
    return M.table(spark, d, "part").select("p_partkey", checks.slot_target(code, slot, F.when(p % 5 == 0, word(own))).alias("target"))


_REGISTERED = f"reg AS (SELECT DISTINCT chain, t AS token, ([{', '.join(map(str, C._SCALES))}])[(t % 3 + 1)::INT] AS decimals FROM (SELECT chain, unnest([token0, token1]) AS t FROM pools) WHERE t % 12 <> 11 AND t <> 0)"


@query(f", {_REGISTERED}, vp AS (SELECT * FROM pools WHERE pool_id % 6 <> 1) SELECT DISTINCT chain, token, decimals FROM (SELECT chain, unnest([token0, token1]) AS token FROM vp) JOIN reg USING (chain, token)")
def catalog_view(spark, d):
    """Tokens of the verified pools with validated decimals; token 0 is native, has no row and isn't made up."""
    pools = M.pools(spark, d)
    tokens = registry.referenced_tokens(pools).where("token <> 0").join(C._decimals(spark, d), "token")
    return registry.catalog_tokens(pools.where("pool_id % 6 <> 1"), tokens)


@query(f""", {C._PLACED}, {C._FRONTIER.format(least=1)}, r AS (SELECT placed.* FROM placed JOIN front USING (chain) WHERE number <= frontier), {C._fold_sql('r', 'f')}, fc AS (SELECT chain, count(*) AS n FROM f GROUP BY chain), pc AS (SELECT chain, count(*) AS n FROM pools GROUP BY chain)
SELECT b.chain, min(number) AS finalized, max(number) AS canonical, any_value(frontier) AS frontier, max(number) - any_value(frontier) AS behind, any_value(pc.n) AS n_verified, coalesce(any_value(fc.n), 0) AS n_projected
FROM blocks b JOIN front ON front.chain = b.chain JOIN pc ON pc.chain = b.chain LEFT JOIN fc ON fc.chain = b.chain GROUP BY b.chain""")
def server_snapshot(spark, d):
    """Each chain's heads, frontier and lag, its verified pools, and how many have a state there, from one fold."""
    blocks = C._blocks(spark, d)
    heads = blocks.groupBy("chain").agg(F.min("number").alias("finalized"), F.max("number").alias("canonical"))
    states = C.state_at_frontier(spark, d).groupBy("chain").agg(F.count(F.lit(1)).alias("n_projected"))
    pools = M.pools(spark, d).groupBy("chain").agg(F.count(F.lit(1)).alias("n_verified"))
    rows = heads.join(B.frontier(blocks, 1), "chain").join(pools, "chain").join(states, "chain", "left")
    return rows.select("chain", "finalized", "canonical", "frontier", (F.col("canonical") - F.col("frontier")).alias("behind"), "n_verified", F.coalesce("n_projected", F.lit(0)).alias("n_projected"))


@query(f""", {C._PLACED} SELECT chain, number AS block_number, lpad(lower(to_hex(number)), 64, '0') AS block_hash, count(*) AS n_logs,
  min(CASE WHEN l_partkey % 17 <> 0 THEN l_orderkey * 8 + l_linenumber END) AS first_index, max(CASE WHEN l_partkey % 17 <> 0 THEN l_orderkey * 8 + l_linenumber END) AS last_index
FROM placed WHERE l_linenumber <> 6 AND l_partkey % 29 <> 0 AND number >= 0 AND l_partkey % 31 <> 0 GROUP BY chain, number""")
def logs_by_block(spark, d):
    """Subscribed logs of ranges, by block; some are of a stateless event, others of none."""
    placed = C._placed(spark, d).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), "l_partkey", "chain", "l_linenumber", "number")
    zero = F.lit("0" * 64)
    first = F.when(F.col("l_partkey") % 31 == 0, zero).when(F.col("l_partkey") % 7 == 0, F.lit(topic(D.STATELESS[0]))).otherwise(F.lit(next(iter(D.TOPICS))))
    logs = placed.where("number >= 0").select(
        "chain", F.array(first).alias("topics"), F.when(F.col("l_partkey") % 29 != 0, F.lpad(F.lower(F.hex("number")), 64, "0")).alias("block_hash"), F.col("number").alias("block_number"),
        F.when(F.col("l_partkey") % 17 != 0, F.col("line")).alias("log_index"), (F.col("l_linenumber") == 6).alias("removed"),
    )
    return D.by_block(D.topic_filter(logs))
