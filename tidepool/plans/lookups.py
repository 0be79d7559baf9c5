"""Registered queries of admission, paging, fetch planning, checks, codecs and exact reserves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import ticks, wide
from tidepool.operators import blocks as B
from tidepool.operators import checks, flows, route_table, vetting
from tidepool.operators import plans as X
from tidepool.plans import catalog as C
from tidepool.plans.catalog import query
from tidepool.plans.lineage import cut
from tidepool.sources import market as M

#: Blocks in a page of logs, by chain (fixed values for the first two; else the last).
PAGES, PAGE = {0: 100, 1: 250}, 5000
SOURCE, OUTPUT = 1, 5


@query(f"""SELECT chain, f AS page_from, least(f + page - 1, hi)::BIGINT AS page_to FROM (SELECT chain, hi, page, unnest(range(lo, hi + 1, page)) AS f FROM
  (SELECT chain, min(number) AS lo, max(number) AS hi, CASE chain WHEN 0 THEN 100 WHEN 1 THEN 250 ELSE {PAGE} END AS page FROM blocks GROUP BY chain))""")
def log_pages(spark, d):
    return checks.pages(C._blocks(spark, d), PAGES, PAGE)


@query("SELECT a.chain, a.number FROM (SELECT chain, unnest(range(min(number), max(number) + 1)) AS number FROM blocks GROUP BY chain) a WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.chain = a.chain AND b.number = a.number)")
def complete_empty(spark, d):
    """Blocks that a ranged fetch covered and that gave no logs."""
    blocks = C._blocks(spark, d).select("chain", "number")
    covered = blocks.groupBy("chain").agg(F.min("number").alias("lo"), F.max("number").alias("hi")).select("chain", F.explode(F.sequence("lo", "hi")).alias("number"))
    return covered.join(blocks, ["chain", "number"], "left_anti")


@query(""", sent AS (SELECT chain, block, 0::BIGINT AS arrival, parent FROM heads UNION ALL SELECT chain, block, 1, block FROM heads WHERE block % 7 = 0
  UNION ALL SELECT chain, block, 2, block - 3 FROM heads WHERE block % 9 = 0 UNION ALL SELECT chain, block, 3, parent FROM heads WHERE block % 13 = 0)
SELECT s.chain, s.block, arrival, s.parent, CASE WHEN s.parent = s.block THEN 'self_parent' WHEN arrival = 0 THEN 'admitted' WHEN s.parent IS NOT DISTINCT FROM h.parent THEN 'duplicate' ELSE 'conflicting_parent' END AS outcome
FROM sent s JOIN heads h ON s.chain = h.chain AND s.block = h.block""")
def header_admission(spark, d):
    heads = M.heads(spark, d)
    sent = heads.select("chain", "block", F.lit(0).cast("long").alias("arrival"), "parent")
    for arrival, every, parent in ((1, 7, F.col("block")), (2, 9, F.col("block") - 3), (3, 13, F.col("parent"))):
        sent = sent.union(heads.where(F.col("block") % every == 0).select("chain", "block", F.lit(arrival).cast("long"), parent.alias("parent")))
    return B.admission(sent)


@query(f", {C._PLACED}, {C._fold_sql('placed', 'f')} SELECT pools.chain, pools.pool_id FROM pools LEFT JOIN f USING (chain, pool_id) WHERE f.tick IS NULL ORDER BY pools.chain, pools.pool_id LIMIT 100")
def work_to_fetch(spark, d):
    """The next 100 pools without a state, in order (the limit is the size of a request)."""
    return M.pools(spark, d).select(*C.KEYS).join(C.pool_state_fold(spark, d), C.KEYS, "left_anti").orderBy(*C.KEYS).limit(100)


@query("SELECT pool_id, max(number) AS number FROM logs WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = pool_id) GROUP BY pool_id")
def candidate_blocks(spark, d):
    """Pools that no registry knows, each owned by the newest block that names it."""
    known = M.table(spark, d, "orders").select(F.col("o_custkey").alias("pool_id"))
    return M.logs(spark, d).groupBy("pool_id").agg(F.max("number").alias("number")).join(known, "pool_id", "left_anti")


@query(f", {C._RES} SELECT chain, coalesce(bool_or(token1 = {OUTPUT}), false) AS to_output, coalesce(bool_or(token0 = {SOURCE} OR token1 = {SOURCE}), false) AS at_source FROM res GROUP BY chain")
def route_coverage(spark, d):
    return checks.coverage(C._reserves(spark, d), ["chain"], SOURCE, OUTPUT)


@query(f""", {C._RES}, per AS (SELECT chain, max(n) AS n, bool_or(token1 = {OUTPUT}) AS o, bool_or(token0 = {SOURCE} OR token1 = {SOURCE}) AS s FROM (SELECT chain, pool_id, token0, token1, count(*) AS n FROM res GROUP BY ALL) GROUP BY chain)
SELECT r_regionkey::BIGINT AS chain, CASE WHEN 1000 - 500 * r_regionkey <= 0 THEN 'bad_amount' WHEN n IS NULL THEN 'empty' WHEN n > 1 THEN 'duplicate' WHEN NOT o THEN 'no_output' WHEN NOT s THEN 'no_source' ELSE 'ok' END AS outcome FROM region LEFT JOIN per ON chain = r_regionkey""")
def snapshot_validation(spark, d):
    asked = M.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("chain"), (1000 - 500 * F.col("r_regionkey")).alias("amount"))
    return checks.validate(asked, C._reserves(spark, d), SOURCE, OUTPUT)


@query("""SELECT a.n_nationkey::BIGINT AS token, b.n_nationkey::BIGINT AS other, CASE WHEN a.n_nationkey % 7 = 0 OR b.n_nationkey % 7 = 0 THEN 'unknown_decimals' WHEN a.n_nationkey % 3 <> b.n_nationkey % 3 THEN 'decimals_differ' ELSE 'ok' END AS outcome
FROM nation a JOIN nation b ON b.n_nationkey IN (a.n_nationkey + 1, a.n_nationkey + 3)""")
def bridge_precondition(spark, d):
    """Bridges between tokens whose decimals are both known and equal."""
    tokens = M.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("token"))
    decimals = tokens.where("token % 7 <> 0").select("token", F.get(F.array(*map(F.lit, (6, 8, 18))), (F.col("token") % 3).cast("int")).alias("decimals"))
    bridges = tokens.select("token", F.explode(F.array(F.col("token") + 1, F.col("token") + 3)).alias("other"))
    bridges = bridges.join(tokens.select(F.col("token").alias("other")), "other")
    return checks.bridges(bridges, decimals)


@query(f""", {C._FLOWS} SELECT token0, round(e, 6) AS entropy, round(exp(e), 6) AS perplexity, n_pools FROM
  (SELECT token0, ln(sum(s)::DOUBLE) - sum(s * ln(s)) / sum(s)::DOUBLE AS e, count(*) AS n_pools FROM (SELECT token0, pool_id, sum(amount_in)::DOUBLE AS s FROM flows GROUP BY ALL) WHERE s > 0 GROUP BY token0)""")
def flow_entropy(spark, d):
    return flows.entropy(C._flows(spark, d), ["token0"], "pool_id")


@query("""SELECT p_partkey, word, right(word, 40) AS address, '0x' || lower(to_hex(p_partkey)) AS quantity, CASE WHEN p_partkey <= 36 THEN p_partkey END AS decimals, regexp_extract(code, '^363d3d373d3d3d363d73([0-9a-f]{40})5af43d82803e903d91602b57fd5bf3$', 1) AS target
FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN '363d3d373d3d3d363d73' || right(word, 40) || '5af43d82803e903d91602b57fd5bf3' ELSE '60' || word END AS code FROM (SELECT p_partkey, lpad(lower(to_hex(p_partkey)), 64, '0') AS word FROM part))""")
def word_codecs(spark, d):
    """Storage words to numbers, addresses and minimal-proxy targets."""
    word = F.lpad(F.lower(F.hex("p_partkey")), 64, "0")
    rows = M.table(spark, d, "part").select("p_partkey", word.alias("word"))
    address = checks.word_address(F.col("word"))
    code = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(checks.PROXY[0]), address, F.lit(checks.PROXY[1]))).otherwise(F.concat(F.lit("60"), "word"))
    return rows.select("p_partkey", "word", address.alias("address"), checks.quantity(F.col("p_partkey")).alias("quantity"), checks.word_decimals(F.col("word")).alias("decimals"), checks.proxy_target(code).alias("target"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS written_at, count(*) AS n FROM orders GROUP BY written_at")
def report_times(spark, d):
    return M.table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("written_at")).agg(F.count(F.lit(1)).alias("n"))


@query(f""", {C._PROJ}, ex AS (SELECT st.*, p.p AS price, l * {1 << 96}::HUGEINT // p.p AS x, l * p.p // {1 << 96}::HUGEINT AS y, l * {1 << 96}::HUGEINT // a.p AS low_x, l * b.p // {1 << 96}::HUGEINT AS high_y FROM
  (SELECT pools.*, tick, liquidity::HUGEINT AS l, tick - ((tick % tick_spacing) + tick_spacing) % tick_spacing AS lo FROM pools JOIN f USING (chain, pool_id)) st JOIN prices p ON p.t = tick JOIN prices a ON a.t = lo JOIN prices b ON b.t = lo + tick_spacing)
SELECT chain, pool_id, fee_pips, l::VARCHAR AS depth, price::VARCHAR AS price, x::VARCHAR AS x, y::VARCHAR AS y, (low_x - x)::VARCHAR AS max_x, (high_y - y)::VARCHAR AS max_y, NULL::VARCHAR AS failure FROM ex""")
def virtual_reserves(spark, d):
    """Exact reserves of every derivable pool at its tick, with what fits into its tick range."""
    state = M.pools(spark, d).join(C.pool_state_fold(spark, d).select("chain", "pool_id", "tick", "liquidity"), C.KEYS)
    low = ticks.tick_floor(F.col("tick"), F.col("tick_spacing"))
    prices = state.select("chain", "pool_id", "fee_pips", F.col("liquidity").cast("string").alias("depth"), ticks.sqrt_price_text("tick").alias("price"), ticks.sqrt_price_text(low).alias("low"), ticks.sqrt_price_text(low + F.col("tick_spacing")).alias("high"))
    return prices.withColumn("r", wide.reserve_texts("depth", "price", "low", "high")).select("chain", "pool_id", "fee_pips", "depth", "price", "r.*")


def _sessions(spark, d):
    """A closed route of 1000 from every token of a chain, and the directional cells of the chain's pools."""
    cells = cut(C.reserves_directional(spark, d).where("token_in <> token_out").withColumnRenamed("chain", "market").withColumn("disabled", F.lit(False)))  # a model reads them again and again
    tokens = cells.select("market", F.col("token_in").alias("source")).distinct()
    rows = tokens.select((F.col("market") * 1000 + F.col("source")).alias("session_id"), "market", "source", F.col("source").alias("output"), F.lit(1000.0).alias("amount"))
    return rows, cells


_PAIRS = f"{C._RES}, cell AS (SELECT chain AS market, token0 AS token_in, token1 AS token_out, pool_id FROM res WHERE token0 <> token1 UNION ALL SELECT chain, token1, token0, pool_id FROM res WHERE token0 <> token1)"


@query(f""", {C._RES}, cell AS (SELECT chain, token0 AS a, token1 AS b, r0 AS x, r1 AS y, fee AS g, max0 AS cap FROM res WHERE token0 <> token1
  UNION ALL SELECT chain, token1, token0, r1, r0, fee, max1 FROM res WHERE token0 <> token1),
slots AS (SELECT chain, b AS t, max(n) AS m FROM (SELECT chain, a, b, count(*) AS n FROM cell GROUP BY ALL) GROUP BY ALL), total AS (SELECT chain, sum(m)::DOUBLE AS r FROM slots GROUP BY chain),
v0 AS (SELECT DISTINCT chain, a AS s, a AS t, 1000.0::DOUBLE AS v FROM cell),
v1 AS (SELECT chain, s, t, sum(v) AS v FROM (SELECT v0.chain, s, b AS t, y * least(v / r * g, cap) / (x + least(v / r * g, cap) + {2.0**-23!r}) AS v FROM v0 JOIN cell ON cell.chain = v0.chain AND a = t JOIN total ON total.chain = v0.chain
  UNION ALL SELECT v0.chain, s, v0.t, v * m / r FROM v0 JOIN slots ON slots.chain = v0.chain AND slots.t = v0.t JOIN total ON total.chain = v0.chain) GROUP BY ALL),
v2 AS (SELECT chain, s, t, sum(v) AS v FROM (SELECT v1.chain, s, b AS t, y * least(v / r * g, cap) / (x + least(v / r * g, cap) + {2.0**-23!r}) AS v FROM v1 JOIN cell ON cell.chain = v1.chain AND a = t JOIN total ON total.chain = v1.chain
  UNION ALL SELECT v1.chain, s, v1.t, v * m / r FROM v1 JOIN slots ON slots.chain = v1.chain AND slots.t = v1.t JOIN total ON total.chain = v1.chain) GROUP BY ALL),
v3 AS (SELECT chain, s, sum(v) AS v FROM (SELECT v2.chain, s, y * least(v / m * g, cap) / (x + least(v / m * g, cap) + {2.0**-23!r}) AS v FROM v2 JOIN cell ON cell.chain = v2.chain AND a = v2.t AND b = s JOIN slots ON slots.chain = v2.chain AND slots.t = s
  UNION ALL SELECT chain, s, v FROM v2 WHERE t = s) GROUP BY ALL)
SELECT chain * 1000 + s AS session_id, round(v, 6) AS start FROM v3""")
def route_forward(spark, d):
    """What every closed route returns at equal shares."""
    return route_table.evaluate(*_sessions(spark, d), 0).select("session_id", F.round("start", 6).alias("start"))


@query()
def route_flows(spark, d):
    """The flows of every closed route after ten steps of training, cells that are alike together."""
    return route_table.RouteModel(*_sessions(spark, d)).train(10).flows()


@query(f""", {_PAIRS}, old AS (SELECT *, row_number() OVER (PARTITION BY market, token_in, token_out ORDER BY pool_id) - 1 AS slot, 0 AS epoch FROM cell WHERE pool_id % 3 <> 0),
new AS (SELECT cell.*, coalesce(taken, 0) + row_number() OVER (PARTITION BY market, token_in, token_out ORDER BY pool_id) - 1 AS slot, 1 AS epoch FROM cell LEFT JOIN
  (SELECT market, token_in, token_out, count(*) AS taken FROM old GROUP BY ALL) USING (market, token_in, token_out) WHERE pool_id % 3 = 0)
SELECT market, token_in, token_out, slot::BIGINT AS slot, pool_id, epoch::BIGINT AS epoch FROM old UNION ALL SELECT market, token_in, token_out, slot::BIGINT, pool_id, epoch::BIGINT FROM new""")
def route_layout(spark, d):
    """Slots after a snapshot of two pools in three and one of all: those of the first stay."""
    _, cells = _sessions(spark, d)
    return route_table.grown_layout(route_table.grown_layout(None, cells.where("pool_id % 3 <> 0"), 0), cells, 1)


@query()
def route_reconcile(spark, d):
    """What closed routes return before a model grows, as it has grown, after training, and with every fifth pool gone."""
    sessions, cells = _sessions(spark, d)
    model = route_table.RouteModel(sessions, cells.where("pool_id % 3 <> 0")).train(2)
    out = model.evaluate().withColumnRenamed("output", "before")
    for name, rows, steps in (("grown", cells, 0), ("trained", cells, 2), ("dropped", cells.where("pool_id % 5 <> 0"), 0)):
        model.reconcile(rows)
        out = out.join(model.train(steps).evaluate().withColumnRenamed("output", name), "session_id")
    return out


#: Flows lighter than this are pruned from the plans of blocks.
LIGHT = 0.2
_CELLS_OF_BLOCKS = """cell AS (SELECT chain * 100000 + number AS plan_id, l_linenumber::BIGINT % 3 AS stage, token0 AS token_in, CASE l_linenumber WHEN 7 THEN token0 ELSE token1 END AS token_out,
  CASE WHEN l_linenumber <> 7 AND l_partkey % 6 <> 0 THEN pool_id END AS pool_id, l_linenumber / 8.0::DOUBLE AS weight, amount AS amount_in, amount - tick AS amount_out FROM logs JOIN pools USING (pool_id)),
kinds AS (SELECT *, CASE WHEN token_in % 2 = 0 AND token_out = token_in + 1 THEN 'bridge' WHEN pool_id IS NOT NULL THEN 'swap' WHEN token_in = token_out THEN 'carry' END AS kind FROM cell WHERE weight >= 0.2),
merged AS (SELECT plan_id, stage, token_in, token_out, kind, CASE kind WHEN 'swap' THEN pool_id END AS pool_id, sum(weight) AS weight, sum(amount_in)::BIGINT AS amount_in, sum(amount_out)::BIGINT AS amount_out FROM kinds WHERE kind IS NOT NULL GROUP BY ALL)"""


def _block_plans(spark, d):
    """Every block's logs as the cells of one plan, with bridges from even tokens to the next."""
    rows = M.logs(spark, d).join(M.pools(spark, d).select("chain", "pool_id", "token0", "token1"), "pool_id")
    line = F.col("l_linenumber")
    cells = rows.select(
        (F.col("chain") * 100000 + F.col("number")).alias("plan_id"), (line.cast("long") % 3).alias("stage"), F.col("token0").alias("token_in"), F.when(line == 7, F.col("token0")).otherwise(F.col("token1")).alias("token_out"),
        F.when((line != 7) & (F.col("l_partkey") % 6 != 0), F.col("pool_id")).alias("pool_id"), (line / 8.0).alias("weight"), F.col("amount").alias("amount_in"), (F.col("amount") - F.col("tick")).alias("amount_out"),
    )
    tokens = M.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("token_in"))
    return X.build(cells, tokens.withColumn("token_out", F.col("token_in") + 1), LIGHT)


@query(f", {_CELLS_OF_BLOCKS} SELECT plan_id, stage, token_in, token_out, kind, pool_id, amount_in, amount_out, round(weight / sum(weight) OVER (PARTITION BY plan_id, stage, token_in), 9) AS weight FROM merged")
def plan_build(spark, d):
    return _block_plans(spark, d).withColumn("weight", F.round("weight", 9))


def _plan_inputs(spark, d):
    """Plans of blocks from the smallest token of their first stage to the largest of their last, their steps and exact reserves."""
    steps = cut(_block_plans(spark, d).drop("amount_in", "amount_out"))  # read for the ends, and again in every check
    ends = steps.groupBy("plan_id").agg(F.min_by("token_in", F.struct("stage", "token_in")).alias("source"), F.max_by("token_out", F.struct("stage", "token_out")).alias("output"))
    book = virtual_reserves(spark, d).where("failure is null").join(M.pools(spark, d).select("pool_id", "token0", "token1"), "pool_id")
    reserves = book.select("pool_id", "token0", "token1", F.col("x").alias("r0"), F.col("y").alias("r1"), F.col("max_x").alias("cap0"), F.col("max_y").alias("cap1"), "fee_pips")
    return ends, steps, reserves


@query()
def replay_stages(spark, d):
    """Every block's plan in single precision, stage by stage on reserves that its steps change."""
    ends, steps, reserves = _plan_inputs(spark, d)
    return X.replay(ends.withColumn("entry", F.lit(1000.0)), steps, reserves, exact=False)


@query()
def verify_plans(spark, d):
    """Every block's plan checked in whole units: decimals, bridges, entry, replay, profit."""
    ends, steps, reserves = _plan_inputs(spark, d)
    decimals = M.table(spark, d, "nation").where("n_nationkey % 12 <> 11").select(F.col("n_nationkey").cast("long").alias("token"), F.when(F.col("n_nationkey") % 8 < 7, 6).otherwise(8).alias("decimals"))
    return X.verify(ends.withColumn("entry", F.lit(0.001)), steps, reserves, decimals)


#: Sources of the derived market's contracts by part % 9: one without risks, one of each flag, one of two, and none.
SOURCES = ("contract Plain {}", "uint BuyTax;", "mapping isBlacklisted;", "bool tradingOpen;", "uint _rOwned;", "import Pausable;", "DELEGATECALL", "maxTx; rebase();")
_FOUND = ("", "transfer-tax", "blacklist", "trading-gate", "rebase-or-reflection", "pausable", "upgradeable", "trading-gate,rebase-or-reflection")
_EVIDENCE = f"""ev AS (SELECT CASE p_partkey WHEN 0 THEN '{vetting.NATIVE}' ELSE lpad(lower(to_hex(p_partkey)), 40, '0') END AS token, p_partkey AS p, p_size AS z, p_retailprice AS tvl,
  ({list(_FOUND)})[(p_partkey % 9 + 1)::INT] AS flags FROM part)"""


@query(f""", {_EVIDENCE}, ladder AS (SELECT token, CASE WHEN p = 0 THEN 'native' WHEN p % 31 = 0 THEN 'inspection_failed' WHEN p % 29 = 0 THEN 'managed_exception' WHEN p % 23 = 0 THEN 'no_code' WHEN p % 19 = 0 THEN 'no_decimals'
  WHEN p % 17 = 0 THEN 'decimals_disagree' WHEN p % 13 = 0 THEN 'proxy' WHEN p % 9 = 8 THEN 'unverified_source' WHEN z % 3 = 0 THEN 'not_trusted' WHEN tvl * 8 < 10000 AND p % 7 <> 0 THEN 'unpopular'
  WHEN flags <> '' THEN 'risk:' || flags ELSE 'plain' END AS reason, p FROM ev)
SELECT token, reason IN ('native', 'managed_exception', 'plain') AS approved, reason, CASE WHEN reason = 'native' THEN 18 WHEN reason = 'plain' OR (reason = 'managed_exception' AND p % 19 <> 0) THEN 6 END AS decimals FROM ladder""")
def contract_verdicts(spark, d):
    """Every part as a token contract, through the whole decision list."""
    p = F.col("p_partkey")
    parts = M.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", F.when(p == 0, vetting.NATIVE).otherwise(F.lpad(F.lower(F.hex(p)), 40, "0")).alias("token"))
    evidence = parts.select(
        "token", F.when(p % 17 == 0, 9).otherwise(F.when(p % 2 == 0, 6)).alias("decimals"), (F.col("p_size") % 3 != 0).alias("trusted"), (F.col("p_retailprice") * 8).alias("tvl"),
        F.when(p % 31 == 0, "timeout").alias("inspect_error"), F.when(p % 46 == 0, "0").when(p % 23 != 0, "6080").alias("code"), F.when(p % 19 != 0, 6).alias("chain_decimals"),
        F.when(p % 13 == 0, F.col("token")).alias("proxy_target"), F.get(F.array(*map(F.lit, SOURCES)), (p % 9).cast("int")).alias("source"),
    )
    return vetting.examine(evidence, parts.where(p % 29 == 0).select("token"), parts.where(p % 7 == 0).select("token"))
