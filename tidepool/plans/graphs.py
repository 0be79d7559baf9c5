"""Registered queries of block graphs above an anchor, over the derived header stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import graph as G
from tidepool.plans import catalog as C
from tidepool.plans.catalog import query
from tidepool.plans.lineage import cut
from tidepool.sources import market as M

#: Number of each chain's anchor, numbers left out below the tip of a seed, and the refresh policy of path lengths.
ANCHOR, TRIM, TARGET, STRIDE = 3, 2, 40, 16


def _numbered(spark, d):
    """Headers numbered by chain."""
    return cut(M.numbered_heads(spark, d))


def _graph(spark, d):
    """nodes, observed heads and anchors: every fourth chain lacks some blocks, every third got blocks from below its anchor."""
    rows = _numbered(spark, d)
    here = (F.col("number") > ANCHOR) | ((F.col("number") < ANCHOR) & (F.col("chain") % 3 == 0))
    authority = F.when(F.col("block") % 61 == 0, 1).when(F.col("block") % 53 == 0, 0).otherwise(2)
    nodes = rows.where(here & ~((F.col("chain") % 4 == 1) & (F.col("number") % 101 == 50))).select("chain", "block", "parent", "number", authority.alias("authority"), F.when(F.col("block") % 7 != 0, F.col("block") % 3 != 0).alias("touched"))
    anchors = cut(rows.where(F.col("number") == ANCHOR).select("chain", "block", "number"))
    seen = rows.where("block % 3 = chain % 3").select("chain", "block", F.col("block").alias("seq"))
    return nodes, cut(G.observed_heads(seen, nodes, anchors)), anchors, rows


_GRAPH = f"""gn AS (SELECT chain, block, parent, row_number() OVER (PARTITION BY chain ORDER BY block) AS number FROM heads),
nodes AS (SELECT chain, block, parent, number, CASE WHEN block % 61 = 0 THEN 1 WHEN block % 53 = 0 THEN 0 ELSE 2 END AS authority, CASE WHEN block % 7 <> 0 THEN block % 3 <> 0 END AS touched
  FROM gn WHERE (number > {ANCHOR} OR (number < {ANCHOR} AND chain % 3 = 0)) AND NOT (chain % 4 = 1 AND number % 101 = 50)),
anchors AS (SELECT chain, block, number FROM gn WHERE number = {ANCHOR}),
observed AS (SELECT a.chain, coalesce(max(s.block), any_value(a.block)) AS block FROM anchors a LEFT JOIN
  (SELECT chain, block FROM (SELECT chain, block FROM nodes UNION SELECT chain, block FROM anchors) WHERE block % 3 = chain % 3) s ON s.chain = a.chain GROUP BY a.chain),
tree AS (SELECT chain, block FROM anchors UNION ALL SELECT n.chain, n.block FROM tree t JOIN nodes n ON n.chain = t.chain AND n.parent = t.block),
walk AS (SELECT o.chain, n.block, n.parent, 0::BIGINT AS depth FROM observed o JOIN nodes n ON n.chain = o.chain AND n.block = o.block
  UNION ALL SELECT n.chain, n.block, n.parent, w.depth + 1 FROM walk w JOIN nodes n ON n.chain = w.chain AND n.block = w.parent),
whole AS (SELECT DISTINCT o.chain FROM observed o JOIN tree t ON t.chain = o.chain AND t.block = o.block),
path AS (SELECT w.chain, w.block, w.depth, n.number, n.authority, n.touched FROM walk w JOIN whole USING (chain) JOIN nodes n ON n.chain = w.chain AND n.block = w.block),
aim AS (SELECT p.chain, p.depth AS least FROM path p JOIN gn ON gn.chain = p.chain AND gn.block = p.block JOIN (SELECT chain, max(number) // 2 AS number FROM gn GROUP BY chain) h ON h.chain = gn.chain AND h.number = gn.number),
below AS (SELECT path.* FROM path JOIN aim USING (chain) WHERE depth >= least),
free AS (SELECT b.chain, arg_min(b.block, b.depth) AS block, min_by(b.number, b.depth) AS number FROM below b JOIN (SELECT chain, max(CASE WHEN authority < 2 AND coalesce(touched, true) THEN depth END) AS hole FROM below GROUP BY chain) h ON h.chain = b.chain
  WHERE hole IS NULL OR b.depth > hole GROUP BY b.chain),
final AS (SELECT a.chain, coalesce(f.block, a.block) AS block, coalesce(f.number, a.number) AS number, f.block IS NOT NULL AS moved FROM anchors a LEFT JOIN free f ON f.chain = a.chain),
heirs AS (SELECT chain, block FROM final WHERE moved UNION ALL SELECT n.chain, n.block FROM heirs h JOIN nodes n ON n.chain = h.chain AND n.parent = h.block),
kept AS (SELECT n.chain, n.block, n.parent, n.number FROM nodes n JOIN final f ON f.chain = n.chain WHERE NOT f.moved OR (n.block <> f.block AND EXISTS (SELECT 1 FROM heirs h WHERE h.chain = n.chain AND h.block = n.block)))"""


@query(f", {_GRAPH} SELECT n.chain, n.block, CASE WHEN t.block IS NULL THEN 'pending' ELSE 'connected' END AS class FROM nodes n LEFT JOIN tree t ON t.chain = n.chain AND t.block = n.block")
def block_classes(spark, d):
    nodes, _, anchors, _ = _graph(spark, d)
    done = G.connected(nodes, anchors).withColumn("class", F.lit("connected"))
    return nodes.select("chain", "block").join(done, G.KEY, "left").select("chain", "block", F.coalesce("class", F.lit("pending")).alias("class"))


@query(f", {_GRAPH} SELECT * FROM observed")
def observed_heads(spark, d):
    return _graph(spark, d)[1]


@query(f", {_GRAPH} SELECT chain, block, depth FROM walk")
def present_path(spark, d):
    nodes, observed, anchors, _ = _graph(spark, d)
    return G.present_path(nodes, observed, anchors)


@query(f", {_GRAPH} SELECT DISTINCT w.chain, w.block, w.depth, u.user_id AS pool_id FROM walk w JOIN nodes n ON n.chain = w.chain AND n.block = w.block JOIN events u ON u.event_id = w.block WHERE n.authority > 0")
def path_candidates(spark, d):
    """Pools (here users) that readable logs name on the present path."""
    nodes, observed, anchors, _ = _graph(spark, d)
    users = M.table(spark, d, "events").select((F.col("user_id") % 20).alias("chain"), F.col("event_id").alias("block"), F.col("user_id").alias("pool_id"))
    logs = users.join(nodes.select(*G.KEY, "authority"), G.KEY)
    return G.block_candidates(G.present_path(nodes, observed, anchors), logs)


def _finalized(spark, d):
    nodes, observed, anchors, rows = _graph(spark, d)
    half = rows.groupBy("chain").agg(F.floor(F.max("number") / 2).alias("number"))
    final = G.finalized(nodes, observed, anchors, rows.join(F.broadcast(half), ["chain", "number"]).select(*G.KEY))  # one row for each chain
    return nodes, observed, cut(final)


@query(f", {_GRAPH} SELECT * FROM final")
def finalized_anchors(spark, d):
    """Anchors moved towards the middle block of each chain, as far as complete blocks reach."""
    return _finalized(spark, d)[2]


@query(f", {_GRAPH} SELECT * FROM kept")
def rerooted_blocks(spark, d):
    nodes, _, final = _finalized(spark, d)
    return G.rerooted(nodes, final).select("chain", "block", "parent", "number")


@query(f", {_GRAPH} SELECT f.chain, coalesce(k.block, f.block) AS block FROM final f LEFT JOIN (SELECT o.chain, o.block FROM observed o JOIN kept USING (chain, block)) k ON k.chain = f.chain")
def surviving_heads(spark, d):
    nodes, observed, final = _finalized(spark, d)
    return G.surviving_heads(observed, G.rerooted(nodes, final), final)


@query(f", {_GRAPH} SELECT n.chain, n.block, n.number FROM nodes n LEFT JOIN tree t ON t.chain = n.chain AND t.block = n.block WHERE t.block IS NULL AND n.number <= {ANCHOR} + 1")
def orphan_suspects(spark, d):
    nodes, _, anchors, _ = _graph(spark, d)
    return G.orphan_suspects(nodes, anchors)


@query(f", {_GRAPH} SELECT chain, block + 1 AS block, number FROM anchors WHERE chain % 5 = 0")
def orphaned_anchors(spark, d):
    """Probes answer with the anchor, with another block (every fifth chain), or from another height."""
    anchors = _graph(spark, d)[2]
    other = anchors.where("chain % 5 in (0, 1)").select("chain", F.col("block") + 1, F.col("number") + F.col("chain") % 5)
    return G.orphaned(anchors, anchors.select("chain", "block", "number").union(other))


@query(f""", {_GRAPH}, win AS (SELECT chain, number, min(block) AS block FROM (SELECT g.chain, g.block, CASE WHEN g.block % 8 = 0 THEN g.number + 1 ELSE g.number END AS number FROM gn g WHERE g.block % 6 <> 0) WHERE number > {ANCHOR} GROUP BY chain, number),
ret AS (SELECT w.chain, w.number, w.block::VARCHAR AS block FROM win w JOIN (SELECT chain, max(number) AS tip FROM win GROUP BY chain) t ON t.chain = w.chain WHERE w.number <= tip - {TRIM}),
lnk AS (SELECT r.chain, r.number, r.block, coalesce(lag(r.number) OVER o, a.number) AS low, coalesce(lag(r.block) OVER o, a.block::VARCHAR) AS under FROM ret r JOIN anchors a ON a.chain = r.chain WINDOW o AS (PARTITION BY r.chain ORDER BY r.number))
SELECT chain, block, CASE WHEN number > low + 1 THEN sha256('filler|' || under || '|' || block) ELSE under END AS parent, number, false AS filler FROM lnk
UNION ALL SELECT chain, sha256('filler|' || under || '|' || block), under, number - 1, true FROM lnk WHERE number > low + 1""")
def seeded_graph(spark, d):
    """A window of logs in which every sixth block has none and every eighth claims the next number."""
    anchors, rows = _graph(spark, d)[2:]
    number = F.when(F.col("block") % 8 == 0, F.col("number") + 1).otherwise(F.col("number"))
    return G.seeded(rows.where("block % 6 <> 0").select("chain", "block", number.alias("number"), F.col("block").alias("seq")), anchors, TRIM)


@query(f""", {_GRAPH}, hole AS (SELECT chain, number FROM path WHERE authority < 2 AND coalesce(touched, true) AND number % 5 <> 2),
isl AS (SELECT chain, number, number - row_number() OVER (PARTITION BY chain ORDER BY number) AS g FROM hole) SELECT chain, min(number) AS first, max(number) AS last FROM isl GROUP BY chain, g""")
def unreadable_ranges(spark, d):
    """Ranges to fetch on the anchored path; every fifth number is being fetched already."""
    nodes, observed, anchors, rows = _graph(spark, d)
    path = G.anchored_path(nodes, observed, anchors).join(nodes.drop("parent"), G.KEY)
    return G.unreadable_ranges(path, rows.where("number % 5 = 2").select("chain", "number"), 2)


@query(f""", {_GRAPH}, len AS (SELECT chain, block AS seq, CASE WHEN block % 17 <> 0 THEN number - block % 29 END AS length FROM gn), lg AS (SELECT *, lag(length) OVER (PARTITION BY chain ORDER BY seq) AS b FROM len)
SELECT chain, seq, length, coalesce(length >= {TARGET} AND (b IS NULL OR b < {TARGET} OR (b - {TARGET}) // {STRIDE} < (length - {TARGET}) // {STRIDE}), false) AS refresh FROM lg""")
def finality_refreshes(spark, d):
    length = F.when(F.col("block") % 17 != 0, F.col("number") - F.col("block") % 29)
    return G.refreshes(_numbered(spark, d).select("chain", F.col("block").alias("seq"), length.alias("length")), TARGET, STRIDE)


@query(f", {_GRAPH}, fr AS (SELECT chain, block AS seq, number // 7 AS frontier FROM gn WHERE block % 11 <> 0) SELECT chain, seq, frontier FROM (SELECT *, lag(frontier) OVER (PARTITION BY chain ORDER BY seq) AS b FROM fr) WHERE frontier IS DISTINCT FROM b")
def frontier_changes(spark, d):
    """Frontiers (here of seven numbers each) that are sent on; every eleventh reading has none."""
    frontier = F.when(F.col("block") % 11 != 0, F.floor(F.col("number") / 7))
    return G.frontier_changes(_numbered(spark, d).select("chain", F.col("block").alias("seq"), frontier.alias("frontier")))


_NAMED = "named AS (SELECT w.chain, w.block, w.depth, u.user_id AS pool_id FROM walk w JOIN nodes n ON n.chain = w.chain AND n.block = w.block JOIN events u ON u.event_id = w.block WHERE n.authority > 0)"


@query(f", {_GRAPH}, {_NAMED} SELECT chain, pool_id, arg_min(block, depth) AS block FROM named WHERE pool_id % 7 <> 0 GROUP BY chain, pool_id")
def candidate_owners(spark, d):
    """Every seventh pool is known."""
    known = M.table(spark, d, "events").where("user_id % 7 = 0").select((F.col("user_id") % 20).alias("chain"), F.col("user_id").alias("pool_id")).distinct()
    return G.candidate_owners(path_candidates(spark, d), known)


@query(f""", {_GRAPH}, {_NAMED} SELECT DISTINCT chain, token FROM (SELECT chain, unnest([pool_id % 25, pool_id % 23]) AS token FROM named WHERE pool_id % 4 <> 1) WHERE (token + chain) % 3 <> 0""")
def candidate_tokens(spark, d):
    """Tokens of the candidates with metadata (three in four) that no registry holds (every third does, by chain)."""
    candidates = path_candidates(spark, d)
    pools = M.table(spark, d, "events").select((F.col("user_id") % 20).alias("chain"), F.col("user_id").alias("pool_id")).distinct()
    metadata = pools.where("pool_id % 4 <> 1").select("chain", "pool_id", (F.col("pool_id") % 25).alias("token0"), (F.col("pool_id") % 23).alias("token1"))
    tokens = pools.select("chain").distinct().select("chain", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("token"))
    return G.unknown_tokens(candidates, metadata, tokens.where("(token + chain) % 3 = 0"))


@query("""SELECT pool_id, count(*) + count_if(l_partkey % 5 = 0) AS n_logs, count(DISTINCT (l_orderkey, l_linenumber)) AS n_kept FROM logs GROUP BY pool_id""")
def log_redelivery(spark, d):
    """Logs of which every fifth part's come twice, each counted once by block and index."""
    logs = M.logs(spark, d).select("pool_id", "number", "l_orderkey", "l_linenumber", "l_partkey")
    sent = logs.union(logs.where("l_partkey % 5 = 0"))
    once = sent.groupBy("pool_id", "l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("pool_id").agg(F.sum("n").alias("n_logs"), F.count(F.lit(1)).alias("n_kept"))
