"""Operators of the market engine against DuckDB and against scalar versions."""

import glob
import math
import os
import random
from decimal import Decimal
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepool.functions import ticks, wide
from tidepool.functions.ticks import MAX_TICK, MIN_TICK, sqrt_price_x96
import plain_router as router
from tidepool.operators import blocks, checks, flows, fold, projection, registry, route_table, routing, vetting
from tidepool.plans import catalog, lookups
from tidepool.plans.lineage import cut

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    one = lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(one, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", ["pool_state_fold", "log_authority_merge", "canonical_chain", "frontier_streamed", "missing_ranges", "overlay_over_base", "registry_upsert", "plan_normalized", "reserves_reach_route", "examine_verdict", "contract_verdicts", "stream_log_batches", "log_pages", "header_admission", "snapshot_validation", "flow_entropy", "word_codecs", "plan_merge", "plan_build", "candidate_merge", "slice_lookup", "routing_2core", "routing_bridged", "route_layout", "reserve_projection", "projection_failures", "reserves_directional", "swap_quote_single", "route_coverage", "fold_resumed", "projection_all_or_nothing", "projection_skip_missing", "route_forward"])
def test_query_equals_sql(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(catalog.SQL[name]).df())


def test_fold_equals_a_scalar_fold(spark):
    rng, rows, expected = random.Random(5), [], {}
    for pool in range(60):
        state, poisoned = None, False
        for k in range(rng.randint(1, 12)):
            kind = rng.choice(["swap", "mint", "burn", "burn", "initialize"])
            tick, liquidity, amount, lower = rng.randint(-5, 5), rng.randint(0, 50), rng.randint(1, 20), rng.randint(-6, 0)
            upper = lower + rng.randint(1, 8)
            rows.append((pool, k, kind, tick, liquidity, amount, lower, upper))
            if kind in ("swap", "initialize"):
                state = (tick, liquidity if kind == "swap" else 0)
            elif state and lower <= state[0] < upper:
                state = (state[0], state[1] + (amount if kind == "mint" else -amount))
                poisoned |= state[1] < 0
        if state and not poisoned:
            expected[pool] = state
    logs = spark.createDataFrame(rows, "pool_id long, k long, kind string, tick long, liquidity long, amount long, tick_lower long, tick_upper long")
    got = {r["pool_id"]: (r["tick"], r["liquidity"]) for r in fold.fold_logs(logs, ["pool_id"], ["k"]).collect()}
    assert got == expected and 0 < len(expected) < 60


def test_two_core_keeps_cycles_and_open_paths(spark):
    frame = lambda rows: spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "pool_id long, token0 long, token1 long")
    ids = lambda df: sorted(r["pool_id"] for r in df.collect())
    assert ids(routing.two_core(frame([(1, 2), (2, 3), (3, 9), (2, 2)]), 1, 3)) == [0, 1]
    assert ids(routing.two_core(frame([(1, 2), (1, 2), (2, 7)]), 1, 1)) == [0, 1]
    assert ids(routing.two_core(frame([(1, 2), (4, 5)]), 1, 9)) == [0, 1]


def test_two_core_keeps_the_sources_part_alone(spark):
    rows = [(0, 1, 2), (1, 2, 3), (2, 7, 8), (3, 7, 8), (4, 1, 5), (4, 5, 1)]
    edges = spark.createDataFrame(rows, "pool_id long, token0 long, token1 long")
    assert sorted(r["pool_id"] for r in routing.two_core(edges, 1, 3).collect()) == [0, 1]


def test_two_core_counts_bridges(spark):
    frame = lambda rows: spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "pool_id long, token0 long, token1 long")
    bridges = lambda *rows: spark.createDataFrame(rows, "token_in long, token_out long")
    ids = lambda df: sorted(r["pool_id"] for r in df.collect())
    rows = [(1, 2), (1, 2), (2, 9), (5, 6), (5, 6), (6, 7)]
    assert ids(routing.two_core(frame(rows), 1, 1)) == [0, 1]
    assert ids(routing.two_core(frame(rows), 1, 1, bridges((2, 5), (5, 2), (6, 6)))) == [0, 1, 3, 4]
    assert ids(routing.two_core(frame(rows), 1, 1, bridges((2, 8)))) == [0, 1]  # hangs off a leaf
    assert ids(routing.two_core(frame([(1, 2), (2, 3)]), 1, 1, bridges((3, 1)))) == [0, 1]  # closes a cycle
    assert ids(routing.two_core(frame([(1, 2), (1, 2), (4, 5)]), 1, 9)) == [0, 1]  # the output has no edge, the source has a cycle
    assert ids(routing.two_core(frame([]), 1, 2)) == []


def test_long_dangling_paths_go_in_few_rounds(spark, monkeypatch):
    written, rounds, whole = [], [], routing._dangling
    monkeypatch.setattr(routing, "cut", lambda df: written.append(0) or cut(df))
    monkeypatch.setattr(routing, "_dangling", lambda left: rounds.append(0) or whole(left))
    path = [(k, k, k + 1) for k in range(3000)] + [(5000, 0, 1), (5001, 1500, 9000), (5002, 9000, 9001)]
    got = routing.two_core(spark.createDataFrame(path, "pool_id long, token0 long, token1 long"), 0, 0)
    assert sorted(r["pool_id"] for r in got.collect()) == [0, 5000] and len(rounds) == 3 and len(written) < 100


def test_wide_liquidity_is_kept_and_overflow_is_underivable(spark):
    rows = [(1, 0, "swap", 1, 2**64), (2, 0, "swap", 1, 10**38 - 1), (2, 1, "mint", 1, 10**37), (3, 0, "swap", 1, 5)]
    logs = spark.createDataFrame([(p, k, kind, t, v, v, -9, 9) for p, k, kind, t, v in ((*r[:4], Decimal(r[4])) for r in rows)], "pool_id long, k long, kind string, tick long, liquidity decimal(38,0), amount decimal(38,0), tick_lower long, tick_upper long")
    assert {r["pool_id"]: int(r["liquidity"]) for r in fold.fold_logs(logs, ["pool_id"], ["k"]).collect()} == {1: 2**64, 3: 5}


def test_canonical_path_ends_on_cycles(spark):
    rows = [(1, 3, 2), (1, 2, 1), (1, 1, None), (2, 3, 2), (2, 2, 1), (2, 1, 3), (3, 5, 5), (3, 4, 5), (4, 9, 7), (4, 7, 6), (4, 6, 7)]
    got = sorted((r["chain"], r["block"], r["distance"]) for r in blocks.canonical(spark.createDataFrame(rows, "chain long, block long, parent long")).collect())
    assert got == [(1, 1, 2), (1, 2, 1), (1, 3, 0), (3, 5, 0)]


def test_shares_are_of_weights(spark):
    steps = spark.createDataFrame([(0, 1, 100, 0.5), (0, 1, 900, 1.5), (0, 2, 5, 0.0)], "stage long, token0 long, amount_in long, weight double")
    assert sorted(r["share"] for r in flows.normalized(steps, ["stage", "token0"]).collect()) == [0.0, 0.25, 0.75]


def test_tick_limits_are_the_published_ones():
    assert sqrt_price_x96(MIN_TICK) == 4295128739
    assert sqrt_price_x96(MAX_TICK) == 1461446703485210103287273052203988822378723970342
    assert sqrt_price_x96(0) == 1 << 96
    with pytest.raises(ValueError):
        sqrt_price_x96(MAX_TICK + 1)


def test_registry_and_whitelist(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False), ("b", 2, True), ("c", 1, False)], "k string, seq long, ok boolean")
    assert {r["k"]: r["status"] for r in registry.registry_view(rows, "k", ["seq"]).collect()} == {"a": "verified", "b": "verified", "c": "rejected"}
    pools = spark.createDataFrame([(1, 2), (2, 3)], "token0 long, token1 long")
    assert registry.whitelist_gate(pools, None).count() == 2
    assert registry.whitelist_gate(pools, spark.createDataFrame([], "token long")).count() == 0


def test_empty_frontier_is_null(spark):
    rows = spark.createDataFrame([(1, 5, 0, True), (1, 6, 2, True)], "chain long, number long, authority long, touched boolean")
    assert blocks.frontier(rows, 1).first()["frontier"] is None


def test_exact_reserves_and_limits(spark):
    states = spark.createDataFrame([("50170120777514", 69583), ("4844714101140627498", 197490), ("7", 0)], "depth string, tick int")
    rows = states.join(spark.createDataFrame([(60,)], "spacing int")).withColumn("low", F.col("tick") - F.pmod("tick", "spacing"))
    price = lambda c: ticks.sqrt_price_text(c)
    rows = rows.select("depth", "tick", "low", price("tick").alias("p"), price("low").alias("a"), price(F.col("low") + 60).alias("b"))
    for r in rows.withColumn("r", wide.reserve_texts("depth", "p", "a", "b")).collect():
        depth, p, a, b = (int(r[c]) for c in ("depth", "p", "a", "b"))
        exact_x, exact_y = Fraction(depth << 96, p), Fraction(depth * p, 1 << 96)
        assert (int(r["r"]["x"]), int(r["r"]["y"])) == (math.floor(exact_x), math.floor(exact_y)) and r["r"]["failure"] is None
        assert int(r["r"]["max_x"]) == math.floor(Fraction(depth << 96, a)) - math.floor(exact_x) >= 0
        assert int(r["r"]["max_y"]) == math.floor(Fraction(depth * b, 1 << 96)) - math.floor(exact_y) >= 0
    odd = spark.createDataFrame([("5", str(1 << 96), str(1 << 97), str(1 << 98)), ("5", str(1 << 99), str(1 << 97), str(1 << 98)), (None, "1", "1", "1")], "d string, p string, a string, b string")
    assert [r["r"]["failure"] for r in odd.select(wide.reserve_texts("d", "p", "a", "b").alias("r")).collect()] == ["below range", "above range", "missing"]
    assert [wide.fixed_share(w) for w in (float("nan"), -1.0, 0.5, 7.0, 2.5e-9)] == [0, 0, 500_000_000, 1_000_000_000, 3]
    assert wide.swap_exact(1000, 10, 10, 1_000_000) == 0 and wide.reserves(5, 0) == (0, 0)


def test_projection_scales_once_and_names_what_fails(spark):
    q = 1 << 96
    states = [(1, 69583, 50170120777514, None), (2, 197490, 4844714101140627498, None), (3, 0, 7, q * 2), (4, 0, 7, q // 2), (5, 0, 2**128 - 1, 1461446703485210103287273052203988822378723970341), (6, 887270, 5, None), (7, 0, 7, None), (8, 0, 7, None), (9, 0, None, None)]
    rows = [(1, k, 10 + (k == 7), 20 + (k == 8), 3000, 60, tick, None if depth is None else str(depth), str(price or sqrt_price_x96(tick))) for k, tick, depth, price in states]
    df = spark.createDataFrame(rows, "chain long, pool_id long, token0 long, token1 long, fee_pips long, tick_spacing long, tick long, liquidity string, price string")
    decimals = spark.createDataFrame([(10, 8), (20, 6), (21, 37)], "token long, decimals int")
    got = {r["pool_id"]: r for r in projection.projected(df, decimals).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 9} and got[9]["r0"] is None
    for k in (1, 2):
        _, tick, depth, _ = states[k - 1]
        x, y = wide.reserves(depth, sqrt_price_x96(tick))
        low = tick - tick % 60
        rooms = wide.reserves(depth, sqrt_price_x96(low))[0] - x, wide.reserves(depth, sqrt_price_x96(low + 60))[1] - y
        want = [float(np.float32(v / 10**e)) for v, e in ((x, 8), (y, 6), (rooms[0], 8), (rooms[1], 6))]
        assert [got[k][c] for c in ("r0", "r1", "max0", "max1")] == pytest.approx(want, rel=2e-7) and got[k]["failure"] is None
        assert got[k]["fee"] == float(np.float32(1) - np.float32(3000) / np.float32(1e6))
    told = {k: (r["failure"], r["failed_token"], r["failed_field"]) for k, r in got.items() if r["failure"]}
    assert told == {3: ("swap_limit", 20, "max_swap1"), 4: ("swap_limit", 10, "max_swap0"), 5: ("overflow", 20, "reserve1"), 6: ("bad_tick", 20, "max_swap1")}
    assert wide.scaled_amount(3 * 10**38, 0) == float(np.float32(3e38)) and wide.scaled_amount(10**39, 0) is None and wide.scaled_amount(10**39 + 5, 36) == 1000.0


def test_softmax_weights_sum_to_one(spark):
    rows = lookups.C.QUERIES["softmax_weights"](spark, SF).toPandas()
    logits = (rows.pool_id.abs() % 7) / 10.0
    e = np.exp(logits)
    assert np.allclose(rows.weight, e / e.groupby(rows["column"]).transform("sum"))


def test_pages_and_validation_edges(spark):
    blocks_ = spark.createDataFrame([(0, 5), (0, 204), (9, 3)], "chain long, number long")
    assert sorted(map(tuple, checks.pages(blocks_, {0: 100}, 5000).collect())) == [(0, 5, 104), (0, 105, 204), (9, 3, 3)]
    asked = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 1.0), (4, 1.0), (5, 1.0), (6, 1.0), (7, None)], "chain long, amount double")
    rows = spark.createDataFrame([(1, 1, 1, 2), (3, 1, 1, 2), (3, 1, 1, 2), (4, 1, 1, 3), (5, 1, 3, 2), (6, 1, 1, 2)], "chain long, pool_id long, token0 long, token1 long")
    got = {r["chain"]: r["outcome"] for r in checks.validate(asked, rows, 1, 2).collect()}
    assert got == {1: "bad_amount", 2: "empty", 3: "duplicate", 4: "no_output", 5: "no_source", 6: "ok", 7: "bad_amount"}


def test_two_core_query_takes_all_pools(spark):
    from tidepool.plans import catalog
    from tidepool.sources import market

    d = "/root/testdata/sf0.01"
    pools = [(r["pool_id"], r["token0"], r["token1"]) for r in market.pools(spark, d).collect()]
    left = [p for p in pools if p[1] != p[2]]
    while True:
        ends = [t for p in left for t in p[1:]] + [1, 5]
        kept = [p for p in left if ends.count(p[1]) > 1 and ends.count(p[2]) > 1]
        if len(kept) == len(left):
            break
        left = kept
    ends = {t for p in left for t in p[1:]}
    part = {1, 5}
    while grown := {t for p in left if part & set(p[1:]) for t in p[1:]} - part:
        part |= grown
    left = [p for p in left if p[1] in part]
    expected = left if {1, 5} <= ends else pools
    got = catalog.QUERIES["routing_2core"](spark, d).collect()
    assert sorted(r["pool_id"] for r in got) == sorted(p[0] for p in expected) and any(r["pool_id"] % 4 for r in got)


def _market(price=1.0, off=(), kind=np.float32):
    """Four pools over three tokens, both ways, with a depth of a billion and a fee of 0.3 percent."""
    rows = [(1, 2, 1, 1e9, 1e9), (2, 3, 2, 1e9, 1e9), (3, 1, 3, 1e9, 1e9 * price), (1, 3, 4, 1e9, 1e9)]
    rows += [(b, a, p, y, x) for a, b, p, x, y in rows]
    a, b, p, x, y = map(np.array, zip(*rows))
    return router.Market.of(a, b, p, x, y, np.full(8, 0.997), np.full(8, 1e9), np.isin(p, off), kind)


def _scalar_route(r, amount):
    """The three layers cell by cell."""
    m, v = r.market, {r.source: amount}
    for layer, logits in zip(r.layers, r.logits):
        out = dict.fromkeys(range(len(m.tokens)), 0.0)
        for c, column in enumerate(layer.columns):
            e = [0.0 if layer.off[k, c] and not layer.bypass[k, c] else math.exp(logits[k, c]) for k in range(len(layer.rows))]
            for k, row in enumerate(layer.rows):
                a = v.get(int(column), 0.0) * e[k] / sum(e)
                u = min(a * layer.fee[k, c], layer.cap[k, c])
                out[int(m.leaving[row])] += a if m.leaving[row] == column else max(layer.y[k, c] * u / (layer.x[k, c] + u + 2.0**-23), 0)
        v = out
    return v[r.output]


def test_router_forward_gradients_and_training():
    assert router.Router(_market(), 1, 1).evaluate(1000.0) == pytest.approx(815.8071, rel=1e-4)
    rng = np.random.default_rng(2)
    for off in ((), (2,)):
        r = router.Router(_market(1.05, off, np.float64), 1, 3)
        r.logits = [rng.normal(size=w.shape) for w in r.logits]
        assert r.evaluate(1e8) == pytest.approx(_scalar_route(r, 1e8), rel=1e-12)
        for w, g in zip(r.logits, r.gradients()):
            for at in np.ndindex(w.shape):
                w[at] += 1e-5
                up = r.evaluate(1e8)
                w[at] -= 2e-5
                down = r.evaluate(1e8)
                w[at] += 1e-5
                assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=2.0)
            r.evaluate(1e8)
    flat, gain = (router.Router(_market(price), 1, 1) for price in (1.0, 1.05))
    for r in (flat, gain):
        r.train(1000.0, 150)
    assert flat.evaluate(1000.0) <= 1000 < gain.evaluate(1000.0)
    rows = pd.DataFrame(gain.flows(1000.0))
    assert np.allclose(rows.groupby(["stage", "token_in"]).weight.sum(), 1, atol=1e-5)
    assert rows[rows.stage == 0].amount_in.sum() == pytest.approx(1000, rel=1e-5)
    with pytest.raises(ValueError, match="source"):
        router.Router(_market(), 9, 1)
    with pytest.raises(ValueError, match="output"):
        router.Router(_market(), 1, 9)


def test_routes_of_sessions(spark):
    cells = [(7, a, b, p, x, y, 0.997, 1e9, None) for a, b, p, x, y in ((1, 2, 1, 1e9, 1e9), (2, 1, 1, 1e9, 1e9))]
    cells = spark.createDataFrame(cells, "market long, token_in long, token_out long, pool_id long, r_in double, r_out double, fee double, cap double, disabled boolean")
    sessions = spark.createDataFrame([(1, 7, 1, 2, 1000.0, 5), (2, 7, 9, 2, 1000.0, 5), (3, 8, 1, 2, 1000.0, 5)], "session_id long, market long, source long, output long, amount double, iterations int")
    got = {r["session_id"]: r for r in route_table.evaluate(sessions, cells, 5).collect()}
    assert got[2]["failure"] == "no source column" and got[1]["failure"] is None and got[1]["start"] < got[1]["trained"] < 1000 and 3 not in got
    rows = route_table.RouteModel(sessions, cells).flows().toPandas()
    assert set(rows.session_id) == {1} and (rows.pool_id.isna() == (rows.token_in == rows.token_out)).all()
    assert route_table.evaluate(sessions.limit(0), cells, 1).count() == 0


def test_contracts_without_evidence_and_without_rows(spark):
    schema = "token string, decimals int, trusted boolean, tvl double, inspect_error string, code string, chain_decimals int, proxy_target string, source string"
    rows = [("aa", None, None, None, None, None, None, None, None), ("bb", None, True, float("nan"), None, "60", 6, None, ""), ("cc", 7, True, None, None, "60", 6, None, ""), ("bb", None, True, None, None, "60", 6, None, "Paused TAKEFEE")]
    none = spark.createDataFrame([], "token string")
    listed = spark.createDataFrame([("bb",), ("bb",)], "token string")
    got = sorted((r.token, r.reason, r.decimals) for r in vetting.examine(spark.createDataFrame(rows, schema), none, listed).collect())
    assert got == [("aa", "no_code", None), ("bb", "plain", 6), ("bb", "risk:transfer-tax,pausable", None), ("cc", "decimals_disagree", None)]
    assert vetting.examine(spark.createDataFrame([], schema), none, none).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _reads_logs(df):
    return any("lineitem" in f for f in df.inputFiles())


def test_a_models_cells_are_derived_once(spark):
    """Layouts, values and sessions read cells again and again; each reading would fold all logs anew."""
    sessions, cells = lookups._sessions(spark, SF)
    assert not _reads_logs(cells) and not _reads_logs(sessions) and cells.count() > 0


def test_reserves_take_two_python_processes(spark):
    """One for prices, one for the projection; a filter on failures and the other direction don't call them again."""
    assert _plan(catalog.reserves_directional(spark, SF).where("token_in <> token_out")).count("ArrowEvalPython") == 2
    assert _plan(lookups.virtual_reserves(spark, SF).where("failure is null")).count("ArrowEvalPython") == 2


def test_logs_are_folded_before_they_meet_their_pools(spark):
    """With tables too large for broadcasts: logs and starts by bucket, states and pools by pool, and the states once more."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = _plan(catalog._placed(spark, SF)).count("Exchange hashpartitioning")
        assert _plan(catalog.pool_state_fold(spark, SF)).count("Exchange hashpartitioning") <= joined + 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_steps_of_plans_are_built_once(spark):
    ends, steps, _ = lookups._plan_inputs(spark, SF)
    assert not _reads_logs(steps) and not _reads_logs(ends)
