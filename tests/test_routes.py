"""Route models over tables against the plain optimiser on dense arrays."""

import numpy as np
import plain_router
import pytest

from tidepool.operators import route_table
from tidepool.operators.route_table import COLD, RouteModel

CELLS = "market long, token_in long, token_out long, pool_id long, r_in double, r_out double, fee double, cap double, disabled boolean"
SESSIONS = "session_id long, market long, source long, output long, amount double"
GOLDEN = [(1, 2, 1, 1e9, 1e9), (2, 3, 2, 1e9, 1e9), (3, 1, 3, 1e9, 1e9), (1, 3, 4, 1e9, 1e9)]


def both_ways(pools, market=7, fee=0.997, cap=1e9, off=()):
    rows = pools + [(b, a, p, y, x) for a, b, p, x, y in pools]
    return [(market, a, b, p, float(x), float(y), fee, float(cap), True if p in off else None) for a, b, p, x, y in rows]


def random_pools(seed, tokens, n):
    rng = np.random.default_rng(seed)
    ends = [rng.choice(tokens, 2, replace=False) for _ in range(n)]
    return [(int(a), int(b), 100 * seed + k, float(x), float(y)) for k, ((a, b), x, y) in enumerate(zip(ends, rng.uniform(1e3, 1e4, n), rng.uniform(1e3, 1e4, n), strict=True))]


def plain(rows, source, output, bridges=()):
    cols = [np.array([r[k] for r in rows]) for k in (1, 2, 3, 4, 5, 6, 7)]
    return plain_router.Router(plain_router.Market.of(*cols, np.array([bool(r[8]) for r in rows]), np.float64, bridges), source, output)


def table(spark, rows):
    return spark.createDataFrame(rows, CELLS)


def outputs(df, name="output"):
    return {r["session_id"]: r[name] for r in df.collect()}


def test_golden_value(spark):
    sessions = spark.createDataFrame([(1, 7, 1, 1, 1000.0)], SESSIONS)
    assert outputs(RouteModel(sessions, table(spark, both_ways(GOLDEN))).evaluate())[1] == pytest.approx(815.8071, rel=1e-6)


def test_tables_equal_dense_arrays(spark):
    """Several markets and sessions, parallel pools, disabled ones, bridges with and without pools; forward, training and flows."""
    bridges = [(7, 2, 5), (7, 5, 2), (7, 1, 4), (8, 3, 1)]
    seven, eight = both_ways(random_pools(1, range(1, 7), 14), 7, cap=800, off=(103, 107)), both_ways(random_pools(2, range(1, 5), 6), 8, fee=0.99)
    wanted = [(1, 7, 1, 1, 500.0), (2, 7, 1, 5, 50.0), (3, 7, 3, 2, 5000.0), (4, 8, 2, 2, 700.0), (5, 8, 1, 3, 10.0)]
    model = RouteModel(spark.createDataFrame(wanted, SESSIONS), table(spark, seven + eight), spark.createDataFrame(bridges, "market long, token_in long, token_out long"))
    routers = {s: plain(seven if m == 7 else eight, a, b, [x[1:] for x in bridges if x[0] == m]) for s, m, a, b, _ in wanted}
    got = outputs(model.evaluate())
    for s, *_, amount in wanted:
        assert got[s] == pytest.approx(routers[s].evaluate(amount), rel=1e-9)
    got = outputs(model.train(6).evaluate())
    for s, *_, amount in wanted:
        routers[s].train(amount, 6)
        assert got[s] == pytest.approx(routers[s].evaluate(amount), rel=1e-9)
    flows = model.flows().toPandas()
    assert np.allclose(flows.groupby(["session_id", "stage", "token_in"]).weight.sum(), 1, atol=1e-9)
    for s, *_, amount in wanted:
        want = routers[s].flows(amount)
        mine = {(r.stage, r.token_in, r.token_out, r.pool_id): (r.amount_in, r.amount_out, r.weight) for r in flows[(flows.session_id == s) & flows.pool_id.notna()].itertuples()}
        cells = zip(*(want[c] for c in ("stage", "token_in", "token_out", "pool_id", "amount_in", "amount_out", "weight")), strict=True)
        theirs = {c[:4]: c[4:] for c in cells if c[3] >= 0}
        assert mine.keys() == theirs.keys() and all(np.allclose(mine[k], theirs[k], rtol=1e-9, atol=1e-12) for k in theirs)


def dense_logits(model, session, router):
    """Logits of a plain router's cells, from the parameter rows that stand for them."""
    layout = model.layout.toPandas()
    row_age = layout.groupby(["token_out", "slot"]).epoch.min().to_dict()
    column_age = {t: min(layout[(layout.token_in == t) | (layout.token_out == t)].epoch) for t in set(layout.token_in) | set(layout.token_out)}
    known = {tuple(r[c] for c in route_table.CELL[1:]): r["logit"] for r in model.parameters.where(f"session_id = {session}").collect()}
    taken = {(r.token_in, r.token_out, r.slot) for r in layout.itertuples()}
    tokens, leaving = router.market.tokens, router.market.leaving
    slot = [list(leaving[:k]).count(leaving[k]) for k in range(len(leaving))]
    out = []
    for stage, layer in enumerate(router.layers):
        logits = np.zeros(layer.x.shape)
        for i, row in enumerate(layer.rows):
            for j, column in enumerate(layer.columns):
                a, b, s = int(tokens[column]), int(tokens[leaving[row]]), slot[row]
                born = max(row_age[b, s], column_age[a])
                logits[i, j] = known[(stage, "pool", a, b, s, born) if (a, b, s) in taken else (stage, "pass", a, b, -1, born) if layer.bypass[i, j] else (stage, "void", a, -1, -1, born)]
        out.append(logits)
    return out


def test_growth_keeps_what_was_learnt(spark):
    first = both_ways(random_pools(3, range(1, 5), 7))
    later = first + both_ways(random_pools(4, range(1, 5), 4)) + both_ways(random_pools(5, range(3, 8), 5))
    sessions = spark.createDataFrame([(1, 7, 1, 1, 300.0), (2, 7, 2, 4, 900.0)], SESSIONS)
    model = RouteModel(sessions, table(spark, first)).train(5)
    slots = {(r["token_in"], r["token_out"], r["pool_id"]): r["slot"] for r in model.layout.collect()}
    known = {tuple(r[c] for c in route_table.CELL): r["logit"] for r in model.parameters.where("kind = 'pool'").collect()}
    before = outputs(model.evaluate())
    assert model.reconcile(table(spark, later)) and model.step == 0
    after = outputs(model.evaluate())
    now = {tuple(r[c] for c in route_table.CELL): r["logit"] for r in model.parameters.collect()}
    moved = {(r["token_in"], r["token_out"], r["pool_id"]): r["slot"] for r in model.layout.collect()}
    assert all(moved[k] == v for k, v in slots.items()) and len(moved) == len(later)
    assert all(now[k] == v for k, v in known.items()) and COLD in now.values()
    assert all(v == COLD for k, v in now.items() if k[-1] == 1)  # cells of new rows and columns
    assert len({(a, b, slot) for (a, b, _), slot in moved.items()}) == len(moved)  # no slot twice
    want = {}
    for s, source, output, amount in ((1, 1, 1, 300.0), (2, 2, 4, 900.0)):
        router = plain(later, source, output)
        # The plain market sorts its slots by pool id, which is the layout's order here too, since later ids are larger.
        router.logits = dense_logits(model, s, router)
        assert after[s] == pytest.approx(router.evaluate(amount), rel=1e-9)
        router.train(amount, 4)
        want[s] = router.evaluate(amount)
    assert outputs(model.train(4).evaluate()) == pytest.approx(want, rel=1e-9)
    cold = [r["logit"] for r in model.parameters.where("kind = 'pool' and born = 1 and stage < 2").collect()]
    assert max(abs(x - COLD) for x in cold) > 0.1  # appended cells can be trained
    assert before.keys() == after.keys()


def test_new_parallel_pools_leave_routing_as_it_was(spark):
    pools = [(1, 2, 1, 2e4, 1e4), (2, 1, 2, 1e4, 2e4)]
    sessions = spark.createDataFrame([(1, 7, 1, 1, 100.0)], SESSIONS)
    model = RouteModel(sessions, table(spark, both_ways(pools)))
    baseline = outputs(model.evaluate())[1]
    assert model.reconcile(table(spark, both_ways(pools + [(1, 2, 3, 3000.0, 2400.0)])))
    assert outputs(model.evaluate())[1] == pytest.approx(baseline, rel=1e-2)


def test_absent_pools_are_masked_and_come_back(spark):
    rows = both_ways(GOLDEN)
    sessions = spark.createDataFrame([(1, 7, 1, 1, 1000.0)], SESSIONS)
    model = RouteModel(sessions, table(spark, rows)).train(3)
    baseline, slots = outputs(model.evaluate())[1], model.slots().first()["n_slots"]
    assert not model.reconcile(table(spark, [r for r in rows if r[3] != 4])) and model.step == 3
    assert abs(outputs(model.evaluate())[1] - baseline) > 1e-3 and model.slots().first()["n_slots"] == slots
    assert not model.reconcile(table(spark, [(*r[:8], r[3] == 4) for r in rows]))
    disabled = outputs(model.evaluate())[1]
    assert not model.reconcile(table(spark, rows)) and outputs(model.evaluate())[1] == pytest.approx(baseline, rel=1e-12) and disabled != baseline
    with pytest.raises(ValueError, match="steps"):
        model.train(route_table.MOST_STEPS)
