"""Plans against hand-made cases: merging, bridges, stages, caps, failures."""

import numpy as np

from tidepool.operators import plans as X

STEPS = "plan_id long, stage long, token_in long, token_out long, kind string, pool_id long, weight double"
POOLS = "pool_id long, token0 long, token1 long, r0 string, r1 string, cap0 string, cap1 string, fee_pips long"


def book(spark, *rows):
    return spark.createDataFrame(list(rows) or [(10, 1, 2, "1000000", "2000000", "500000", "500000", 3000), (11, 2, 3, "9000000", "3000000", "100", "100", 500)], POOLS)


def test_build_merges_after_pruning_and_puts_bridges_first(spark):
    flows = [
        (1, 0, 1, 2, 10, 0.3, 1.0, 2.0), (1, 0, 1, 2, 10, 0.1, 1.0, 2.0), (1, 0, 1, 3, 12, 0.4, 4.0, 4.0), (1, 0, 1, 1, None, 0.2, 5.0, 5.0), (1, 0, 1, 4, None, 0.5, 0.0, 0.0),
        (1, 1, 2, 1, 10, 0.006, 1.0, 1.0), (1, 1, 2, 1, 10, 0.006, 1.0, 1.0),
    ]
    cells = spark.createDataFrame(flows, "plan_id long, stage long, token_in long, token_out long, pool_id long, weight double, amount_in double, amount_out double")
    bridges = spark.createDataFrame([(1, 3), (1, 3), (1, 1)], "token_in long, token_out long")
    got = {(r.stage, r.token_out, r.kind, r.pool_id): (round(r.weight, 9), r.amount_in) for r in X.build(cells, bridges).collect()}
    assert got == {(0, 2, "swap", 10): (0.4, 2.0), (0, 3, "bridge", None): (0.4, 4.0), (0, 1, "carry", None): (0.2, 5.0)}
    assert X.build(cells.limit(0), bridges).count() == 0


def test_exact_replay_in_stages(spark):
    steps = [
        (1, 0, 1, 2, "swap", 10, 0.5), (1, 0, 1, 1, "carry", None, 0.5), (1, 1, 2, 2, "carry", None, 1.0), (1, 1, 1, 2, "swap", 10, 1.0),  # one pool used twice: the second hop meets changed reserves
        (2, 0, 1, 3, "carry", None, 1.0),  # a carry to another token gives nothing
        (3, 0, 1, 4, "bridge", None, 0.25),
        (4, 0, 1, 2, "swap", 99, 0.0),  # looked up though nothing goes through it
        (5, 0, 1, 3, "swap", 11, 1.0),
        (6, 0, 1, 1, "carry", None, 1.0), (6, 2, 1, 1, "carry", None, 1.0),  # the stage between passes nothing on
        (9, 0, 2, 3, "swap", 11, 1.0),
    ]
    plans = [(1, 1, 2, "1000"), (2, 1, 3, "1000"), (3, 1, 4, "1000"), (4, 1, 2, "1000"), (5, 1, 3, "1000"), (6, 1, 1, "1000"), (7, 1, 1, "1000"), (8, 1, 2, "1000"), (9, 2, 3, "1000")]
    done = X.replay(spark.createDataFrame(plans, "plan_id long, source long, output long, entry string"), spark.createDataFrame(steps, STEPS), book(spark), exact=True)
    got = {r.plan_id: (r.amount_out, r.hit_limit, r.failure) for r in done.collect()}
    net = 500 * 997000 // 1000000
    one = 2000000 * net // (1000000 + net)
    two = (2000000 - one) * net // (1000500 + net)
    assert got == {
        1: (str(one + two), False, None), 2: ("0", False, None), 3: ("250", False, None), 4: (None, None, "pool_missing"), 5: (None, None, "token_missing"),
        6: ("0", False, None), 7: ("1000", False, None), 8: ("0", False, None), 9: (str(3000000 * 100 // 9000100), True, None),
    }


def test_single_replay_caps_after_the_fee_and_adds_before_it(spark):
    steps = [(1, 0, 1, 2, "swap", 10, 1.0), (1, 1, 2, 1, "swap", 10, 1.0)]
    pools = book(spark, (10, 1, 2, "1000", "2000", "50", "1000", 3000))
    plans = spark.createDataFrame([(1, 1, 1, 100.0)], "plan_id long, source long, output long, entry double")
    got = X.replay(plans, spark.createDataFrame(steps, STEPS), pools, exact=False).first()
    out = 2000 * 50 / 1050
    back = out * 0.997
    assert np.isclose(float(got.amount_out), 1100 * back / (2000 - out + back), rtol=1e-5) and got.failure is None


def test_verification_takes_the_first_failure(spark):
    steps = [(1, 0, 1, 1, "carry", None, 1.0), (2, 0, 1, 7, "bridge", None, 1.0), (3, 0, 1, 3, "bridge", None, 1.0), (4, 0, 1, 1, "carry", None, 1.0), (5, 0, 1, 2, "swap", 98, 1.0), (6, 0, 1, 2, "swap", 10, 1.0), (8, 0, 1, 4, "bridge", None, 1.0)]
    plans = [(1, 1, 7, 1.0), (2, 1, 1, 1.0), (3, 1, 1, 1.0), (4, 1, 1, -1.0), (5, 1, 2, 1.0), (6, 1, 2, 0.001), (7, 1, 1, 1.5), (8, 1, 4, 2.0)]
    decimals = spark.createDataFrame([(1, 6), (2, 6), (3, 8), (4, 6)], "token long, decimals int")
    rows = X.verify(spark.createDataFrame(plans, "plan_id long, source long, output long, entry double"), spark.createDataFrame(steps, STEPS), book(spark), decimals).collect()
    got = {r.plan_id: r.failure or round(r.profit, 6) for r in rows}
    out = 2000000 * 997 // 1000997
    assert got == {1: "asset_unknown", 2: "bridge_unknown", 3: "bridge_decimals", 4: "amount", 5: "pool_missing", 6: round(out / 1e6 - 0.001, 6), 7: 0.0, 8: 0.0}


def test_amounts_to_units_and_back():
    assert X.raw_units(1.5, 6) == 1500000 and X.raw_units(-1, 6) is None and X.raw_units(float("nan"), 6) is None and X.raw_units(float("inf"), 0) is None and X.raw_units(3e38, 1) is None
    assert X.from_units(1234567, 6) == float(np.float32(1.234567)) and X.from_units(10**60, 0) is None
