"""The fold in buckets against a plain one, for any width and any split into base and suffix."""

from decimal import Decimal

import numpy as np
import pytest

from tidepool.operators.fold import fold_logs

LOGS = "pool_id long, number long, k long, kind string, tick long, liquidity {0}, amount {0}, tick_lower long, tick_upper long"


def plain(logs, base=None):
    """pool: (tick, liquidity, n_logs) of every derivable pool."""
    state, broken = {p: [t, v, 0] for p, (t, v) in (base or {}).items()}, set()
    for p, _, _, kind, tick, liquidity, amount, low, high in sorted(logs, key=lambda r: r[:3]):
        if kind in ("swap", "initialize"):
            state[p] = [tick, liquidity if kind == "swap" else 0, state.get(p, [0, 0, 0])[2]]
        elif p not in state:
            continue
        elif low <= state[p][0] < high:
            state[p][1] += amount if kind == "mint" else -amount
        state[p][2] += 1
        if not 0 <= state[p][1] < 10**38:
            broken.add(p)
    return {p: tuple(s) for p, s in state.items() if p not in broken}


def random_logs(seed, pools, n, scale):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        p = 0 if k % 2 else int(rng.integers(1, pools))  # half of all logs are of one pool
        kind = rng.choice(["swap", "initialize", "mint", "burn"], p=[0.06, 0.02, 0.55, 0.37])
        low = int(rng.integers(-5, 4))
        out.append((p, k // 3, k, str(kind), int(rng.integers(-5, 5)), int(rng.integers(5, 40)) * scale, int(rng.integers(0, 6)) * scale, low, low + int(rng.integers(1, 6))))
    return out


def frame(spark, logs, kind):
    cast = (lambda x: x) if kind == "long" else Decimal
    return spark.createDataFrame([(*r[:5], cast(r[5]), cast(r[6]), *r[7:]) for r in logs], LOGS.format(kind))


def folded(df):
    return {r["pool_id"]: (r["tick"], int(r["liquidity"]), r["n_logs"]) for r in df.collect()}


@pytest.mark.parametrize(("kind", "scale"), [("long", 1), ("long", 10**17), ("decimal(38,0)", 10**30)])
def test_any_width_equals_the_plain_fold(spark, kind, scale):
    logs = random_logs(1, 30, 900, scale)
    want = plain(logs)
    assert 3 < len(want) < 30
    for width in (1, 7, 100, 4096):
        assert folded(fold_logs(frame(spark, logs, kind), ["pool_id"], ["number", "k"], width=width)) == want


@pytest.mark.parametrize("split", [0, 10, 150, 299, 400])
def test_a_suffix_goes_on_from_its_base(spark, split):
    logs = random_logs(2, 12, 900, 1)
    first, rest = [r for r in logs if r[1] < split], [r for r in logs if r[1] >= split]
    base = {p: s[:2] for p, s in plain(first).items()}
    seeds = spark.createDataFrame([(p, t, Decimal(v)) for p, (t, v) in base.items()], "pool_id long, tick long, liquidity decimal(38,0)")
    got = folded(fold_logs(frame(spark, rest, "long"), ["pool_id"], ["number", "k"], seeds, width=20))
    assert got == plain(rest, base)


def test_deltas_alone_need_a_base(spark):
    deltas = [(1, 5, 0, "mint", 0, 0, 7, -9, 9), (1, 50, 1, "burn", 0, 0, 12, -9, 9), (1, 51, 2, "burn", 0, 0, 5, 3, 9), (2, 5, 3, "burn", 0, 0, 9, -9, 9)]
    seeds = spark.createDataFrame([(1, 0, Decimal(5)), (2, 0, Decimal(8)), (3, -2, Decimal(1))], "pool_id long, tick long, liquidity decimal(38,0)")
    df = frame(spark, deltas, "long")
    assert folded(fold_logs(df, ["pool_id"], ["number", "k"], width=4)) == {}
    assert folded(fold_logs(df, ["pool_id"], ["number", "k"], seeds, width=4)) == {1: (0, 0, 3), 3: (-2, 1, 0)}
    assert folded(fold_logs(df.limit(0), ["pool_id"], ["number", "k"])) == {}
