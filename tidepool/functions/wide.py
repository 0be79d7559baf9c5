"""Reserves and swaps in exact integers, wider than any SQL type, as decimal text in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MILLION, BILLION = 1_000_000, 1_000_000_000


def reserves(liquidity: int, sqrt_price: int) -> tuple[int, int]:
    """Virtual reserves at a Q64.96 price, rounded down; a zero price has no first reserve."""
    return (liquidity << 96) // sqrt_price if sqrt_price else 0, liquidity * sqrt_price >> 96


def swap_exact(amount: int, r_in: int, r_out: int, fee_pips: int) -> int:
    """Constant-product output, rounded down after the fee; a fee of all or more leaves nothing."""
    net = amount * max(MILLION - fee_pips, 0) // MILLION
    return r_out * net // (r_in + net) if net else 0


def fixed_share(weight: float) -> int:
    """A weight as billionths: clamped to 0..1, halves rounded up, NaN as 0."""
    return 0 if math.isnan(weight) else math.floor(min(max(weight, 0.0), 1.0) * BILLION + 0.5)


def _once(udf):
    """Not called again in a filter on what it returned, which Spark would move before the columns (a Python process more in every task)."""
    return udf.asNondeterministic()


#: Built from types: a schema in text would need a session when executors import this.
RESERVES = T.StructType([T.StructField(name, T.StringType()) for name in ("x", "y", "max_x", "max_y", "failure")])


@_once
@F.pandas_udf(RESERVES)
def reserve_texts(liquidity: pd.Series, price: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
    """Reserves at the price, and how much of each can still enter before the price leaves low..high.

    A price outside its range is a failure that names the side, with no limits.  Nulls stay null.
    """
    out = []
    for row in zip(liquidity, price, low, high, strict=True):
        if any(v is None for v in row):
            out.append((None, None, None, None, "missing"))
            continue
        depth, p, a, b = map(int, row)
        x, y = reserves(depth, p)
        room_x, room_y = reserves(depth, a)[0] - x, reserves(depth, b)[1] - y
        failure = "below range" if room_x < 0 else "above range" if room_y < 0 else None
        out.append((str(x), str(y), *((None, None) if failure else (str(room_x), str(room_y))), failure))
    return pd.DataFrame(out, columns=RESERVES.names, dtype=object)


#: Largest number of single precision.
LARGEST_SINGLE = 3.4028234663852886e38
PROJECTED = T.StructType([T.StructField(name, T.StringType() if name in ("failure", "field") else T.DoubleType()) for name in ("r0", "r1", "max0", "max1", "failure", "field")])


def scaled_amount(raw: int, decimals: int) -> float | None:
    """A raw amount in tokens: whole and rest are made doubles apart, their sum is rounded to single precision; null beyond it."""
    whole, rest = divmod(raw, 10**decimals)
    value = float(whole) + float(rest) / float(10**decimals)
    return None if value > LARGEST_SINGLE else float(np.float32(value))


def project(liquidity: int, price: int, low: int | None, high: int | None, decimals: tuple[int, int]) -> tuple:
    """r0, r1, max0, max1, failure and the field that failed."""
    x, y = reserves(liquidity, price)
    rooms = (None if low is None else reserves(liquidity, low)[0] - x), (None if high is None else reserves(liquidity, high)[1] - y)
    out = []
    for name, raw, side in (("reserve0", x, 0), ("reserve1", y, 1), ("max_swap0", rooms[0], 0), ("max_swap1", rooms[1], 1)):
        if raw is None or raw < 0:
            return None, None, None, None, "bad_tick" if raw is None else "swap_limit", name
        out.append(scaled_amount(raw, decimals[side]))
        if out[-1] is None:
            return None, None, None, None, "overflow", name
    return *out, None, None


@_once
@F.pandas_udf(PROJECTED)
def projection(liquidity: pd.Series, price: pd.Series, low: pd.Series, high: pd.Series, decimals0: pd.Series, decimals1: pd.Series) -> pd.DataFrame:
    """``project`` of decimal texts; a null liquidity or price gives nulls."""
    number = lambda v: None if v is None else int(v)
    none = (None,) * len(PROJECTED.names)
    rows = zip(liquidity, price, low, high, decimals0, decimals1, strict=True)
    out = [none if r[0] is None or r[1] is None else project(*map(number, r[:4]), (int(r[4]), int(r[5]))) for r in rows]
    return pd.DataFrame(out, columns=PROJECTED.names).astype({c: "float64" for c in ("r0", "r1", "max0", "max1")})
