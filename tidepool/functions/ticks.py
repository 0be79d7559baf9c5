"""Tick arithmetic: floors, and exact square-root prices in Python integers."""

from __future__ import annotations

from decimal import Decimal, getcontext
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_TICK, MAX_TICK = -887272, 887272
#: Prices that a process keeps as text.
KNOWN = 1 << 16


def _factors() -> list[int]:
    """2^128 * 1.0001^(-2^i / 2), rounded, for each bit of a tick."""
    getcontext().prec = 120
    root = 1 / Decimal("1.0001").sqrt()
    out = []
    for _ in range(20):
        out.append(int((root * (1 << 128)).to_integral_value()))
        root *= root
    return out


_FACTORS = _factors()


def sqrt_price_x96(tick: int) -> int:
    """Square root of the price at a tick as a Q64.96 integer, rounded up."""
    if not MIN_TICK <= tick <= MAX_TICK:
        raise ValueError("tick out of range")
    ratio = 1 << 128
    for i, factor in enumerate(_FACTORS):
        if abs(tick) >> i & 1:
            ratio = ratio * factor >> 128
    if tick > 0:
        ratio = ((1 << 256) - 1) // ratio
    return (ratio >> 32) + (ratio % (1 << 32) > 0)


@lru_cache(KNOWN)
def _price_text(tick: int) -> str | None:
    return str(sqrt_price_x96(tick)) if MIN_TICK <= tick <= MAX_TICK else None


@F.pandas_udf(T.StringType())
def sqrt_price_text(tick: pd.Series) -> pd.Series:
    """Decimal text, since the value has up to 49 digits; null outside the tick range.

    Not over an iterator of batches: Spark starts a Python process for each call of that form, and one for all calls of this.
    """
    return tick.map(lambda t: None if pd.isna(t) else _price_text(int(t)))


def tick_floor(tick: Column, spacing: Column) -> Column:
    """Largest multiple of the spacing that isn't above the tick, for negative ticks too."""
    return tick - F.pmod(tick, spacing)


def tick_range(tick: Column, spacing: Column) -> Column:
    """low, high and failure of the range that holds a tick: multiples of the spacing, kept within the tick limits.

    ``out_of_bounds`` beyond the limits, ``bad_spacing`` for one that isn't positive; then there are no bounds.
    """
    failure = F.when(~tick.between(MIN_TICK, MAX_TICK), "out_of_bounds").when(spacing <= 0, "bad_spacing")
    low = F.greatest(tick - F.pmod(tick, F.when(spacing > 0, spacing)), F.lit(MIN_TICK))
    sound = failure.isNull() & tick.isNotNull() & spacing.isNotNull()
    return F.struct(F.when(sound, low).alias("low"), F.when(sound, F.least(low + spacing, F.lit(MAX_TICK))).alias("high"), failure.alias("failure"))
