"""Keccak-256 as chains use it (the padding of the competition entry, not of SHA3), over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 136  # bytes taken in by each permutation


def _offsets() -> np.ndarray:
    """Rotation of each lane x + 5y: triangular numbers along the walk (x, y) -> (y, 2x + 3y)."""
    out, x, y = np.zeros(25, np.uint64), 1, 0
    for t in range(24):
        out[x + 5 * y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


def _round_constants() -> list[np.uint64]:
    """Bits 2^j - 1 of each constant come from a shift register over x^8 + x^6 + x^5 + x^4 + 1."""
    register, out = 1, []
    for _ in range(24):
        constant = 0
        for j in range(7):
            constant |= (register & 1) << (2**j - 1)
            register = register << 1 ^ (0x171 if register >> 7 else 0)
        out.append(np.uint64(constant))
    return out


_ROTATE, _CONSTANTS = _offsets(), _round_constants()
_LANES = np.arange(25)
#: Where lane (x, y) comes from when lanes change places.
_SOURCE = np.array([(x + 3 * y) % 5 + 5 * x for y in range(5) for x in range(5)])


def _rotated(lanes: np.ndarray, by) -> np.ndarray:
    by = np.asarray(by, np.uint64)
    return np.where(by == 0, lanes, lanes << by | lanes >> (np.uint64(64) - np.where(by == 0, np.uint64(1), by)))


def _permute(state: np.ndarray) -> np.ndarray:
    """The permutation of every row of 25 lanes."""
    for constant in _CONSTANTS:
        columns = np.bitwise_xor.reduce(state.reshape(-1, 5, 5), axis=1)
        mixed = np.roll(columns, 1, axis=1) ^ _rotated(np.roll(columns, -1, axis=1), 1)
        state = _rotated(state ^ np.tile(mixed, 5), _ROTATE)[:, _SOURCE]
        planes = state.reshape(-1, 5, 5)
        state = (planes ^ (~np.roll(planes, -1, axis=2) & np.roll(planes, -2, axis=2))).reshape(-1, 25)
        state[:, 0] ^= constant
    return state


def keccak256(values: Sequence[bytes]) -> list[bytes]:
    """Digests of all values; those of equal length in blocks go through each permutation together."""
    padded = []
    for value in values:
        room = RATE - len(value) % RATE
        padded.append(value + (b"\x81" if room == 1 else b"\x01" + bytes(room - 2) + b"\x80"))
    out: list[bytes] = [b""] * len(padded)
    for size in sorted({len(p) for p in padded}):
        rows = [i for i, p in enumerate(padded) if len(p) == size]
        blocks = np.frombuffer(b"".join(padded[i] for i in rows), "<u8").reshape(len(rows), -1, RATE // 8)
        state = np.zeros((len(rows), 25), np.uint64)
        for k in range(blocks.shape[1]):
            state[:, : RATE // 8] ^= blocks[:, k]
            state = _permute(state)
        digests = state[:, :4].astype("<u8").tobytes()
        for n, i in enumerate(rows):
            out[i] = digests[32 * n : 32 * n + 32]
    return out


def topic(signature: str) -> str:
    """Hex digits of an event signature's topic."""
    return keccak256([signature.encode()])[0].hex()


@F.pandas_udf(T.StringType())
def keccak_hex(digits: pd.Series) -> pd.Series:
    """Digest of the bytes that hex digits write, as hex digits; null for null."""
    known = digits.dropna()
    hashes = keccak256([bytes.fromhex(v) for v in known])
    return pd.Series([h.hex() for h in hashes], index=known.index, dtype=object).reindex(digits.index).astype(object).where(digits.notna(), None)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def bloom_bits(digits: pd.Series) -> pd.Series:
    """The three bits of 2048 that a value (hex digits) sets in a log bloom: 11 bits of each of the digest's first three pairs."""
    hashes = keccak256([bytes.fromhex(v) for v in digits])
    return pd.Series([[int.from_bytes(h[i : i + 2]) & 2047 for i in (0, 2, 4)] for h in hashes])


@F.pandas_udf(T.BinaryType())
def packed_bits(bits: pd.Series) -> pd.Series:
    """Numbers of bits, two bytes each."""
    return pd.Series([np.asarray(b, np.uint16).tobytes() for b in bits], dtype=object)


@F.pandas_udf(T.BooleanType())
def meets(bloom: pd.Series, patterns: pd.Series) -> pd.Series:
    """Whether a bloom (its set bits) holds all three bits of one of the patterns (their bits one after the other), both packed."""
    out = []
    for b, p in zip(bloom, patterns, strict=True):
        there = np.zeros(2048, bool)
        there[np.frombuffer(b, np.uint16)] = True
        out.append(bool(there[np.frombuffer(p, np.uint16)].reshape(-1, 3).all(1).any()))
    return pd.Series(out, dtype=bool)
