"""Vectorised helpers over Arrow text columns: bytes, words, word hashes and shingles.

Everything here works on one slice of an Arrow batch (about a megabyte of text, or one
longer document), so a task's memory does not depend on how many rows a partition holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=_U))


def separator_table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(separators, np.uint8)] = True
    return table


WHITE_SPACE = separator_table(bytes([0x20, *range(0x09, 0x0E)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if offsets else np.zeros(len(array) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(raw: np.ndarray, bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of at most ``most`` bytes (one longer document alone)."""
    n, first = len(bounds) - 1, 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def text_runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about SLICE_BYTES characters together, with the first one's index."""
    texts = column.to_pylist()
    first, size, run = 0, 0, []
    for k, text in enumerate(texts):
        run.append(text or "")
        size += len(run[-1])
        if size >= SLICE_BYTES // 2:
            yield first, run
            first, size, run = k + 1, 0, []
    if run:
        yield first, run


def words(raw: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of each word; a document's end ends a word."""
    inside = ~separators[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[edges] = inside[edges]
    before = edges[edges > 0] - 1
    ends[before] = inside[before]
    at = np.flatnonzero(starts)
    doc = np.searchsorted(bounds, at, side="right") - 1
    return at, np.flatnonzero(ends) + 1, doc


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words' bytes, the same in every task."""
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE_VALUES[raw] * up[: len(raw)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def shingle_hashes(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of ``width`` words as (hash, document), sorted by document and hash.

    A document of fewer words, but not none, has its whole sequence as its one shingle.
    """
    per_doc = np.bincount(doc, minlength=n_docs)
    parts = []
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        together = doc[:n] == doc[width - 1 :]
        h = np.full(n, width, _U)
        for j in range(width):
            h = mix64(h * _U(_BASE) + hashes[j : j + n])
        parts.append((h[together], doc[:n][together]))
    short = (per_doc > 0) & (per_doc < width)
    if short.any():
        first = np.cumsum(per_doc) - per_doc
        at = np.flatnonzero(short)
        h = per_doc[at].astype(_U)
        for j in range(width - 1):
            more = per_doc[at] > j
            h[more] = mix64(h[more] * _U(_BASE) + hashes[first[at[more]] + j])
        parts.append((h, at))
    if not parts:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h, d = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h)
    order = order[np.argsort(d[order], kind="stable")]
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def sums_by_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each document's bounds; 0 for an empty one."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]
