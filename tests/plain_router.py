"""The plain route optimiser on dense arrays, which the tests hold the one over tables against.

A market's directional pools (token_in to token_out) are cells of a table with a column for each
token that enters and rows, or slots, for each token that leaves: as many slots as the most
pools that lead to it from one token.  A cell without a pool returns nothing; cells whose row
and column have the same token pass their share on unchanged.  Each layer splits what it has of
a token over the column's cells by the softmax of its logits.  The first layer starts from the
source, the middle one swaps everything again, and the last has the rows of the output alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
#: Added to a denominator, the logit of a disabled cell, and those of the optimiser.
EPSILON, DISABLED = float(np.finfo(np.float32).eps), -1e9
RATE, BETA1, BETA2, TINY = 0.1, 0.9, 0.999, 1e-8


@dataclass
class Market:
    """Arrays (slots, columns) of a market's directional pools."""

    tokens: np.ndarray  # of the columns
    leaving: np.ndarray  # column number of each slot's token
    pool: np.ndarray  # -1 for none
    x: np.ndarray
    y: np.ndarray
    fee: np.ndarray
    cap: np.ndarray
    off: np.ndarray
    bridges: frozenset = frozenset()

    @classmethod
    def of(cls, token_in, token_out, pool_id, x, y, fee, cap, off, kind=np.float32, bridges=()) -> Market:
        """Cells of one pair of tokens take slots in the order of pool_id."""
        order = np.lexsort((pool_id, token_in, token_out))
        tokens, index = np.unique(np.concatenate([token_in, token_out]), return_inverse=True)
        a, b = index[: len(token_in)][order], index[len(token_in) :][order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.flatnonzero(new)
        slot = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
        slots = np.zeros(len(tokens), np.int64)
        np.maximum.at(slots, b, slot + 1)
        row = (np.cumsum(slots) - slots)[b] + slot
        shape = (int(slots.sum()), len(tokens))

        def placed(values, empty, kind):
            out = np.full(shape, empty, kind)
            out[row, a] = np.asarray(values)[order]
            return out

        return cls(tokens, np.repeat(np.arange(len(tokens)), slots), placed(pool_id, -1, np.int64), *(placed(v, 0, kind) for v in (x, y, fee, cap)), placed(off, False, bool), frozenset(bridges))

    def column(self, token: int) -> int:
        at = np.flatnonzero(self.tokens == token)
        return int(at[0]) if len(at) else -1


@dataclass
class Layer:
    """The cells of some slots and columns of a market."""

    market: Market
    rows: np.ndarray
    columns: np.ndarray

    def __post_init__(self):
        m, self.at = self.market, np.ix_(self.rows, self.columns)
        self.x, self.y, self.fee, self.cap, self.off = (v[self.at] for v in (m.x, m.y, m.fee, m.cap, m.off))
        pairs = {(m.column(a), m.column(b)) for a, b in m.bridges}
        self.bypass = np.array([[t == c or (c, t) in pairs for c in self.columns] for t in m.leaving[self.rows]], bool).reshape(self.x.shape)

    def forward(self, logits: np.ndarray, entering: np.ndarray) -> np.ndarray:
        """What leaves of each token, from what enters of each; keeps what ``backward`` needs."""
        masked = np.where(self.off, logits.dtype.type(DISABLED), logits)
        e = np.exp(masked - masked.max(axis=0))
        self.share, self.entering = e / e.sum(axis=0), entering[self.columns]
        self.amount = self.share * self.entering
        after_fee = self.amount * self.fee
        self.free, used = after_fee < self.cap, np.minimum(after_fee, self.cap)
        self.below = self.x + used + logits.dtype.type(EPSILON)
        self.leaves = np.where(self.bypass, self.amount, np.maximum(self.y * used / self.below, 0))
        return np.bincount(self.market.leaving[self.rows], weights=self.leaves.sum(axis=1), minlength=len(self.market.tokens)).astype(logits.dtype)

    def backward(self, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients by logits and by what entered, from that by what left."""
        slope = np.where(self.bypass, 1, self.free * self.fee * self.y * (self.x + self.share.dtype.type(EPSILON)) / self.below**2)
        by_amount = gain[self.market.leaving[self.rows]][:, None] * slope
        by_share = by_amount * self.entering
        logits = self.share * (by_share - (self.share * by_share).sum(axis=0))
        entered = np.zeros(len(self.market.tokens), gain.dtype)
        entered[self.columns] = (by_amount * self.share).sum(axis=0)
        return np.where(self.off, 0, logits), entered


class Router:
    """Three layers from a source to an output; raises ``ValueError`` if the market lacks either."""

    def __init__(self, market: Market, source: int, output: int):
        self.market, self.source, self.output = market, market.column(source), market.column(output)
        every, all_rows = np.arange(len(market.tokens)), np.arange(len(market.leaving))
        if self.source < 0:
            raise ValueError("no source column")
        if not (market.leaving == self.output).any():
            raise ValueError("no output row")
        self.layers = [Layer(market, all_rows, np.array([self.source])), Layer(market, all_rows, every), Layer(market, np.flatnonzero(market.leaving == self.output), every)]
        self.logits = [np.ones(layer.x.shape, market.x.dtype) for layer in self.layers]

    def evaluate(self, amount: float) -> float:
        v = np.zeros(len(self.market.tokens), self.market.x.dtype)
        v[self.source] = amount
        for layer, logits in zip(self.layers, self.logits, strict=True):
            v = layer.forward(logits, v)
        return float(v[self.output])

    def gradients(self) -> list[np.ndarray]:
        """Of the output by every layer's logits, after ``evaluate``."""
        gain, out = np.zeros(len(self.market.tokens), self.market.x.dtype), []
        gain[self.output] = 1
        for layer in reversed(self.layers):
            by_logits, gain = layer.backward(gain)
            out.insert(0, by_logits)
        return out

    def train(self, amount: float, iterations: int) -> None:
        """Adam on the loss, amount minus output."""
        first, second = ([np.zeros_like(w) for w in self.logits] for _ in range(2))
        for step in range(1, iterations + 1):
            self.evaluate(amount)
            for w, g, m, v in zip(self.logits, self.gradients(), first, second, strict=True):
                m += (1 - BETA1) * (-g - m)
                v += (1 - BETA2) * (g * g - v)
                w -= (RATE * (m / (1 - BETA1**step)) / (np.sqrt(v / (1 - BETA2**step)) + TINY)).astype(w.dtype)

    def flows(self, amount: float) -> dict[str, np.ndarray]:
        """Every cell's share and amounts, cells without a pool included."""
        self.evaluate(amount)
        parts = []
        for stage, layer in enumerate(self.layers):
            column, row = np.broadcast_to(layer.columns, layer.x.shape), np.broadcast_to(self.market.leaving[layer.rows][:, None], layer.x.shape)
            parts.append((np.full(layer.x.size, stage), self.market.tokens[column.ravel()], self.market.tokens[row.ravel()], self.market.pool[layer.at].ravel(), layer.amount.ravel(), layer.leaves.ravel(), layer.share.ravel()))
        names = ("stage", "token_in", "token_out", "pool_id", "amount_in", "amount_out", "weight")
        return dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True))
