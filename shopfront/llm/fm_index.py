"""A full-text index over integer symbols: suffix order, wavelet-matrix ranks, backward search, sampled positions.

All steps work on whole arrays of patterns or rows, so that one numpy call serves every pattern.
"""
from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in sorted order, by prefix doubling. s ends with a symbol that is least and unique."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = fresh
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of any symbol before any position: one bit of the symbol per level, zeros moved ahead of ones."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.levels = []
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (s >> bit) & 1 == 1
            zeros_before = np.concatenate([[0], np.cumsum(~ones)]).astype(np.int64)
            self.levels.append((bit, zeros_before, int(zeros_before[-1])))
            s = np.concatenate([s[~ones], s[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        begin = np.zeros(len(at), np.int64)
        for bit, zeros_before, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            z_at, z_begin = zeros_before[at], zeros_before[begin]
            at = np.where(one, zeros + at - z_at, z_at)
            begin = np.where(one, zeros + begin - z_begin, z_begin)
        return at - begin


class FmIndex:
    """s: symbols below `symbols`, the last of them 0 and found nowhere else. Every `sample`-th text position is kept."""

    def __init__(self, s: np.ndarray, symbols: int, sample: int = 8):
        order = suffix_order(s)
        self.n = len(s)
        self.last = s[order - 1].astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))]).astype(np.int64)
        self.ranks = WaveletMatrix(self.last, symbols)
        self.marked = order % sample == 0
        self.marked_before = np.cumsum(self.marked) - self.marked
        self.kept = order[self.marked]

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.ranks.rank(symbol, row)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of patterns (padded behind its length) the half-open range of matching suffixes."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for back in range(1, patterns.shape[1] + 1 if len(patterns) else 1):
            live = live[(lengths[live] >= back) & (hi[live] > lo[live])]
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - back]
            lo[live], hi[live] = self.step(symbol, lo[live]), self.step(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: back to the next sampled position, counting the steps."""
        found, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            at = rows[open_]
            here = self.marked[at]
            found[open_[here]] = self.kept[self.marked_before[at[here]]] + steps
            open_, at = open_[~here], at[~here]
            rows[open_] = self.step(self.last[at], at)
            steps += 1
        return found
