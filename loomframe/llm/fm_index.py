"""FM-index over a sequence of integers: BWT, wavelet-tree ranks, sampled suffix positions; all steps over many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(t: np.ndarray) -> np.ndarray:
    """By prefix doubling; t ends with a unique smallest symbol."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + after
        sa = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[sa[1:]] = np.cumsum(key[sa[1:]] != key[sa[:-1]])
        if n == 1 or new[sa[-1]] == n - 1:
            return sa
        rank, k = new, k * 2


class Wavelet:
    """Wavelet tree, level by level: each level holds a bit of the symbols, which are then stably sorted by it."""

    def __init__(self, t: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        seq, home = t, np.arange(1 << self.bits)
        start = np.zeros(1 << self.bits, np.int64)
        for level in reversed(range(self.bits)):
            bit = (seq >> level) & 1
            ones = np.zeros(len(t) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            zeros = len(t) - int(ones[-1])
            start = np.where((home >> level) & 1, zeros + ones[start], start - ones[start])
            self.ones.append(ones), self.zeros.append(zeros)
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.start = start

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[j] before position i[j]."""
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            i = np.where((c >> level) & 1, zeros + ones[i], i - ones[i])
        return i - self.start[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at i[j], and its rank there."""
        c = np.zeros(len(i), np.int64)
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            bit = ones[i + 1] - ones[i]
            c |= bit << level
            i = np.where(bit, zeros + ones[i], i - ones[i])
        return c, i - self.start[c]


class FMIndex:
    """t: symbols 1 .. symbols - 1; a sentinel 0 is added at its end."""

    def __init__(self, t: np.ndarray, symbols: int, sample: int = 16):
        t = np.append(t, 0).astype(np.int64)
        sa = suffix_array(t)
        self.n, self.tree = len(t), Wavelet(t[sa - 1], symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=symbols))])
        self.marked = sa % sample == 0
        self.order = np.cumsum(self.marked) - 1
        self.kept = sa[self.marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of padded patterns (rows): suffix intervals [lo, hi)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for step in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > step) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[live, lengths[live] - 1 - step]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back through the text until a sampled position."""
        rows, at, steps = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            hit = self.marked[rows[live]]
            done = live[hit]
            at[done] = self.kept[self.order[rows[done]]] + steps[done]
            live = live[~hit]
            c, r = self.tree.access(rows[live])
            rows[live] = self.before[c] + r
            steps[live] += 1
        return at
