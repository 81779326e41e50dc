"""An FM-index over a sequence of integer symbols, in numpy: suffix array, wavelet matrix, sampled positions.

Every search step works on the suffix ranges of all phrases at once, so the cost of a phrase set follows the number of
live phrases and not Python's speed.
"""

from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of s in order, by rank doubling; a suffix that ends sorts first."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = s[order[1:]] != s[order[:-1]]
    rank[order] = np.cumsum(new)
    step = 1
    while n and rank[order[-1]] < n:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] if step < n else 0
        # only suffixes that still share a rank are sorted again
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        own = order[at]
        order[at] = own[np.argsort(key[own], kind="stable")]
        ordered = key[order]
        new[1:] = ordered[1:] != ordered[:-1]
        rank[order] = np.cumsum(new)
        step *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit level after another."""

    def __init__(self, values: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []  # ones before each position, by level
        self.zeros: list[int] = []
        v = values
        for k in range(self.levels - 1, -1, -1):
            bit = (v >> k) & 1
            ones = np.zeros(len(v) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(v) - int(ones[-1]))
            v = np.concatenate([v[bit == 0], v[bit == 1]])

    def rank_pair(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """lo and hi mapped to the symbol's block of the lowest level; their difference counts the symbol in [lo, hi)."""
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return lo, hi

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at positions, and the positions mapped as by rank_pair()."""
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return symbol, at


class FMIndex:
    """Symbols are 1 .. n_symbols - 1 and 0, which separates and matches nothing; inside, all are one higher and a final 0 ends the sequence."""

    SAMPLE = 8

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        s = np.append(np.asarray(symbols, np.int64) + 1, 0)
        n_symbols += 1
        order = suffix_order(s)
        self.n = len(s)
        bwt = s[order - 1]
        self.bwt = WaveletMatrix(bwt, n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n_symbols))])
        # where a symbol's block of the wavelet matrix's lowest level starts
        every = np.arange(n_symbols)
        self.block, _ = self.bwt.rank_pair(every, np.zeros(n_symbols, np.int64), np.zeros(n_symbols, np.int64))
        kept = order % self.SAMPLE == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(kept)])
        self.samples = order[kept]

    def _step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.bwt.rank_pair(symbol, lo, hi)
        base = self.first[symbol] - self.block[symbol]
        return base + a, base + b

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of phrases, the rows of a matrix padded on the right; backward, symbol by symbol."""
        m = len(phrases)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for back in range(1, (int(lengths.max()) if m else 0) + 1):
            live = np.flatnonzero((lengths >= back) & (hi > lo))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back] + 1
            a, b = self._step(symbol, lo[live], hi[live])
            b[symbol == 1] = a[symbol == 1]
            lo[live], hi[live] = a, b
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes given by their rank: steps back to a sampled one."""
        out = np.zeros(len(rows), np.int64)
        at, open_, walked = rows.astype(np.int64), np.arange(len(rows)), 0
        while len(open_):
            hit = self.sampled_before[at + 1] > self.sampled_before[at]
            out[open_[hit]] = self.samples[self.sampled_before[at[hit]]] + walked
            open_, at, walked = open_[~hit], at[~hit], walked + 1
            if len(open_):
                symbol, mapped = self.bwt.access(at)
                at = self.first[symbol] - self.block[symbol] + mapped
        return out
