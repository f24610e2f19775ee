"""FM-index over a sequence of small integers: suffix array, wavelet-matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling.  Symbol 0 separates runs: every 0 counts as a symbol of
    its own, in order of position, so suffixes of different runs never tie and depth is the longest repeat."""
    n = len(seq)
    gaps = seq == 0
    rank = np.where(gaps, np.cumsum(gaps), seq.astype(np.int64) + int(gaps.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        key = rank[order]
        fresh = np.empty(n, bool)
        fresh[0] = False
        if step == 1:
            fresh[1:] = key[1:] != key[:-1]
        else:
            fresh[1:] = (key[1:] != key[:-1]) | (tail[order][1:] != tail[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        tail = np.zeros(n, np.int64)
        tail[:-step] = rank[step:] + 1
        order = np.argsort(rank * np.int64(n + 1) + tail)
        step *= 2


class WaveletMatrix:
    """rank(c, i): how often symbol c occurs before position i; access(i): the symbol there."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        cur = seq
        for level in range(levels - 1, -1, -1):
            bit = (cur >> level) & 1
            count = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(cur) - int(count[-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((c >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = ones[start], ones[i]
            start, i = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a = ones[i]
            bit = ones[i + 1] - a
            out = (out << 1) | bit
            i = np.where(bit.astype(bool), zeros + a, i - a)
        return out


class FMIndex:
    """Backward search over ``seq``, whose symbols are 1..sigma with 0 between runs (and at its end)."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        order = suffix_array(seq)
        before = seq[order - 1]  # what stands before each suffix; before the first one, the closing 0
        self.below = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma + 1))]).astype(np.int64)
        self.wave = WaveletMatrix(before.astype(np.int64), max(1, int(sigma).bit_length()))
        self.marked = (order % sample == 0) | (before == 0)  # walks never need to pass a separator
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.positions = order[self.marked]
        self.n = len(seq)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of patterns, one per line, all of one length and without 0."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            a = self.below[c] + self.wave.rank(c, lo[live])
            b = self.below[c] + self.wave.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
            if not len(live):
                break
        dead = np.ones(len(patterns), bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows: step back until a sampled one."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, at = np.arange(len(rows)), rows
        while len(todo):
            hit = self.marked[at]
            out[todo[hit]] = self.positions[self.mark_rank[at[hit]]] + steps[todo[hit]]
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                c = self.wave.access(at)
                at = self.below[c] + self.wave.rank(c, at)
                steps[todo] += 1
        return out
