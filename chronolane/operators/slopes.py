"""Robust lines: the median of all pairwise slopes, selected without listing the pairs.

Points in order of time, sorted anew by y - slope * t, change places exactly with the points to which their
slope is smaller.  So the pairs below a trial slope are the inversions of a permutation, which are counted
bit by bit of the ranks in n log n, drawn at random, and listed once a bracket around the median holds few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Pairs that are listed, and pairs drawn to narrow a bracket.
LISTED, DRAWN = 200_000, 2_000
#: Slopes this near each other, relative to their size, are one.
NEAR = 1e-11


def _levels(ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each bit from the highest, with ranks grouped by their higher bits in the given order: the ranks, how many earlier ones of the group have the bit where the rank hasn't, where the group's ranks with the bit begin in the next order, and that order."""
    n, held = len(ranks), ranks
    index = np.arange(n)
    for b in reversed(range(max(1, (n - 1).bit_length()))):
        bit = held >> b & 1
        start = held >> (b + 1) << (b + 1)  # of a permutation, groups begin at their first rank
        ones = np.cumsum(bit) - bit
        ones -= ones[start]
        begin = start + np.minimum(1 << b, n - start)
        order = np.empty_like(held)
        order[np.where(bit == 1, begin + ones, index - ones)] = held
        yield held, np.where(bit == 0, ones, 0), begin, order
        held = order


class Slopes:
    """All pairwise slopes of points with different t; ``count`` of them."""

    def __init__(self, t: np.ndarray, y: np.ndarray):
        at = np.lexsort((y, t))
        self.t, self.y = t[at], y[at]
        _, same = np.unique(self.t, return_counts=True)
        n = len(t)
        self.count = n * (n - 1) // 2 - int((same.astype(np.int64) * (same - 1) // 2).sum())

    def order(self, slope: float) -> np.ndarray:
        """Points sorted as a trial slope sorts them; points that tie stay in order of time."""
        if slope == -np.inf:
            return np.arange(len(self.t))
        if slope == np.inf:
            return np.lexsort((self.y, -self.t))
        return np.argsort(self.y - slope * self.t, kind="stable")

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Ranks of the order ``high`` in the order ``low``; inversions are the pairs with a slope between."""
        rank = np.empty(len(high), np.int64)
        rank[high] = np.arange(len(high))
        return rank[low]

    @staticmethod
    def inversions(ranks: np.ndarray) -> int:
        return sum(int(many.sum()) for _, many, _, _ in _levels(ranks))

    def _slopes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.y[b] - self.y[a]) / (self.t[b] - self.t[a])

    def pick(self, low: np.ndarray, high: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
        """The slopes between two orders, sorted: all, or those at ``places`` (sorted) in the list of inversions."""
        found, passed = [], 0
        for held, many, begin, after in _levels(self.between(low, high)):
            ends = np.cumsum(many)
            total = int(ends[-1])
            own = np.arange(total) if places is None else places[(places >= passed) & (places < passed + total)] - passed
            row = np.searchsorted(ends, own, "right")
            other = after[begin[row] + own - (ends[row] - many[row])]
            found.append(self._slopes(high[other], high[held[row]]))
            passed += total
        return np.sort(np.concatenate(found))

    def select(self, k: int, seed: int = 0) -> float:
        """The k-th smallest slope, from 0."""
        rng = np.random.default_rng(seed)
        ends = [-np.inf, np.inf]
        orders = [self.order(e) for e in ends]
        below, inside = 0, self.count
        while inside > LISTED:
            drawn = self.pick(*orders, np.sort(rng.integers(0, inside, DRAWN)))
            middle, spread = (k - below) / inside * DRAWN, 3 * DRAWN**0.5
            if np.isfinite(ends).all() and ends[1] - ends[0] <= max(NEAR * max(map(abs, ends)), 1e-299):
                return float(drawn[min(DRAWN - 1, int(middle))])  # what is left differs by rounding alone
            value, before = float(drawn[min(DRAWN - 1, max(0, int(middle)))]), inside
            near = NEAR / 4 * abs(value) + 1e-300
            wide = [float(drawn[int(p)]) for p in (middle - spread, middle + spread) if 0 <= p < DRAWN]
            for trials in (wide, [value - near, value + near]):  # the second where many slopes tie
                for trial in trials:
                    if ends[0] < trial < ends[1]:
                        at = self.order(trial)
                        upto = self.inversions(self.between(orders[0], at))
                        if below + upto <= k:
                            ends[0], orders[0], below, inside = trial, at, below + upto, inside - upto
                        else:
                            ends[1], orders[1], inside = trial, at, upto
                if inside < 0.9 * before:
                    break
            else:
                return value  # the bracket holds nothing but slopes that differ by rounding
        return float(self.pick(*orders)[min(inside - 1, max(0, k - below))])

    def median(self) -> float:
        if self.count <= LISTED and len(self.t) <= 700:  # few enough to be listed at once
            a, b = np.triu_indices(len(self.t), 1)
            apart = self.t[b] > self.t[a]
            return float(np.median(self._slopes(a[apart], b[apart])))
        a = self.select((self.count - 1) // 2)
        return a if self.count % 2 else (a + self.select(self.count // 2)) / 2


def theil_sen(df: DataFrame, keys: list[str], t: str, y: str) -> DataFrame:
    """Median slope over all pairs of a key's points, and the intercept through the medians.

    Pairs with the same t have no slope; a key without any pair gives no row; points without t or y are
    left out.  A key's points are held by one task, 16 bytes each and some numbers beside them, and take
    n log n steps a round: no pair is made but a last few.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        found = Slopes(pdf[t].to_numpy(float), pdf[y].to_numpy(float))
        if not found.count:
            return pd.DataFrame({k: pdf[k][:0] for k in keys} | {"slope": [], "intercept": []})
        slope = found.median()
        return pd.DataFrame({k: pdf[k][:1] for k in keys} | {"slope": slope, "intercept": float(np.median(found.y) - slope * np.median(found.t))})

    kinds = ", ".join(f"`{k}` {kind}" for k, kind in df.select(*keys).dtypes)
    return df.select(*keys, t, y).dropna(subset=[t, y]).groupBy(*keys).applyInPandas(fit, f"{kinds}, slope double, intercept double")
