"""Lower bounds on the outlier shares of a grid of clocks (numpy; one lane at one rate).

The other track is tabulated once in whole numbers, so that the differences of a drift at all offsets are slices of the
table.  How many of them lie near their median is then counted from above.  A bound is never above the share, so a
search that scores what its bounds leave open finds what a search of the whole grid finds.
"""

from __future__ import annotations

import numpy as np

UNITS = 48  # whole numbers to an outlier limit
CELLS, PHASES = 1 << 16, 64  # cells of a table, about, and cells to a step, at most
HALF = 0.9  # what a cell's values may differ from its middle
WINDOW = UNITS + 4  # an outlier limit in whole numbers, with the rounding of two differences (0.5 and HALF and 0.5 each)
FAR, OPEN, MISSING = 4000, 14000, 24000  # values end at -FAR and FAR; some value or none; no value
EVERY, NEAR = 4, 20  # offsets to one whose median is taken, and how near to such medians the others' are looked for


class Bounds:
    """Bounds for samples x against the track (t, tx), lines longer than ``gap`` left out; ``usable`` says whether it has any. ``largest`` is the largest instant or offset."""

    def __init__(self, x: np.ndarray, t: np.ndarray, tx: np.ndarray, step: float, outlier: float, gap: float, largest: float):
        self.x, self.t, self.tx, self.grid, self.largest = x, t, tx, (step, outlier, gap), largest
        span = t[-1] - t[0]
        self.phases = int(np.clip(step * CELLS / span, 1, PHASES))
        self.size = size = step / self.phases
        near = 6400 * np.spacing(max(abs(t[0]), abs(t[-1]), largest)) / size  # a hundred times the rounding of instants, in cells
        self.usable = outlier > 0 and near < 0.25 and span / size < 32 * CELLS
        if not self.usable:
            return
        unit, middle = outlier / UNITS, np.median(tx)
        whole = lambda v: np.clip(np.rint(v / unit), -FAR, FAR).astype(np.int16)
        self.small, self.beyond = whole(x - np.median(x)), np.flatnonzero(np.abs(x - np.median(x)) > FAR * unit)
        self.origin = t[0] - 2 * size
        steps = int(np.ceil((span / size + 4) / self.phases))
        edges = np.interp(self.origin + size * np.arange(steps * self.phases + 1), t, tx)
        low, high = np.minimum(edges[:-1], edges[1:]), np.maximum(edges[:-1], edges[1:])
        place = (t - self.origin) / size
        first, last = (place - near).astype(np.int64), (place + near).astype(np.int64)
        for at in (first, last):
            np.minimum.at(low, at, tx)
            np.maximum.at(high, at, tx)
        cells = whole((low + high) / 2 - middle)
        cells[(high - low > 2 * HALF * unit) | (np.maximum(np.abs(high - middle), np.abs(low - middle)) > FAR * unit)] = OPEN
        steep = np.flatnonzero(high - low > 2 * unit)  # an instant by its edge may be taken for one of the cell beside it
        cells[steep - 1] = cells[np.minimum(steep + 1, len(cells) - 1)] = OPEN
        known = np.concatenate([[False], np.diff(t) <= gap, [False]])
        begin, end = np.append(0, last + 1), np.append(first, len(cells))
        for k in np.flatnonzero(~known):  # lines without values, the first before the track and the last after it
            cells[begin[k] : end[k]] = MISSING
        for at in (first, last):
            cells[at[~(known[:-1] & known[1:])]] = OPEN
        self.table, self.many = np.ascontiguousarray(cells.reshape(steps, self.phases).T), 0

    def serve(self, x: np.ndarray, t: np.ndarray, tx: np.ndarray, step: float, outlier: float, gap: float, largest: float) -> bool:
        """Whether these are bounds for that too, as for another rate of a lane."""
        return self.grid == (step, outlier, gap) and largest <= self.largest and all(np.array_equal(*v) for v in ((self.x, x), (self.t, t), (self.tx, tx)))

    def differences(self, bases: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Track minus sample in whole numbers, samples by columns, for instants at ``bases`` (drifts by samples) + offsets."""
        many, steps = len(offsets), self.table.shape[1]
        if many != self.many:
            blank = np.full((self.phases, many), MISSING, np.int16)
            self.many, self.slices = many, np.lib.stride_tricks.sliding_window_view(np.concatenate([blank, self.table, blank], axis=1), many, axis=1)
        cell = np.clip(np.floor((bases.T + (offsets[0] - self.origin)) / self.size), -many * self.phases, steps * self.phases).astype(np.int64)
        m = self.slices[cell % self.phases, cell // self.phases + many]
        m -= self.small[:, None, None]
        if len(self.beyond):
            m[self.beyond] = np.where(m[self.beyond] > OPEN + FAR, MISSING, OPEN)
        return m.reshape(len(m), -1)

    def shares(self, m: np.ndarray, bases: np.ndarray, step: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A bound for each column, 0 where its median isn't where it was looked for, and how many of its values are sure and how many there may be."""
        many, one = m.shape[1] // len(bases), len(bases) // 2
        sure, n = self._at_most(m, 2 * FAR), self._at_most(m, OPEN + FAR)
        # medians are guessed from some at one drift: the others' samples pass the same places a little earlier or later
        at = slice(one * many, (one + 1) * many, EVERY)
        lower, upper = self._middles(m[:, at], sure[at], n[at])
        guess = np.interp(np.arange(many), np.arange(0, many, EVERY), (lower + upper) / 2).astype(np.int16)
        ahead = np.rint(np.nan_to_num((bases.mean(axis=1) - bases[one].mean()) / step)).astype(np.int64)
        guess = np.take(guess, np.arange(many) + ahead[:, None], mode="clip").ravel()
        low = self._low(m, sure, n, guess, NEAR)
        low[n < max(1, least)] = np.inf
        return low, sure, n

    def closer(self, m: np.ndarray, sure: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A closer bound for each of a few columns, from the medians themselves."""
        lower, upper = self._middles(m, sure, n)
        return self._low(m, sure, n, ((lower + upper) / 2).astype(np.int16), np.ceil((upper - lower) / 2).astype(np.int16) + 1)

    def _middles(self, m: np.ndarray, sure: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the median of each column lies between."""
        rows = m.T.astype(np.float32, order="C")  # sorted faster than whole numbers
        rows.sort(axis=1)
        row, n = np.arange(len(rows)), n.astype(np.int64)
        return rows[row, np.maximum((n + 1) // 2 - (n - sure) - 1, 0)], rows[row, np.minimum(n // 2, rows.shape[1] - 1)]

    def _low(self, m: np.ndarray, sure: np.ndarray, n: np.ndarray, guess: np.ndarray, near: np.ndarray | int) -> np.ndarray:
        """The share of values that are too far from the median of each column, at least, if that is ``near`` to the guess; else 0."""
        held = (self._at_most(m, guess - near) + (n - sure) < (n + 1) // 2) & (self._at_most(m, guess + near) > n // 2)
        outside = sure - self._at_most(m, guess + (near + WINDOW)) + self._at_most(m, guess - (near + WINDOW))
        return np.where(held, outside / np.maximum(n, 1).astype(float), 0.0)

    @staticmethod
    def _at_most(m: np.ndarray, limit: np.ndarray | int) -> np.ndarray:
        """How many entries of each column are at most its limit; in bytes, where these hold it."""
        found = (m <= limit).view(np.uint8)
        if len(m) < 255:
            return np.add.reduce(found, axis=0, dtype=np.uint8)
        return sum(np.add.reduce(found[k : k + 255], axis=0, dtype=np.uint8).astype(np.int64) for k in range(0, len(m), 255))
