"""Bin completion: a branch-and-bound search for the fewest bins, on a histogram of sizes.

Sizes are whole numbers up to the capacity, so whatever the number of items, the input is one count per
size.  A node takes the largest size left and enumerates fillings of the room beside it; a filling that
another one dominates (its items fit into the other's) is left out.  A filling is used for as many bins as
the counts allow, fewer when the search comes back.  A branch ends when the waste so far and the least waste of
what is left exceed what one bin less than the incumbent allows.  The first incumbent is best fit
decreasing; the search ends at the lower bound, which proves the solution, or after ``nodes`` nodes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Fillings kept at a node, fillings looked at for it, and nodes of the search.
WIDTH, LOOKED, NODES = 12, 2_000, 6_000
#: Fillings without waste after which a node looks no further: the search begins anew with each, under the same incumbent.
EXACT = (8, 48, 2)

#: Sizes of a bin in falling order, and how many bins are filled so.
Pattern = tuple[tuple[int, ...], int]


def least_bins(counts: np.ndarray) -> int:
    """A lower bound on bins: for each limit, large items need bins of their own and middle ones only fit beside some of them."""
    capacity = len(counts) - 1
    number, total = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half = capacity // 2
    low = np.arange(half + 1)
    alone = number[capacity] - number[capacity - low]
    paired = number[capacity - low] - number[half]
    room = paired * capacity - (total[capacity - low] - total[half])
    below = np.where(low > 0, total[np.maximum(low - 1, 0)], 0)
    over = np.maximum(0, total[half] - below - room)
    return int((alone + paired + -(-over // capacity)).max())


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Best fit decreasing: each item, largest first, goes to the fullest bin that has room for it."""
    capacity = len(counts) - 1
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))  # room -> contents -> bins
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            room = next((g for g in sorted(bins) if g >= size), None)
            if room is None:
                room, held, here = capacity, (), left
            else:
                held, here = bins[room].popitem()
                if not bins[room]:
                    del bins[room]
            each = room // size
            full = min(here, left // each)
            for n, each_gets in ((full, each), (min(1, here - full) if left - full * each else 0, left - full * each)):
                if n and each_gets:
                    each_gets = min(each_gets, each)
                    bins[room - each_gets * size][held + (size,) * each_gets] += n
                    left -= n * each_gets
                    here -= n
            if here and held:
                bins[room][held] += here
    return [(held, n) for of in bins.values() for held, n in of.items()]


def fits_into(items: tuple[int, ...], rooms: list[int]) -> bool:
    """Whether ``items`` (largest first) can be dealt to ``rooms``."""
    if not items:
        return True
    tried = set()
    for k, room in enumerate(rooms):
        if room >= items[0] and room not in tried:
            tried.add(room)
            rooms[k] -= items[0]
            found = fits_into(items[1:], rooms)
            rooms[k] = room
            if found:
                return True
    return False


def fillings(counts: list[int], below: list[int], room: int, exact: int, width: int = WIDTH, looked: int = LOOKED) -> list[tuple[int, ...]]:
    """The best undominated fillings of ``room``, least waste first; ``below[x]`` is the largest size at hand up to x."""
    found: list[tuple[int, tuple[int, ...]]] = []
    full = 0

    def walk(room: int, most: int, held: list[int]) -> Iterator[tuple[int, ...]]:
        size, stop = below[min(room, most)], True
        while size:
            n = held.count(size) if held and held[-1] == size else 0
            if counts[size] > n:
                stop = False
                held.append(size)
                yield from walk(room - size, size, held)
                held.pop()
            size = below[size - 1]
        if stop:
            yield tuple(held)

    for k, items in enumerate(walk(room, room, [])):
        waste = room - sum(items)
        found.append((waste, items))
        full += not waste
        if full >= exact or k + 1 >= looked:
            break
    found.sort(key=lambda f: (f[0], len(f[1]), [-x for x in f[1][::-1]]))  # small items are kept for later
    out: list[tuple[int, ...]] = []
    for _, items in found:
        if len(items) > 8 or not any(len(a) <= len(items) and fits_into(items, list(a)) for a in out):
            out.append(items)
        if len(out) == width:
            break
    return out


def _options(counts: list[int], size: int, capacity: int, exact: int) -> list[tuple[tuple[int, ...], int]]:
    """What can be done with the largest size: fillings and numbers of bins, the most promising first."""
    counts[size] -= 1
    below, last = [], 0
    for s in range(capacity - size + 1):
        if s and counts[s]:
            last = s
        below.append(last)
    found = fillings(counts, below, capacity - size, exact)
    counts[size] += 1
    out = []
    for items in found:
        bin_ = (size, *items)
        most = min(counts[s] // bin_.count(s) for s in set(bin_))
        out.append((bin_, most))
    # fewer bins of a filling: tried after every filling was tried to the full
    return out + [(bin_, n) for bin_, most in out for n in dict.fromkeys((most // 2, 1)) if 0 < n < most]


def complete(counts: np.ndarray, nodes: int = NODES) -> tuple[list[Pattern], int]:
    """Patterns that use every item, and a lower bound on the number of bins; counts[s] items have size s, 1 to the capacity."""
    counts = counts.astype(np.int64)
    best, bound = best_fit(counts), least_bins(counts)
    for exact in EXACT:
        if sum(n for _, n in best) > bound:
            best = _search(counts, best, bound, nodes // len(EXACT), exact)
    return best, bound


def _search(counts: np.ndarray, best: list[Pattern], bound: int, nodes: int, exact: int) -> list[Pattern]:
    """The best of an incumbent and what a depth-first search of so many nodes finds."""
    capacity, fewest = len(counts) - 1, sum(n for _, n in best)
    total, left = int((counts * np.arange(capacity + 1)).sum()), counts.tolist()
    done: list[Pattern] = []
    used = waste = 0
    stack = [iter(_options(left, int(np.flatnonzero(counts)[-1]), capacity, exact))]
    while stack and nodes and fewest > bound:
        option = next(stack[-1], None)
        if option is None:
            stack.pop()
            if done:
                bin_, n = done.pop()
                used, waste = used - n, waste - n * (capacity - sum(bin_))
                for s in bin_:
                    left[s] += n
            continue
        bin_, n = option
        nodes -= 1
        more = n * (capacity - sum(bin_))
        if waste + more > (fewest - 1) * capacity - total:
            continue
        for s in bin_:
            left[s] -= n
        done.append((bin_, n))
        used, waste = used + n, waste + more
        rest = np.array(left, np.int64)
        if not rest.any():
            best, fewest = list(done), used
        if rest.any() and used + least_bins(rest) < fewest:
            stack.append(iter(_options(left, int(np.flatnonzero(rest)[-1]), capacity, exact)))
        else:
            stack.append(iter(()))
    return best
