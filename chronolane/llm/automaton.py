"""Counting byte automata that are scanned in chunks and composed.

An automaton reads UTF-8 bytes.  It counts units (say, code points) as they end and marks (control
strings) as they end.  What a run of bytes does is a function: for each state it may be entered in, the
state it is left in, the units and the marks.  Functions compose associatively, so chunks are scanned
without knowing what comes before them, in any task, and a tree of compositions within a chunk takes
numpy a few steps; the tree then finds the byte after which a given unit has ended.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: A function's value is one integer: the state in the low bits, then the units, then the marks.
STATE_BITS, UNIT_BITS = 12, 30
_STATE, _UNIT = (1 << STATE_BITS) - 1, (1 << UNIT_BITS) - 1
#: No chunk may have more bytes than a value has room for.
MOST_BYTES = 1 << 20
_TABLE = 1 << 18


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Functions (rows) of ``first`` followed by those of ``then``, row by row."""
    n, states = first.shape
    left = first & _STATE
    return (first ^ left) + then.ravel()[left + np.arange(0, n * states, states)[:, None]]


def utf8_units() -> tuple[np.ndarray, np.ndarray]:
    """Code points as units: next state and whether a unit ends, by byte and state (bytes still to come)."""
    step, ends = np.zeros((256, 4), int), np.ones((256, 4), int)
    for first, last, more in ((0xC0, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF7, 3)):
        step[first : last + 1], ends[first : last + 1] = more, 0
    for left in (1, 2, 3):
        step[0x80:0xC0, left], ends[0x80:0xC0, left] = left - 1, left == 1
    return step, ends


def line_units() -> tuple[np.ndarray, np.ndarray]:
    """Lines as units: a unit ends with each line feed."""
    step, ends = np.zeros((256, 1), int), np.zeros((256, 1), int)
    ends[0x0A] = 1
    return step, ends


def matcher(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of any of ``words``: next state and how many end, by byte and state."""
    tree, ends = [{}], [0]
    for word in words:
        at = 0
        for byte in word:
            if byte not in tree[at]:
                tree[at][byte] = len(tree)
                tree.append({})
                ends.append(0)
            at = tree[at][byte]
        ends[at] += 1
    step, back, queue = np.zeros((256, len(tree)), int), [0] * len(tree), [0]
    for at in queue:
        if at:
            step[:, at] = step[:, back[at]]
            ends[at] += ends[back[at]]
        for byte, child in tree[at].items():
            back[child] = int(step[byte, at]) if at else 0
            step[byte, at] = child
            queue.append(child)
    return step, np.array(ends)[step]


@dataclass(frozen=True)
class Automaton:
    """``grams[g]`` is the function of ``width`` byte classes in a row; ``single`` that of one class; class 0 is no byte."""

    classes: np.ndarray
    single: np.ndarray
    grams: np.ndarray
    width: int

    @classmethod
    def make(cls, units: tuple[np.ndarray, np.ndarray], marks: tuple[np.ndarray, np.ndarray]) -> Automaton:
        """Both automata run side by side, over the pairs of states that can be reached together."""
        names, values = {(0, 0): 0}, []
        for u, m in (queue := [(0, 0)]):
            row = []
            for byte in range(256):
                to = (int(units[0][byte, u]), int(marks[0][byte, m]))
                if to not in names:
                    names[to] = len(names)
                    queue.append(to)
                row.append(names[to] | int(units[1][byte, u]) << STATE_BITS | int(marks[1][byte, m]) << (STATE_BITS + UNIT_BITS))
            values.append(row)
        if len(names) > _STATE:
            raise ValueError(f"the automaton has {len(names)} states, {_STATE} at most are supported")
        found, which = np.unique(np.array(values, np.int64).T, axis=0, return_inverse=True)
        single = np.concatenate([np.arange(len(names))[None, :], found])
        width, grams = 1, single
        while len(grams) * single.size <= _TABLE:
            grams = compose(np.repeat(grams, len(single), axis=0), np.tile(single, (len(grams), 1)))
            width += 1
        return cls((which.ravel() + 1).astype(np.int64), single, grams, width)

    def scan(self, data: bytes | memoryview) -> Scan:
        """The functions of a chunk's bytes, at every level of the tree of compositions."""
        if len(data) > MOST_BYTES:
            raise ValueError(f"a chunk has {len(data)} bytes, {MOST_BYTES} at most are supported")
        w = self.width
        codes = np.zeros(-(-max(1, len(data)) // w) * w, np.int64)
        codes[: len(data)] = self.classes[np.frombuffer(data, np.uint8)]
        gram = codes[::w].copy()
        for k in range(1, w):
            gram = gram * len(self.single) + codes[k::w]
        levels = [self.grams[gram]]
        while len(levels[-1]) > 1:
            if len(levels[-1]) % 2:
                levels[-1] = np.concatenate([levels[-1], self.single[:1]])
            levels.append(compose(levels[-1][0::2], levels[-1][1::2]))
        return Scan(self, codes, levels)


@dataclass(frozen=True)
class Scan:
    of: Automaton
    codes: np.ndarray
    levels: list[np.ndarray]

    def function(self) -> np.ndarray:
        return self.levels[-1][0]

    def select(self, state: int, unit: int) -> int:
        """The byte after which the ``unit``-th unit (from 1) has ended, for a chunk entered in ``state``."""
        node = 0
        for level in self.levels[-2::-1]:
            node *= 2
            value = int(level[node, state])
            if (units := value >> STATE_BITS & _UNIT) < unit:
                node, unit, state = node + 1, unit - units, value & _STATE
        at = node * self.of.width
        while True:
            value = int(self.of.single[self.codes[at], state])
            unit, state, at = unit - (value >> STATE_BITS & _UNIT), value & _STATE, at + 1
            if unit <= 0:
                return at


def value_of(value: int) -> tuple[int, int, int]:
    """State, units and marks of a function's value."""
    return value & _STATE, value >> STATE_BITS & _UNIT, value >> (STATE_BITS + UNIT_BITS)


def running(functions: Sequence[np.ndarray], state: int = 0) -> tuple[list[int], list[int], int]:
    """Chunks in order: the state each is entered in, the units before each (and after all), and all marks."""
    states, before, marks = [], [0], 0
    for f in functions:
        states.append(state)
        state, units, more = value_of(int(f[state]))
        before.append(before[-1] + units)
        marks += more
    return states, before, marks
