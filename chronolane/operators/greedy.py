"""Detectors whose next step depends on their own last decision; one ordered pass per sequence.

State is a few numbers, so rows are streamed through sorted partitions (no group is held in memory):
rows are dealt by key, sorted, and a small machine is reset wherever the key changes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import median
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stream(df: DataFrame, keys: list[str], order: list[str], schema: str, machine: Callable) -> DataFrame:
    """Runs machine() per key: it gets (step, finish); both return lists of output rows."""
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        current, state, out = None, None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    if state:
                        out += [(*current, *r) for r in state[1]()]
                    current, state = key, machine()
                out += [(*key, *r) for r in state[0](row)]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if state:
            out += [(*current, *r) for r in state[1]()]
        yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def range_bouts(df: DataFrame, keys: dict[str, str], position: str, t: str, x: str, speed: str, order: list[str], slow: float, reach: float, least: float, gap: float | None = None) -> DataFrame:
    """Maximal greedy stretches of slow rows whose x stays within ``reach``: bout_index, start, end (values of ``position``) and duration.

    A row that would stretch the range too far ends the bout and begins the next; a fast row, or a jump
    of ``position`` above ``gap``, only ends it.  The duration is the difference of ``t``.
    """
    names = list(keys)

    def machine():
        held = {"first": None, "last": None, "lo": 0.0, "hi": 0.0, "n": 0}

        def close() -> list[tuple]:
            first, last = held["first"], held["last"]
            held["first"] = None
            if first is None or last[1] - first[1] < least:
                return []
            held["n"] += 1
            return [(held["n"] - 1, first[0], last[0], float(last[1] - first[1]))]

        def step(row) -> list[tuple]:
            at, when, where, v = (getattr(row, c) for c in (position, t, x, speed))
            out = []
            if gap is not None and held["last"] is not None and at - held["last"][0] > gap:
                out += close()
            if not v <= slow:
                out += close()
            elif held["first"] is None:
                held.update(first=(at, when), lo=where, hi=where)
            else:
                lo, hi = min(held["lo"], where), max(held["hi"], where)
                if hi - lo <= reach:
                    held.update(lo=lo, hi=hi)
                else:
                    out += close()
                    held.update(first=(at, when), lo=where, hi=where)
            held["last"] = (at, when)
            return out

        return step, close

    kinds = ", ".join(f"{k} {v}" for k, v in keys.items())
    return _stream(df, names, order, f"{kinds}, bout_index long, first long, last long, duration double", machine)


class GateRule(NamedTuple):
    """A reading is short if its core lies more than ``margin`` below the median of the last ``history``
    remembered bodies, of which there must be ``least``; ``reset`` short readings in a row empty the memory."""

    margin: float
    history: int
    least: int = 5
    reset: int = 30


def gate_reading(rule: GateRule, memory: list[float], short: int, core: float, body: float | None) -> tuple[float | None, list[float], int]:
    """One reading: (the reference that it fell short of or None, memory, short readings in a row).

    ``core`` is what is judged (the warm end of what was found), ``body`` what is remembered if it passes
    (the mean where it could be measured); a reading that passes without a body changes nothing.
    """
    wanted = median(memory) if len(memory) >= rule.least else -math.inf
    if core < wanted - rule.margin:
        return (wanted, [], 0) if short + 1 >= rule.reset else (wanted, memory, short + 1)
    return (None, memory, short) if body is None else (None, [*memory, body][-rule.history :], 0)


def temperature_gate(df: DataFrame, keys: dict[str, str], id: str, core: str, body: str, order: list[str], rule: GateRule) -> DataFrame:
    """Each row's id with the reference it fell short of (NULL if it passed); rows without a core are left out."""

    def machine():
        memory, short = [], 0

        def step(row) -> list[tuple]:
            nonlocal memory, short
            mean = getattr(row, body)
            reference, memory, short = gate_reading(rule, memory, short, getattr(row, core), None if mean is None or math.isnan(mean) else mean)
            return [(getattr(row, id), reference)]

        return step, list

    kinds = ", ".join(f"{k} {v}" for k, v in keys.items())
    return _stream(df.filter(F.col(core).isNotNull()), list(keys), order, f"{kinds}, {id} long, reference double", machine)
