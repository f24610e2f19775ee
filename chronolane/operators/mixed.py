"""Mixed models with a random intercept per unit, fitted from sums.

Given the ratio of the two variances, a unit counts in the likelihood by its number of rows, its sums over
each cell of the design and its sum of outcomes; and how much its sums weigh depends on its number of rows
alone.  So the squares and products of the sums are added up over all units of one size, and a fit needs a few
numbers per size and pair of cells: no task has the rows, or the units, of a model.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.sources.scratch import stored

#: z of a two-sided 95 % interval.
Z95 = 1.959964


def cell_sums(df: DataFrame, outcome: str, cell: Column, unit: str, by: list[str]) -> DataFrame:
    """Sums per ``by`` group as rows (kind, size, a, b, v, w) of cells a and b and units of one size.

    all: rows v and sum of squared outcomes w.  cell: rows v and sum of outcomes w of cell a.  units: units
    v of a size and sum w of their squared sums.  cross: sum v of rows in cell a times the unit's sum.
    pair: sum v of rows in cell a times rows in cell b.  Rows without outcome, unit or cell are left out.
    """
    rows = df.select(*by, F.col(unit).alias("_u"), cell.cast("string").alias("_c"), F.col(outcome).cast("double").alias("_y")).dropna(subset=["_u", "_c", "_y"])
    per = rows.groupBy(*by, "_u", "_c").agg(F.count("*").cast("double").alias("n"), F.sum("_y").alias("y"), F.sum(F.col("_y") * F.col("_y")).alias("yy"))
    cells = F.collect_list(F.struct(F.col("_c").alias("c"), "n", "y", "yy")).alias("cells")
    units = stored(per.groupBy(*by, "_u").agg(F.sum("n").alias("size"), F.sum("y").alias("sum"), cells), "units")  # all five kinds come from it
    none, zero = F.lit(None).cast("string"), F.lit(0.0)

    def tagged(rows: DataFrame, kind: str, size: Column, a: Column, b: Column, v: Column, w: Column) -> DataFrame:
        found = rows.select(*by, size.alias("size"), a.alias("a"), b.alias("b"), v.alias("v"), w.alias("w")).groupBy(*by, "size", "a", "b").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
        return found.select(*by, F.lit(kind).alias("kind"), "size", "a", "b", "v", "w")

    opened = units.select(*by, "size", "sum", "cells", F.explode("cells").alias("p"))
    paired = opened.select(*by, "size", "p", F.explode("cells").alias("q"))
    parts = [
        tagged(opened, "all", zero, none, none, F.col("p.n"), F.col("p.yy")),
        tagged(opened, "cell", zero, F.col("p.c"), none, F.col("p.n"), F.col("p.y")),
        tagged(units, "units", F.col("size"), none, none, F.lit(1.0), F.col("sum") * F.col("sum")),
        tagged(opened, "cross", F.col("size"), F.col("p.c"), none, F.col("p.n") * F.col("sum"), zero),
        tagged(paired, "pair", F.col("size"), F.col("p.c"), F.col("q.c"), F.col("p.n") * F.col("q.n"), zero),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Sums:
    """One group's rows of cell_sums()."""

    def __init__(self, rows: pd.DataFrame):
        kinds = {k: g for k, g in rows.groupby("kind")}
        self.n, self.yy = float(kinds["all"]["v"].iloc[0]), float(kinds["all"]["w"].iloc[0])
        cells = kinds["cell"].sort_values("a")
        self.cells = cells["a"].tolist()
        self.rows, self.y = cells["v"].to_numpy(), cells["w"].to_numpy()
        at = {c: k for k, c in enumerate(self.cells)}
        units = kinds["units"].sort_values("size")
        self.size, self.units, self.squares = (units[c].to_numpy() for c in ("size", "v", "w"))
        place = {s: k for k, s in enumerate(self.size.tolist())}
        self.cross = np.zeros((len(place), len(at)))
        self.pairs = np.zeros((len(place), len(at), len(at)))
        for s, a, v in kinds["cross"][["size", "a", "v"]].itertuples(index=False):
            self.cross[place[s], at[a]] = v
        for s, a, b, v in kinds["pair"][["size", "a", "b", "v"]].itertuples(index=False):
            self.pairs[place[s], at[a], at[b]] = v

    def fit(self, design: np.ndarray) -> dict:
        """REML fit for a design (a row per cell): beta, se, z, p, group and residual variance."""
        n, k = self.n, design.shape[1]
        xx, xy = design.T @ (self.rows[:, None] * design), design.T @ self.y
        sxx = np.einsum("ca,scd,db->sab", design, self.pairs, design)
        sxy = self.cross @ design

        def solve(log_ratio: float):
            ratio = math.exp(log_ratio)
            w = ratio / (1 + ratio * self.size)
            a, b, c = xx - np.tensordot(w, sxx, 1), xy - w @ sxy, self.yy - float(w @ self.squares)
            beta = np.linalg.solve(a, b)
            rss = max(c - float(b @ beta), 1e-300)
            reml = (n - k) * math.log(rss) + float(self.units @ np.log1p(ratio * self.size)) + np.linalg.slogdet(a)[1]
            return reml, beta, rss / (n - k), a

        # the ratio by a golden-section search over its logarithm
        lo, hi, gold = -16.0, 12.0, (math.sqrt(5) - 1) / 2
        p, q = hi - gold * (hi - lo), lo + gold * (hi - lo)
        fp, fq = solve(p)[0], solve(q)[0]
        for _ in range(80):
            if fp < fq:
                hi, q, fq = q, p, fp
                p = hi - gold * (hi - lo)
                fp = solve(p)[0]
            else:
                lo, p, fp = p, q, fq
                q = lo + gold * (hi - lo)
                fq = solve(q)[0]
        at = (lo + hi) / 2
        _, beta, noise, a = solve(at)
        se = np.sqrt(noise * np.diag(np.linalg.inv(a)))
        z = beta / se
        return {"beta": beta, "se": se, "z": z, "p": np.array([math.erfc(abs(v) / math.sqrt(2)) for v in z]), "group_var": math.exp(at) * noise, "noise_var": noise}


def _fitted(sums: DataFrame, by: dict[str, str], columns: dict[str, str], fit: Callable[[Sums], list[list]]) -> DataFrame:
    names = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[k].iloc[0] for k in names]
        return pd.DataFrame([[*key, *r] for r in fit(Sums(pdf))], columns=[*names, *columns])

    kinds = ", ".join(f"`{k}` {v}" for k, v in {**by, **columns}.items())
    return sums.groupBy(*names).applyInPandas(run, kinds)


def factor_model(df: DataFrame, outcome: str, factor: str, unit: str, base: str, by: dict[str, str]) -> DataFrame:
    """A mixed model per ``by`` group with one factor against ``base``: term, estimate, se, z, p, ci_lower, ci_upper, n, note."""

    def fit(s: Sums) -> list[list]:
        levels = [c for c in s.cells if c != base]
        if not levels or base not in s.cells or s.units.sum() < 3:
            return [["not fitted", *[None] * 6, int(s.n), "needs two levels and three units"]]
        m = s.fit(np.array([[1.0, *(float(c == v) for v in levels)] for c in s.cells]))
        return [[f"{v} - {base}", m["beta"][j], m["se"][j], m["z"][j], m["p"][j], m["beta"][j] - Z95 * m["se"][j], m["beta"][j] + Z95 * m["se"][j], int(s.n), ""] for j, v in enumerate(levels, 1)]

    columns = {"term": "string", **dict.fromkeys(["estimate", "se", "z", "p", "ci_lower", "ci_upper"], "double"), "n": "long", "note": "string"}
    return _fitted(cell_sums(df, outcome, F.col(factor), unit, list(by)), by, columns, fit)


def interaction_model(df: DataFrame, outcome: str, treatment: str, base: str, group: str, groups: tuple[str, str], unit: str, by: dict[str, str]) -> DataFrame:
    """The treatment effect in each of two groups and their difference, with a random intercept per unit; "not fitted" where a cell of the two by two is empty or there are fewer than three units."""
    treated = F.coalesce(F.col(treatment) != base, F.lit(True)).cast("int")
    second = F.coalesce(F.col(group) == groups[1], F.lit(False)).cast("int")

    def fit(s: Sums) -> list[list]:
        t, g = (np.array([float(c[k]) for c in s.cells]) for k in (0, 1))
        if len(s.cells) < 4 or s.units.sum() < 3:
            return [["not fitted", None, None, None, None]]
        one = np.ones(len(t))
        apart, cross = s.fit(np.column_stack([one, g, t * (1 - g), t * g])), s.fit(np.column_stack([one, t, g, t * g]))
        picks = [(f"effect | {groups[0]}", apart, 2), (f"effect | {groups[1]}", apart, 3), (f"interaction: {groups[1]} - {groups[0]}", cross, 3)]
        return [[n, m["beta"][j], m["se"][j], m["z"][j], m["p"][j]] for n, m, j in picks]

    columns = {"term": "string", **dict.fromkeys(["estimate", "se", "z", "p"], "double")}
    return _fitted(cell_sums(df, outcome, F.concat(treated, second), unit, list(by)), by, columns, fit)
