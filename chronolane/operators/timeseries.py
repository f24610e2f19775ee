"""The time-by-treatment mixed model, fitted from moments that Spark sums.

A fit asks for the likelihood at some points at a time.  What it needs of them are sums over units: of a small
group they are added up in one task, of a large one in a pass over all its units, wherever they lie.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.sources.scratch import stored

COLUMNS = ["one", "time", "treated", "both", "value"]
PAIRS = list(combinations_with_replacement(range(5), 2))
SINGULAR = 1e-4  # a relative deviation below it counts as none
#: Groups of more units than this are fitted in passes over all tasks.
LOCAL_UNITS = 20_000
STEP, ROUNDS = 1e-3, 100


def binned_means(df: DataFrame, keys: list[str], elapsed: str, value: str, width: float) -> DataFrame:
    """Mean of value per key and time bin, the bin named by its middle (time); rows without a value are left out."""
    middle = (F.floor(F.col(elapsed) / width) + 0.5) * width
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, middle.alias("time")).agg(F.avg(value).alias("value"), F.count("*").alias("n_samples"))


def packed(m: np.ndarray) -> np.ndarray:
    """The entries of symmetric matrices in the order of PAIRS."""
    i, j = np.array(PAIRS).T
    return m[..., i, j]


def unpacked(v: np.ndarray) -> np.ndarray:
    out = np.zeros((*v.shape[:-1], 5, 5))
    for k, (i, j) in enumerate(PAIRS):
        out[..., i, j] = out[..., j, i] = v[..., k]
    return out


def likelihood_sums(whole: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, thetas: np.ndarray) -> np.ndarray:
    """Per point of ``thetas`` the sums over units that the likelihood needs: 15 entries of the weighted cross products and the logarithms of the determinants.

    ``whole`` has the packed cross products of a unit, ``sizes`` its rows (rows of a session, sessions of that many
    rows, the packed sum of the outer products of their sums), ``lengths`` how many of them a unit has.  A session's
    intercept is taken out by a weight that depends on its number of rows alone.
    """
    starts = np.cumsum(lengths) - lengths
    rows, count, outer = sizes[:, 0], sizes[:, 1], sizes[:, 2:]
    every, out, owns = whole.sum(axis=0), np.empty((len(thetas), 16)), {}
    for k, theta in enumerate(thetas):
        ratio = theta[0] ** 2
        if ratio not in owns:
            w = ratio / (1 + ratio * rows)
            own = whole[:, :9] - np.add.reduceat(w[:, None] * outer[:, :9], starts)
            owns[ratio] = own[:, :5], own[:, [1, 5, 6, 7, 8]], every - w @ outer, float(count @ np.log1p(ratio * rows))
        first, second, total, logs = owns[ratio]  # first, second: a unit's rows of 1 and of time
        if len(theta) == 2:
            half = 1 + theta[1] ** 2 * first[:, 0]
            cut = (first.T * (theta[1] ** 2 / half)) @ first
        else:
            one, two = theta[1] * first + theta[2] * second, theta[3] * second
            a, b, c = 1 + theta[1] * one[:, 0] + theta[2] * one[:, 1], theta[3] * one[:, 1], 1 + theta[3] * two[:, 1]
            half = a * c - b * b
            mixed = (one.T * (b / half)) @ two
            cut = (one.T * (c / half)) @ one - mixed - mixed.T + (two.T * (a / half)) @ two
        out[k, :15], out[k, 15] = total - packed(cut), logs + np.log(half).sum()
    return out


def _solved(sums: np.ndarray, n: float) -> tuple[float, np.ndarray, float, np.ndarray]:
    """-2 log REML, coefficients, noise and their precision from one row of likelihood_sums()."""
    total = unpacked(sums[:15])
    a, b = total[:4, :4], total[:4, 4]
    beta = np.linalg.solve(a, b)
    rss = max(float(total[4, 4] - b @ beta), 1e-300)
    return float((n - 4) * math.log(rss) + sums[15] + np.linalg.slogdet(a)[1]), beta, rss / (n - 4), a


def fit_rounds(slope: bool, n: float) -> Generator[np.ndarray, np.ndarray, dict]:
    """A fit that yields points, takes their likelihood_sums() and returns the model.

    Newton steps within a radius, from differences of the likelihood around a point; a curvature counts by its
    size, so that a saddle is left, and a step that makes the likelihood worse is tried shorter.
    """
    theta = np.array([0.5, 0.5, 0.0, 0.5]) if slope else np.array([0.5, 0.5])
    d = len(theta)
    moves = STEP * np.eye(d)
    pairs = list(combinations(range(d), 2))
    radius, step, kicks, found = 0.5, np.zeros(d), 3, None
    for _ in range(ROUNDS):
        sums = yield np.array([theta, *(theta + moves), *(theta - moves), *(theta + moves[i] + moves[j] for i, j in pairs)])
        f = np.array([_solved(s, n)[0] for s in sums])
        if found is None or f[0] <= found[1] + 1e-11 * (1 + abs(found[1])):
            radius = radius if found is None else min(max(radius, 2 * float(np.linalg.norm(step))), 1.0)
            found = theta, f[0], sums[0]
            up, down = f[1 : 1 + d] - f[0], f[1 + d : 1 + 2 * d] - f[0]
            hessian = np.diag(up + down)
            for k, (i, j) in enumerate(pairs, 1 + 2 * d):
                hessian[i, j] = hessian[j, i] = f[k] - f[0] - up[i] - up[j]
            bend, axes = np.linalg.eigh(hessian / STEP**2)
            slopes = axes.T @ (up - down) / (2 * STEP)
            most = max(float(np.abs(bend).max()), 1e-300)
            long = -slopes / np.maximum(np.abs(bend), 1e-6 * most)
        else:
            radius = float(np.linalg.norm(step)) / 4
        step = axes @ long
        if (norm := float(np.linalg.norm(step))) > radius:
            step = step * (radius / norm)
        if -0.5 * float(slopes @ (axes.T @ step)) < 1e-12 * (1 + abs(found[1])) or np.linalg.norm(step) < 1e-7:
            if bend[0] > -1e-4 * most or not kicks:
                break
            kicks, step = kicks - 1, 0.1 * axes[:, 0]
        theta = found[0] + step
    theta = found[0]
    _, beta, noise, a = _solved(found[2], n)
    se = np.sqrt(noise * np.diag(np.linalg.inv(a)))
    deviations = [theta[0], theta[1]] + ([theta[3]] if slope else [])
    return {"beta": beta, "se": se, "noise": noise, "theta": theta, "singular": bool(np.min(np.abs(deviations)) < SINGULAR)}


def nested_model(cross: np.ndarray, unit: np.ndarray, slope: bool) -> dict:
    """REML fit of value ~ time * treated with random terms per unit and per session of a unit.

    ``cross`` has one 5 x 5 cross-product matrix of (1, time, treated, time x treated, value) per session,
    ``unit`` the unit of each.  A session has a random intercept, a unit a random intercept and, with
    ``slope``, a random slope on time that may correlate with it.  Everything the likelihood needs is in
    the matrices: the session's intercept is taken out of each, the sums of a unit's sessions then carry
    the unit's own terms.  singular: a random deviation is (almost) nought or the two are collinear.
    """
    flat, sums = packed(cross), cross[:, 0, :]
    per = pd.DataFrame(np.column_stack([np.ones(len(cross)), packed(sums[:, :, None] * sums[:, None, :])])).groupby([unit, flat[:, 0]]).sum()
    whole = pd.DataFrame(flat).groupby(unit).sum().to_numpy()
    sizes = np.column_stack([per.index.get_level_values(1), per.to_numpy()])
    lengths = per.groupby(level=0).size().to_numpy()
    return _run(fit_rounds(slope, float(flat[:, 0].sum())), lambda thetas: likelihood_sums(whole, sizes, lengths, thetas))


def _run(fit: Generator, sums) -> dict:
    try:
        points = next(fit)
        while True:
            points = fit.send(sums(points))
    except StopIteration as done:
        return done.value


class Scale:
    """A group's means and spreads, from its packed cross products: units in which the search sees numbers near one."""

    def __init__(self, whole: np.ndarray, units: int):
        whole = unpacked(whole)
        n, treated = whole[0, 0], whole[0, 2]
        self.n = int(n)
        scale = np.sqrt(np.maximum(np.diag(whole)[:4] / max(n, 1), 1e-300))
        fixed = whole[:4, :4] / n / np.outer(scale, scale)
        self.fits = bool(0 < treated < n and units >= 3 and n > 4 and np.linalg.cond(fixed) <= 1e12)
        span, spread = scale[1] or 1.0, math.sqrt(max(whole[4, 4] / n - (whole[0, 4] / n) ** 2, 1e-300))
        self.unit = np.array([1.0, span, 1.0, span, spread])
        shift = np.eye(5)
        shift[4, 0] = -whole[0, 4] / n
        change = shift / self.unit[:, None]
        #: What takes packed cross products into these units.
        self.change = packed(change @ unpacked(np.eye(15)) @ change.T)

    def changed(self, whole: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return whole @ self.change, np.column_stack([sizes[:, :2], sizes[:, 2:] @ self.change])

    def model(self) -> Generator[np.ndarray, np.ndarray, list[list]]:
        """The rows of the result without the key, by fit_rounds(): with a slope, without it where that is singular."""
        if not self.fits:
            return [["not fitted", None, None, None, None, self.n, None, "needs both treatments, three units and independent columns"]]
        random, note, found = "slope", "", (yield from fit_rounds(True, self.n))
        if found["singular"]:
            random, found = "intercept", (yield from fit_rounds(False, self.n))
            note = "singular fit" if found["singular"] else ""
        back = self.unit[4] / self.unit[:4]
        beta, se = found["beta"] * back, found["se"] * back
        z = beta / se
        return [[name, beta[k], se[k], z[k], math.erfc(abs(z[k]) / math.sqrt(2)), self.n, random, note] for name, k in (("time", 1), ("treatment", 2), ("time x treatment", 3))]


def unit_sums(moments: DataFrame, by: list[str]) -> DataFrame:
    """A row per unit from the moments of sessions: whole (15 sums), sizes (17 numbers per number of rows that its sessions have, one after another)."""
    outer = [F.sum(F.col(f"m0{i}") * F.col(f"m0{j}")) for i, j in PAIRS]
    alike = moments.groupBy(*by, "_unit", "m00").agg(
        F.array(F.col("m00"), F.count("*").cast("double"), *outer).alias("size"), *[F.sum(f"m{i}{j}").alias(f"s{i}{j}") for i, j in PAIRS]
    )
    return alike.groupBy(*by, "_unit").agg(F.array(*[F.sum(f"s{i}{j}") for i, j in PAIRS]).alias("whole"), F.flatten(F.collect_list("size")).alias("sizes"))


def _pass(units: DataFrame, asked: dict[int, tuple[Scale, np.ndarray]]) -> dict[int, np.ndarray]:
    """likelihood_sums() of the groups in ``asked`` (by _group) at their points, in one pass over the units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            group, lists = b.column("_group").to_numpy(), b.column("sizes")
            whole, sizes = b.column("whole").flatten().to_numpy().reshape(-1, 15), lists.flatten().to_numpy().reshape(-1, 17)
            lengths = lists.value_lengths().to_numpy() // 17
            for g in np.unique(group).tolist():
                mine = group == g
                scale, points = asked[g]
                found = likelihood_sums(*scale.changed(whole[mine], sizes[np.repeat(mine, lengths)]), lengths[mine], points)
                out[g] = out[g] + found if g in out else found
        for g, sums in out.items():
            yield pa.RecordBatch.from_pydict({"_group": np.full(len(sums), g, np.int32), "point": np.arange(len(sums), dtype=np.int32), **{f"v{k}": sums[:, k] for k in range(16)}})

    names = [f"v{k}" for k in range(16)]
    per = units.filter(F.col("_group").isin(list(asked))).mapInArrow(run, "_group int, point int, " + ", ".join(f"{v} double" for v in names))
    rows = per.groupBy("_group", "point").agg(*[F.sum(v).alias(v) for v in names]).collect()  # 15 rows a group at most
    found = {g: np.zeros((len(points), 16)) for g, (_, points) in asked.items()}
    for r in rows:
        found[r["_group"]][r["point"]] = r[2:]
    return found


def _fit_large(units: DataFrame, scales: dict[int, Scale]) -> dict[int, list[list]]:
    """The models of groups whose units lie in many tasks; all groups share a pass."""
    fits, points, done = {g: s.model() for g, s in scales.items()}, {}, {}

    def go(g: int, sums: np.ndarray | None) -> None:
        try:
            points[g] = fits[g].send(sums)
        except StopIteration as end:
            points.pop(g, None)
            done[g] = end.value

    for g in fits:
        go(g, None)
    while points:
        for g, sums in _pass(units, {g: (scales[g], p) for g, p in points.items()}).items():
            go(g, sums)
    return done


def timeseries_model(df: DataFrame, treatment: str, base: str, unit: str, session: str, by: dict[str, str], center: float, local_units: int = LOCAL_UNITS) -> DataFrame:
    """value ~ time * treatment per ``by`` group: term, estimate, se, z, p, n, random and note.

    ``df`` has rows (by, unit, session, treatment, time, value), as binned_means() gives them; time is taken
    off ``center``.  A session belongs to one unit; one that names two counts as two sessions.  The model with a random slope per unit is fitted first; where it is singular the one
    with a random intercept takes its place, and if that is singular too the note says so.  Rows with a
    NULL in any of these columns are left out.  Groups without both treatments, with fewer than three units
    or whose columns are collinear get one row "not fitted".  Normal tail areas stand for p.

    A session's cross products are summed in Spark, and a unit's sessions of one number of rows are added up.  A
    group of up to ``local_units`` units is fitted by one task; the likelihood of a larger one is summed over its
    units in passes, some twenty a model, and the driver holds the sums at 15 points for each such group.
    """
    names = list(by)
    rows = df.dropna(subset=[*names, treatment, unit, session, "time", "value"])
    w = dict(zip(COLUMNS, [F.lit(1.0), F.col("time") - center, (F.col(treatment) != base).cast("double"), (F.col("time") - center) * (F.col(treatment) != base).cast("double"), F.col("value")], strict=True))
    sums = [F.sum(w[COLUMNS[i]] * w[COLUMNS[j]]).alias(f"m{i}{j}") for i, j in PAIRS]
    moments = rows.groupBy(*names, F.col(unit).alias("_unit"), F.col(session).alias("_session")).agg(*sums)
    units = stored(unit_sums(moments, names), "units")
    totals = units.groupBy(*names).agg(F.count("*").alias("_units"), F.array(*[F.sum(F.get("whole", k)) for k in range(15)]).alias("_whole"))
    large = totals.filter(F.col("_units") > local_units).collect()  # few, as each has so many units
    columns = {**by, "term": "string", **dict.fromkeys(["estimate", "se", "z", "p"], "double"), "n": "long", "random": "string", "note": "string"}
    kinds = ", ".join(f"`{k}` {v}" for k, v in columns.items())

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[k].iloc[0] for k in names]
        whole, lengths = np.stack(pdf["whole"].to_list()), pdf["sizes"].map(len).to_numpy() // 17
        scale = Scale(whole.sum(axis=0), len(pdf))
        whole, sizes = scale.changed(whole, np.concatenate(pdf["sizes"].to_list()).reshape(-1, 17))
        rows = _run(scale.model(), lambda thetas: likelihood_sums(whole, sizes, lengths, thetas))
        return pd.DataFrame([[*key, *r] for r in rows], columns=list(columns))

    if not large:
        return units.groupBy(*names).applyInPandas(fit, kinds)
    keys = units.sparkSession.createDataFrame([(*[r[k] for k in names], g) for g, r in enumerate(large)], ", ".join(f"`{k}` {v}" for k, v in by.items()) + ", _group int")
    apart = units.join(F.broadcast(keys), names).select("_group", "whole", "sizes")
    found = _fit_large(apart, {g: Scale(np.array(r["_whole"]), r["_units"]) for g, r in enumerate(large)})
    rows = [[*[large[g][k] for k in names], *[v.item() if isinstance(v, np.generic) else v for v in r]] for g in found for r in found[g]]
    rest = units.join(F.broadcast(keys), names, "left_anti").groupBy(*names).applyInPandas(fit, kinds)
    return rest.unionByName(units.sparkSession.createDataFrame(rows, kinds))
