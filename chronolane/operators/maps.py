"""Projective maps fitted to stored pairs of points.

A least-squares map is the smallest eigenvector of a 9 x 9 matrix whose blocks are four sums of products:
of (x, y, 1) with itself, plain and weighted by u, by v and by u^2 + v^2.  These 24 numbers a key merge like
any sum, so a fit of any number of pairs is one aggregation and a small matrix per key.  A map for mirrored x
comes from the same sums, as mirroring is a linear change of (x, y, 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.operators.columns import homography

#: The products of (x, y, 1) with itself, as indexes of rows and columns.
PRODUCTS = [(i, j) for i in range(3) for j in range(i, 3)]
WEIGHTS = ["one", "u", "v", "w"]
#: A fit is refused where the second smallest eigenvalue is this small beside the largest: more than one map would do.
RANK = 1e-10


def moments(pairs: DataFrame, keys: list[str], x: str, y: str, u: str, v: str) -> DataFrame:
    """Per key n, centres and scales of both sides (cx, cy, sx; cu, cv, su), and the 24 sums of scaled pairs; pairs with a missing value are left out."""
    whole = pairs.dropna(subset=[x, y, u, v])
    var = lambda a, b: F.sqrt(F.var_pop(a) + F.var_pop(b))
    some = whole.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), var(x, y).alias("sx"), F.avg(u).alias("cu"), F.avg(v).alias("cv"), var(u, v).alias("su")
    )
    some = some.withColumns({c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0) for c in ("sx", "su")})
    p = [(F.col(x) - F.col("cx")) / F.col("sx"), (F.col(y) - F.col("cy")) / F.col("sx"), F.lit(1.0)]
    q = [(F.col(u) - F.col("cu")) / F.col("su"), (F.col(v) - F.col("cv")) / F.col("su")]
    weights = dict(zip(WEIGHTS, [F.lit(1.0), q[0], q[1], q[0] * q[0] + q[1] * q[1]], strict=True))
    sums = [F.sum(p[i] * p[j] * w).alias(f"m_{name}_{i}{j}") for name, w in weights.items() for i, j in PRODUCTS]
    return some.join(whole.select(*keys, x, y, u, v).join(some, keys).groupBy(*keys).agg(*sums), keys)


def _smallest(blocks: dict[str, np.ndarray]) -> np.ndarray | None:
    """The map of one key's sums, or None if they don't fix it."""
    one, u, v, w = (blocks[k] for k in WEIGHTS)
    none = np.zeros((3, 3))
    values, vectors = np.linalg.eigh(np.block([[one, none, -u], [none, one, -v], [-u, -v, w]]))
    return vectors[:, 0].reshape(3, 3) if values[1] > RANK * values[-1] else None


def _plain(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[float] | None:
    """The map between unscaled points, with 1 as its last number (or of norm 1 where that is 0)."""
    h = np.linalg.inv(b) @ h @ a
    return (h / (h[2, 2] if abs(h[2, 2]) > 1e-12 * np.abs(h).max() else np.linalg.norm(h))).ravel().tolist()


def solved(sums: DataFrame, keys: list[str], width: float | None = None, least: int = 4) -> DataFrame:
    """moments() with the map (nine numbers by rows) and, for a ``width``, the map of pairs whose x is width - x; NULL for fewer than ``least`` pairs or pairs on a line."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            maps: dict[str, list] = {"map": [], "mirrored": []}
            for r in pdf.to_dict("records"):
                blocks = {k: np.array([[r[f"m_{k}_{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)]) for k in WEIGHTS}
                a = np.array([[1 / r["sx"], 0, -r["cx"] / r["sx"]], [0, 1 / r["sx"], -r["cy"] / r["sx"]], [0, 0, 1]])
                b = np.array([[1 / r["su"], 0, -r["cu"] / r["su"]], [0, 1 / r["su"], -r["cv"] / r["su"]], [0, 0, 1]])
                h = _smallest(blocks) if r["n"] >= max(4, least) else None
                maps["map"].append(None if h is None else _plain(h, a, b))
                if h is None or width is None:
                    maps["mirrored"].append(None)
                    continue
                turn = np.diag([-1.0, 1.0, 1.0])  # mirrored points have their centre at width - cx
                turned = _smallest({k: turn @ m @ turn for k, m in blocks.items()})
                a[0] = [1 / r["sx"], 0, -(width - r["cx"]) / r["sx"]]
                maps["mirrored"].append(None if turned is None else _plain(turned, a, b))
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "n": pdf["n"], **maps})

    kinds = ", ".join(f"`{k}` {t}" for k, t in sums.select(*keys).dtypes)
    return sums.mapInPandas(fit, f"{kinds}, n long, map array<double>, mirrored array<double>")


def distance(h: str, x: str, y: str, u: str, v: str) -> Column:
    """How far a map (a column of nine numbers) lands from (u, v)."""
    p = homography([F.get(h, k) for k in range(9)], F.col(x), F.col(y))
    return F.hypot(p["x"] - F.col(u), p["y"] - F.col(v))


def fit_maps(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", u: str = "u", v: str = "v") -> DataFrame:
    """Per key n, the least-squares map from (x, y) to (u, v) and its RMSE; both NULL where four pairs off a line are missing."""
    found = solved(moments(pairs, keys, x, y, u, v), keys).drop("mirrored")
    off = pairs.dropna(subset=[x, y, u, v]).join(found.select(*keys, "map"), keys).groupBy(*keys).agg(F.sqrt(F.avg(F.pow(distance("map", x, y, u, v), 2))).alias("rmse"))
    return found.join(off, keys)


def check_orientation(clicked: DataFrame, matched: DataFrame, keys: list[str], width: float, least: int = 15, x: str = "x", y: str = "y", u: str = "u", v: str = "v") -> DataFrame:
    """Whether clicked pairs agree with independently matched ones as they are or with x mirrored about ``width``.

    Two maps are fitted per key, to the clicked pairs and to the mirrored ones, and each is held against
    the matched pairs: mean_err_as_clicked, mean_err_x_mirrored, n_validation_points, recommendation
    ("x_mirrored" only if that error is smaller), flagged.  With fewer than ``least`` matched pairs, or where the
    clicked pairs allow no fit, nothing is judged: errors are NULL and the recommendation stays "as_clicked",
    flagged.  Keys without clicked pairs, or without matched ones, are refused too.
    """
    maps = solved(moments(clicked, keys, x, y, u, v), keys, width).drop("n")
    every = clicked.select(*keys).union(matched.select(*keys)).distinct()
    errors = matched.dropna(subset=[x, y, u, v]).join(maps, keys, "left").groupBy(*keys).agg(
        F.count("*").alias("_n"), F.avg(distance("map", x, y, u, v)).alias("_a"), F.avg(distance("mirrored", x, y, u, v)).alias("_b")
    )
    found = every.join(errors, keys, "left").withColumn("n_validation_points", F.coalesce("_n", F.lit(0)))
    judged = (F.col("n_validation_points") >= least) & F.col("_a").isNotNull() & F.col("_b").isNotNull()
    turned = judged & (F.col("_b") < F.col("_a"))
    return found.select(
        *keys,
        F.when(judged, F.col("_a")).alias("mean_err_as_clicked"),
        F.when(judged, F.col("_b")).alias("mean_err_x_mirrored"),
        "n_validation_points",
        F.when(turned, "x_mirrored").otherwise("as_clicked").alias("recommendation"),
        (~judged | turned).alias("flagged"),
    )
