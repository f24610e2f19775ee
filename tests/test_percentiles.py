"""Percentiles of groups that no task holds against those of whole groups."""

import inspect
import math

import numpy as np
import pytest

from chronolane.operators import aggregates as A
from chronolane.operators import models as M

SHARES = {"q1": 0.25, "median": 0.5, "p90": 0.9, "low": 0.0, "high": 1.0}


def test_percentiles_are_those_of_whole_groups(spark):
    rng = np.random.default_rng(3)
    groups = {
        "many": np.round(rng.exponential(50, 3000), 1),
        "far": np.array([*rng.normal(size=500), 1e300]),  # all but one value in one stretch
        "flat": np.full(7, 2.5),
        "two": np.array([1.0, 4.0]),
        "one": np.array([-3.0]),
        None: np.arange(10.0),
    }
    rows = [(k, float(v)) for k, g in groups.items() for v in g] + [("none", None), ("two", None)]
    df = spark.createDataFrame(rows, "v string, y double").repartition(3)
    got = {r.v: r for r in A.exact_percentiles(df, "y", ["v"], SHARES).collect()}
    assert set(got) == set(groups)
    for k, g in groups.items():
        assert got[k].n == len(g) and [got[k][c] for c in SHARES] == pytest.approx(np.percentile(g, [100 * p for p in SHARES.values()]).tolist(), rel=1e-12)
    whole = A.exact_percentiles(df.filter("v = 'many'"), "y", [], SHARES).first()
    assert whole.n == 3000 and whole.median == got["many"].median
    odd = spark.createDataFrame([(math.inf,), (1.0,), (2.0,), (math.nan,), (3.0,)], "y double")
    assert A.exact_percentiles(odd, "y", [], {"m": 0.5}).first().m == 3.0  # NaN is the largest


def test_box_of_a_group_without_values(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(9)] + [("a", 99.0), ("b", None)], "v string, y double")
    got = {r.v: tuple(r)[1:] for r in A.boxplot(df, "y", ["v"]).select("v", "n", "q1", "median", "q3", "low", "high").collect()}
    assert got == {"a": (10, 2.25, 4.5, 6.75, 0.0, 8.0), "b": (0, None, None, None, None, None)}


def test_spread_around_the_median_without_whole_groups():
    for f in (A.boxplot, M.levene):
        assert "percentile(" not in inspect.getsource(f) and "Window" not in inspect.getsource(f)
