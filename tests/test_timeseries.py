"""The time-by-treatment model against a dense computation and planted effects."""

import math

import numpy as np
import pytest

from chronolane.operators import timeseries as T


def planted(seed, slope_sd, units=30, sessions=4, points=12, session_sd=0.7):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for u in range(units):
        a, b = rng.normal(0, 1.5), rng.normal(0, slope_sd)
        for _ in range(sessions):
            treated, s = k % 2, rng.normal(0, session_sd)
            for t in np.linspace(-5, 5, points):
                rows.append((u, k, treated, t, 3 + a + s + (0.4 + b) * t + 1.0 * treated - 0.3 * t * treated + rng.normal(0, 0.5)))
            k += 1
    return rows


def crossed(rows):
    cross, unit = {}, {}
    for u, s, d, t, y in rows:
        w = np.array([1, t, d, t * d, y])
        cross[s] = cross.get(s, 0) + np.outer(w, w)
        unit[s] = u
    return np.array(list(cross.values())), np.array(list(unit.values()))


def dense(rows, theta, slope):
    """-2 log REML by the whole covariance matrix, and the coefficients."""
    u, s, d, t, y = map(np.array, zip(*rows))
    x = np.column_stack([np.ones(len(y)), t, d, t * d])
    v = np.eye(len(y)) + theta[0] ** 2 * (s[:, None] == s)
    if slope:
        root = np.array([[theta[1], 0], [theta[2], theta[3]]])
        z = np.column_stack([np.ones(len(y)), t])
        v += (u[:, None] == u) * (z @ root @ root.T @ z.T)
    else:
        v += theta[1] ** 2 * (u[:, None] == u)
    i = np.linalg.inv(v)
    a = x.T @ i @ x
    beta = np.linalg.solve(a, x.T @ i @ y)
    rss = (y - x @ beta) @ i @ (y - x @ beta)
    se = np.sqrt(rss / (len(y) - 4) * np.diag(np.linalg.inv(a)))
    return (len(y) - 4) * math.log(rss) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1], beta, se


@pytest.mark.parametrize("slope", [True, False])
def test_moments_give_the_fit_of_the_whole_covariance(slope):
    rows = planted(1, 0.2, units=8)
    got = T.nested_model(*crossed(rows), slope)
    best, beta, se = dense(rows, got["theta"], slope)
    assert got["beta"] == pytest.approx(beta, rel=1e-6) and got["se"] == pytest.approx(se, rel=1e-6)
    for k in range(len(got["theta"])):  # no better place beside it
        for step in (-0.05, 0.05):
            assert dense(rows, got["theta"] + step * np.eye(len(got["theta"]))[k], slope)[0] >= best - 1e-6


SCHEMA = "g string, unit long, session long, treatment string, time double, value double"


def frame(spark, rows, g="a"):
    return spark.createDataFrame([(g, u, s, "A" if d else "R", float(t) + 100, float(y)) for u, s, d, t, y in rows], SCHEMA)


def fitted(df):
    return {r.term: r for r in T.timeseries_model(df, "treatment", "R", "unit", "session", {"g": "string"}, 100.0).collect()}


def test_planted_effects_are_found(spark):
    got = fitted(frame(spark, planted(2, 0.2)))
    for term, want in (("time", 0.4), ("treatment", 1.0), ("time x treatment", -0.3)):
        assert abs(got[term].estimate - want) < 4 * got[term].se and got[term].random == "slope" and got[term].note == ""


def test_without_a_slope_the_intercept_model_takes_over(spark):
    # one slope for all units, and exactly so: the random slope has no variance
    rows = [(u, s, d, t, round(3 + u % 5 + (s % 3) + 0.4 * t + (1 if (round(t * 10) % 2) else -1) * 0.3, 6)) for u, s, d, t, _ in planted(3, 0.0)]
    got = fitted(frame(spark, rows))
    assert {r.random for r in got.values()} == {"intercept"} and abs(got["time"].estimate - 0.4) < 0.05


def test_nothing_to_fit(spark):
    rows = [r for r in planted(4, 0.1) if r[2] == 0]
    got = fitted(frame(spark, rows))
    assert list(got) == ["not fitted"] and got["not fitted"].n == len(rows) and got["not fitted"].estimate is None
    assert fitted(spark.createDataFrame([], SCHEMA)) == {}
    nulls = spark.createDataFrame([("a", None, 1, "R", 1.0, 1.0), ("a", 1, 1, None, 1.0, 1.0), ("a", 1, 1, "R", None, 1.0)], SCHEMA)
    assert fitted(nulls) == {}


def test_bins_are_named_by_their_middle(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 0.9, 4.0), (1, 1.0, 7.0), (1, 1.5, None)], "k long, e double, v double")
    got = T.binned_means(df, ["k"], "e", "v", 1.0).orderBy("time").collect()
    assert [tuple(r) for r in got] == [(1, 0.5, 3.0, 2), (1, 1.5, 7.0, 1)]


def test_a_large_group_is_fitted_in_passes(spark, monkeypatch):
    """The groups above local_units never come into one task, and get the same models."""
    df = frame(spark, planted(5, 0.2)).union(frame(spark, planted(6, 0.0, units=12), "b")).union(frame(spark, [r for r in planted(4, 0.1, units=25) if r[2] == 0], "c")).repartition(5)
    model = lambda n: {(r.g, r.term): r for r in T.timeseries_model(df, "treatment", "R", "unit", "session", {"g": "string"}, 100.0, n).collect()}
    want, passes, real = model(1000), [], T._pass
    monkeypatch.setattr(T, "_pass", lambda units, asked: passes.append(sorted(asked)) or real(units, asked))
    assert all(r.random for k, r in want.items() if k[0] != "c") and len(want) == 7 and not passes
    got = model(20)
    assert passes and set(map(tuple, passes)) == {(0,)} and got.keys() == want.keys()  # a alone: c can't be fitted, b is small
    for k, r in want.items():
        assert (got[k].n, got[k].random, got[k].note) == (r.n, r.random, r.note)
        assert r.estimate is None or (got[k].estimate, got[k].se) == pytest.approx((r.estimate, r.se), rel=1e-6)
