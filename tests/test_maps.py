"""Maps fitted to stored pairs against a direct solution, the orientation check, robust slopes and interval joins."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolane.operators import joins as J
from chronolane.operators import maps, slopes
from chronolane.operators.measure import project
from chronolane.operators.sampling import global_row_number

H = np.array([[1.2, 0.1, 5], [0.05, 0.9, -3], [1e-4, 2e-4, 1]])


def direct(src, dst):
    """The least-squares map from all equations at once, on points scaled by their spread."""

    def scaled(p):
        s = 1 / math.sqrt(p.var(axis=0).sum())
        return np.array([[s, 0, -s * p[:, 0].mean()], [0, s, -s * p[:, 1].mean()], [0, 0, 1]])

    a, b = scaled(src), scaled(dst)
    p, q = (np.c_[v, np.ones(len(v))] @ m.T for v, m in ((src, a), (dst, b)))
    rows = [r for (x, y, _), (u, v, _) in zip(p, q, strict=True) for r in ([-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v])]
    h = np.linalg.inv(b) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ a
    return h / h[2, 2]


def pairs(spark, groups):
    rows = [(k, float(x), float(y), float(u), float(v)) for k, (src, dst) in groups.items() for (x, y), (u, v) in zip(src, dst, strict=True)]
    return spark.createDataFrame(rows, "lane long, x double, y double, u double, v double").repartition(3)


def test_fit_maps(spark):
    rng = np.random.default_rng(3)
    src = rng.uniform(0, 300, (40, 2))
    noisy = project(H, src) + rng.normal(scale=0.5, size=(40, 2))
    corners = np.array([[0, 0], [100, 0], [100, 60], [0, 60.0]])
    line = np.c_[np.arange(9.0), 2 * np.arange(9.0)]
    groups = {1: (src, noisy), 2: (corners, project(H, corners)), 3: (corners[:3], corners[:3]), 4: (line, line), 5: (corners[[0, 0, 1, 1]], corners[[0, 0, 1, 1]])}
    df = pairs(spark, groups).unionByName(spark.createDataFrame([(1, None, 1.0, 1.0, 1.0), (6, None, None, None, None)], "lane long, x double, y double, u double, v double"))
    got = {r.lane: r for r in maps.fit_maps(df, ["lane"]).collect()}
    assert np.allclose(np.array(got[1].map).reshape(3, 3), direct(src, noisy), rtol=1e-6, atol=1e-8) and got[1].n == 40
    off = project(direct(src, noisy), src) - noisy
    assert got[1].rmse == pytest.approx(math.sqrt((off**2).sum(axis=1).mean()))
    assert np.allclose(np.array(got[2].map).reshape(3, 3), H, atol=1e-8) and got[2].rmse < 1e-8
    assert all(got[k].map is None and got[k].rmse is None for k in (3, 4, 5)) and 6 not in got
    assert maps.fit_maps(df.limit(0), ["lane"]).count() == 0


def test_check_orientation(spark):
    rng = np.random.default_rng(4)
    seen = rng.uniform(0, 300, (30, 2))
    true = project(H, seen)
    clicks = rng.uniform(0, 300, (8, 2))
    turned = np.c_[300 - clicks[:, 0], clicks[:, 1]]
    to = project(H, clicks) + rng.normal(scale=0.3, size=(8, 2))
    clicked = pairs(spark, {1: (clicks, to), 2: (turned, to), 3: (clicks, to), 4: (clicks[:3], to[:3]), 6: (clicks, to)})
    matched = pairs(spark, {1: (seen, true), 2: (seen, true), 3: (seen[:5], true[:5]), 4: (seen, true), 5: (seen, true)})
    got = {r.lane: r for r in maps.check_orientation(clicked, matched, ["lane"], 300.0).collect()}
    assert (got[1].recommendation, got[1].flagged, got[2].recommendation, got[2].flagged) == ("as_clicked", False, "x_mirrored", True)
    for lane, src in ((1, clicks), (2, turned)):
        for error, used in ((got[lane].mean_err_as_clicked, src), (got[lane].mean_err_x_mirrored, np.c_[300 - src[:, 0], src[:, 1]])):
            assert error == pytest.approx(np.linalg.norm(project(direct(used, to), seen) - true, axis=1).mean(), rel=1e-5)
    for lane, n in ((3, 5), (4, 30), (5, 30), (6, 0)):
        r = got[lane]
        assert (r.mean_err_as_clicked, r.mean_err_x_mirrored, r.n_validation_points, r.recommendation, r.flagged) == (None, None, n, "as_clicked", True)


# --- slopes ----------------------------------------------------------------------------------------


def all_slopes(t, y):
    i, j = np.triu_indices(len(t), 1)
    apart = t[j] != t[i]
    return np.sort((y[j] - y[i])[apart] / (t[j] - t[i])[apart])


@pytest.mark.parametrize("seed", range(12))
def test_selected_slopes_are_those_of_all_pairs(monkeypatch, seed):
    monkeypatch.setattr(slopes, "LISTED", 150)
    monkeypatch.setattr(slopes, "DRAWN", 300)
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 90))
    t = rng.integers(0, 40, n) / 4 if seed % 3 else rng.normal(size=n)
    y = rng.integers(0, 6, n) * 1.0 if seed % 2 else rng.normal(size=n) * 10
    want, found = all_slopes(t, y), slopes.Slopes(t, y)
    assert found.count == len(want)
    for k in {0, len(want) // 3, len(want) // 2, len(want) - 1} - {-1}:
        assert found.select(k) == pytest.approx(want[k], rel=1e-9, abs=1e-12)
    assert not len(want) or found.median() == pytest.approx(np.median(want), rel=1e-9, abs=1e-12)


def test_theil_sen_of_a_long_key_and_odd_ones(spark):
    n = 100_000
    t = np.arange(n) * 0.1
    y = t * 0.25 + np.random.default_rng(1).standard_cauchy(n)
    rows = spark.createDataFrame(pd.DataFrame({"lane": np.ones(n, np.int32), "t": t, "y": y}))
    other = spark.createDataFrame([(2, 1.0, 5.0), (2, 1.0, 7.0), (3, 0.0, 1.0), (3, 2.0, 5.0), (3, 2.0, None), (3, None, 9.0), (4, 0.0, 0.0)], "lane int, t double, y double")
    got = {r.lane: r for r in slopes.theil_sen(rows.unionByName(other), ["lane"], "t", "y").collect()}
    assert got[1].slope == pytest.approx(0.25, abs=1e-3) and (got[3].slope, got[3].intercept) == (2.0, 1.0) and set(got) == {1, 3}
    found = slopes.Slopes(t, y)
    below = found.inversions(found.between(found.order(-np.inf), found.order(got[1].slope)))
    assert abs(below - found.count / 2) <= 2  # half of five thousand million pairs


# --- intervals -------------------------------------------------------------------------------------


def intervals(rng, n, span, longest):
    start = rng.uniform(-span, span, n)
    return [(int(rng.integers(3)), int(k), float(s), float(s + d)) for k, (s, d) in enumerate(zip(start, rng.uniform(0, 1, n) ** 6 * longest, strict=True))]


def test_interval_joins_with_overlaps(spark):
    rng = np.random.default_rng(7)
    held = intervals(rng, 120, 500, 900) + [(0, 200, 5.0, 5.0), (0, 201, 9.0, 2.0), (1, 202, None, 4.0), (1, 203, 1.0, None), (2, 204, -3.0, 400.0), (2, 204, -3.0, 400.0), (None, 205, 0.0, 9.0)]
    points = [(int(k % 3), int(k), float(t)) for k, t in enumerate([*rng.uniform(-600, 1400, 400), 5.0, 5.0, *[s for _, _, s, _ in held[:40]], *[e for _, _, _, e in held[:40]]])]
    points += [(0, 900, None), (None, 901, 1.0), points[0]]
    b = spark.createDataFrame(held, "lane long, bout_index long, bout_start_sec double, bout_end_sec double").repartition(3)
    p = spark.createDataFrame(points, "lane long, frame long, t double").repartition(3)
    hits = [(f, i) for lane, f, t in points for own, i, s, e in held if lane is not None and lane == own and None not in (t, s, e) and s <= t <= e]
    got = J.frames_in_bouts(p, b, ["lane"], "t")
    assert sorted((r.frame, r.bout_index) for r in got.collect()) == sorted(hits)
    full = {i for _, i in hits}
    assert sorted(r.bout_index for r in J.nonempty_bouts(p, b, ["lane"], "t").collect()) == sorted(i for _, i, _, _ in held if i in full)
    inside = {f for f, _ in hits}
    assert sorted((r.frame, r.inside) for r in J.inside_any(p, b, ["lane"], "t", "inside").collect()) == sorted((f, f in inside) for _, f, _ in points)
    assert J.frames_in_bouts(p, b.limit(0), ["lane"], "t").count() == 0 and J.frames_in_bouts(p.limit(0), b, ["lane"], "t").count() == 0


def test_interval_join_looks_at_few_pairs_that_do_not_match(spark):
    seen = {}
    for n in (2_000, 16_000):
        p = spark.range(4 * n).select(F.lit(1).alias("lane"), (F.col("id") * 0.25).alias("t"))
        b = spark.range(n).select(F.lit(1).alias("lane"), F.col("id").alias("bout_index"), F.col("id").cast("double").alias("s"), (F.col("id") + 1 + F.col("id") % 7).cast("double").alias("e"))
        found = J.cell_pairs(p, b, ["lane"], "t", "s", "e")
        seen[n] = found.count(), found.filter("t BETWEEN s AND e").count()
    for looked, matched in seen.values():
        assert matched <= looked <= 1.5 * matched
    assert seen[16_000][0] / seen[2_000][0] == pytest.approx(8, rel=0.02)  # in proportion, on one key


def test_both_clocks_read_intervals_that_are_found_once(spark):
    made = spark.sparkContext.accumulator(0)

    def found(batches):
        for b in batches:
            made.add(len(b))
            yield b

    b = spark.createDataFrame([(1, 0, 0.0, 9.0), (1, 1, 20.0, 29.0), (2, 0, 0.0, 5.0)], "lane long, bout_index long, bout_start_sec double, bout_end_sec double")
    s = spark.range(160).select((1 + F.col("id") % 2).alias("lane"), F.floor(F.col("id") / 2).cast("double").alias("t"), F.col("id").cast("double").alias("x"))
    got = J.matched_medians(b.mapInPandas(found, b.schema), s, s.filter("t <> 35"), ["lane"], "t", "x", F.lit(30.0), 7).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 9.0, 10, 68.0, 9), (1, 1, 49.0, 10, 109.0, 10)]
    assert made.value == 3


def test_global_row_number(spark):
    rng = np.random.default_rng(2)
    values = [int(v) for v in rng.integers(0, 50, 500)] + [None]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v long, id long").repartition(7)
    out = global_row_number(df, [F.col("v").asc_nulls_last(), F.col("id")], "n")
    assert [(r.v, r.id) for r in sorted(out.collect(), key=lambda r: r.n)] == sorted(((v, k) for k, v in enumerate(values)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert sorted(r.n for r in out.collect()) == list(range(1, 502))
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    assert global_row_number(df.limit(0), [F.col("v")], "n").count() == 0
