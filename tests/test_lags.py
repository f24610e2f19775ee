"""Lags against the correlation of whole traces, and the distance transform against all pairs of pixels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolane.operators import images as I
from chronolane.operators import lags

COLUMNS = "lane long, t double, a double, b double"


def by_hand(rows, dt):
    """The lag of b after a from the correlation of the whole traces on one grid; None where there is none."""
    a = sorted((t, x) for t, x, _ in rows if x is not None)
    b = sorted((t, y) for t, _, y in rows if y is not None)
    if not a or not b:
        return None
    (at, av), (bt, bv) = (np.array(s).T for s in (a, b))
    lo, hi = max(at[0], bt[0]), min(at[-1], bt[-1])
    if hi - lo < 4 * dt:
        return None
    grid = np.arange(lo, hi, dt)
    x, y = np.interp(grid, at, av), np.interp(grid, bt, bv)
    x, y = x - x.mean(), y - y.mean()
    if np.allclose(x, 0) or np.allclose(y, 0):
        return None
    c = np.correlate(y, x, "full")
    k = int(np.argmax(c))
    bend = 0.0
    if 0 < k < len(c) - 1 and (curve := c[k - 1] - 2 * c[k] + c[k + 1]):
        bend = 0.5 * (c[k - 1] - c[k + 1]) / curve
    return (k - (len(x) - 1) + bend) * dt


def traces(seed):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 200, 160))
    x = 5 * np.sin(t / 7) + 3 * np.sin(t / 2.3 + 1) + rng.normal(scale=0.2, size=len(t))
    late = rng.uniform(-20, 20)
    return [(float(u), float(v), None) for u, v in zip(t, x, strict=True)] + [(float(u + late), None, float(v)) for u, v in zip(t, x, strict=True)]


@pytest.mark.parametrize("block", [16, 100, 4096])
def test_lags_are_those_of_whole_traces(spark, block):
    groups = {k: traces(k) for k in range(6)}
    groups[6] = [(float(k), 1.0, None) for k in range(50)] + [(float(k), None, float(k % 7)) for k in range(50)]  # constant
    groups[7] = [(float(k), float(k), None) for k in range(9)] + [(float(k + 8), None, float(k)) for k in range(9)]  # hardly overlaps
    groups[8] = [(1.0, 2.0, None)]
    df = spark.createDataFrame([(k, *r) for k, rows in groups.items() for r in rows], COLUMNS).repartition(4)
    got = {r.lane: r.lag_sec for r in lags.cross_lag(df, ["lane"], "t", "a", "b", 0.5, block).collect()}
    want = {k: by_hand(rows, 0.5) for k, rows in groups.items()}
    assert set(got) == set(want) and all(got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    assert sum(v is not None for v in want.values()) == 6
    assert lags.cross_lag(df.limit(0), ["lane"], "t", "a", "b", 0.5).count() == 0


def test_no_trace_is_in_one_place(spark):
    n = 30_000
    one = spark.createDataFrame(pd.DataFrame({"lane": 1, "t": np.arange(n) * 1.0, "a": np.random.default_rng(1).normal(size=n)}))
    nothing = F.lit(None).cast("double")
    df = one.withColumn("b", nothing).unionByName(one.select("lane", (F.col("t") + 123).alias("t"), nothing.alias("a"), F.col("a").alias("b")))
    grid = lags.common_grid(df, ["lane"], "t", "a", "b", 1.0)
    sums = lags.correlogram(grid, ["lane"], 1024)
    assert max(len(r._s) for r in grid.groupBy("lane", F.floor(F.col("_i") / 1024)).agg(F.collect_list("_i").alias("_s")).collect()) <= 1024
    assert sums.count() <= 2 * n and lags.cross_lag(df, ["lane"], "t", "a", "b", 1.0, 1024).first().lag_sec == pytest.approx(123, abs=0.5)


def test_windowed_and_edge_lags(spark):
    groups = {k: traces(k) for k in range(3)}
    df = spark.createDataFrame([(k, *r) for k, rows in groups.items() for r in rows], COLUMNS).repartition(4)
    for r in lags.windowed_lag(df, ["lane"], "t", "a", "b", 0.5).collect():
        rows = groups[r.lane]
        lo, hi = min(t for t, *_ in rows), max(t for t, *_ in rows)
        found = []
        for w in range(5):
            start = lo + w * 0.7 / 4 * (hi - lo)
            lag = by_hand([x for x in rows if start <= x[0] <= start + 0.3 * (hi - lo)], 0.5)
            found += [(start + 0.15 * (hi - lo), lag)] if lag is not None else []
        slope, offset = np.polyfit(*np.array(found).T, 1)
        assert (r.n, r.drift_slope, r.offset_sec) == (len(found), pytest.approx(slope, abs=1e-6), pytest.approx(offset, abs=1e-4))
    edges = spark.createDataFrame([(k, i, 40.0 + 30 * i) for k in range(3) for i in range(4)], "lane long, bout_index long, bout_start_sec double")
    for r in lags.edge_lag(df, edges, ["lane"], "t", "a", "b", 0.5, 25.0, 2.0).collect():
        found = []
        for edge in (40.0, 70.0, 100.0, 130.0):
            near = [(t, a, None) for t, a, _ in groups[r.lane] if a is not None and abs(t - edge) <= 25] + [(t - 2, None, b) for t, _, b in groups[r.lane] if b is not None and abs(t - 2 - edge) <= 25]
            lag = by_hand(near, 0.5)
            found += [(edge, lag + 2)] if lag is not None else []
        slope, offset = np.polyfit(*np.array(found).T, 1)
        assert (r.n, r.drift_slope, r.offset_sec) == (len(found), pytest.approx(slope, abs=1e-6), pytest.approx(offset, abs=1e-4))


def test_deepest_pixel_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(9)
    masks = [rng.random((h, w)) < p for h, w in ((6, 9), (8, 8), (1, 7), (7, 1), (12, 10)) for p in (0.0, 0.5, 0.9, 0.97, 1.0)]
    for w in {m.shape[1] for m in masks}:
        some = [m for m in masks if m.shape[1] == w]
        df = spark.createDataFrame([(k, m.ravel().tolist()) for k, m in enumerate(some)], "k long, m array<boolean>")
        got = df.select("k", *[I.deepest_pixel(F.col("m"), w, 1.5, pad).alias(f"p{pad}") for pad in (False, True)]).collect()
        for r in got:
            for pad in (False, True):
                want = I.deepest(some[r.k], 1.5, pad)
                assert (r[f"p{pad}"] and tuple(r[f"p{pad}"])) == want, (some[r.k], pad)


def test_sparse_traces_travel_as_samples(spark, monkeypatch):
    """A grid of many steps between few samples is neither stored nor shuffled, whether it is one block or several."""
    groups = {k: traces(k) for k in range(4)}
    df = spark.createDataFrame([(k, *r) for k, rows in groups.items() for r in rows], COLUMNS).repartition(4)
    seen, real = {}, lags.stored
    monkeypatch.setattr(lags, "stored", lambda rows, name: seen.setdefault(name, real(rows, name)))
    for block in (64, 4096):
        seen.clear()
        got = {r.lane: r.lag_sec for r in lags.cross_lag(df, ["lane"], "t", "a", "b", 0.05, block).collect()}
        assert all(got[k] == pytest.approx(by_hand(rows, 0.05), abs=1e-6) for k, rows in groups.items())
        samples = sum(map(len, groups.values()))
        steps = sum(r._n for r in seen["blocks"].select("_k", "_n").distinct().collect())
        segments = seen["blocks"].select(F.sum(F.size("_g"))).first()[0]
        assert "grid" not in seen and steps > 10 * samples and segments <= samples + 3 * 2 * seen["blocks"].count()
