"""Operators on small fixtures with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolane.operators import aggregates as A
from chronolane.operators import columns as C
from chronolane.operators import images as I
from chronolane.operators import joins as J
from chronolane.operators import models as M
from chronolane.operators import sampling as S
from chronolane.operators import windows as W
from chronolane.operators.greedy import GateRule, gate_reading


def sequence(spark, pattern, rate=9.0):
    """(state, seconds) expanded at a sampling rate, as rows of lane 1."""
    states = [s for s, sec in pattern for _ in range(round(sec * rate))]
    return spark.createDataFrame([(1, k, k / rate, s) for k, s in enumerate(states)], "lane long, frame long, t double, state string")


S_, U, MV = "stationary", "unknown", "moving"


@pytest.mark.parametrize(
    "pattern, least, gap, unknown, count",
    [
        ([(MV, 10), (S_, 30), (MV, 10)], 5, 2, None, 1),
        ([(MV, 5), (S_, 3), (MV, 5)], 5, 2, None, 0),
        ([(S_, 10), (MV, 1.5), (S_, 10)], 5, 2, None, 1),
        ([(S_, 10), (MV, 5), (S_, 10)], 5, 2, None, 2),
        ([(S_, 8), (MV, 5), (S_, 12), (MV, 5), (S_, 6)], 5, 2, None, 3),
        ([(S_, 10), (U, 4), (S_, 10)], 5, 2, 10, 1),
        ([(S_, 10), (MV, 3), (S_, 10)], 5, 2, 10, 2),
        ([(S_, 10), (U, 2), (MV, 0.12), (U, 2), (S_, 10)], 5, 2, 10, 2),
        ([(S_, 10), (U, 15), (S_, 10)], 5, 2, 10, 2),
        ([(MV, 5)], 5, 2, None, 0),
    ],
)
def test_islands(spark, pattern, least, gap, unknown, count):
    found = W.islands(sequence(spark, pattern), "t", "state", ["lane"], ["frame"], least, gap, unknown).collect()
    assert len(found) == count
    assert [r.bout_index for r in sorted(found, key=lambda r: r.bout_index)] == list(range(count))


def test_island_duration_is_last_minus_first(spark):
    (one,) = W.islands(sequence(spark, [(S_, 10)]), "t", "state", ["lane"], ["frame"], 5, 2).collect()
    assert one.bout_duration_sec == pytest.approx(89 / 9) and one.n_samples == 90


def entry_of(spark, states, sustained, intrusion):
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate(states)], "lane long, frame long, state string")
    return W.entry_index(df, "state", ["lane"], ["frame"], sustained, intrusion).first().entry


@pytest.mark.parametrize("text, sustained, intrusion, want", [("eeiimmm", 3, 2, 4), ("mmmmm", 3, 1, None), ("iimemmm", 3, 2, 4), ("iimmm", 3, 3, None), ("iimmimmm", 3, 1, 5), ("immm", 3, 1, 1)])
def test_entry(spark, text, sustained, intrusion, want):
    names = {"e": "empty", "m": "mouse", "i": "intrusion"}
    assert entry_of(spark, [names[c] for c in text], sustained, intrusion) == want


def test_entry_equals_a_sequential_machine(spark):
    rng = np.random.default_rng(5)
    lanes = {k: rng.choice(["empty", "mouse", "intrusion"], rng.integers(1, 25)).tolist() for k in range(60)}
    df = spark.createDataFrame([(k, i, s) for k, v in lanes.items() for i, s in enumerate(v)], "lane long, frame long, state string")

    def machine(states):
        run = streak = 0
        seen = False
        for i, s in enumerate(states):
            run = run + 1 if s == "intrusion" else 0
            seen = seen or run >= 2
            streak = streak + 1 if s == "mouse" and seen else 0
            if streak >= 2:
                return i - 1
        return None

    got = {r.lane: r.entry for r in W.entry_index(df, "state", ["lane"], ["frame"], 2, 2).collect()}
    assert got == {k: machine(v) for k, v in lanes.items()}


def test_rolling_statistics_skip_nulls_like_a_filtered_series(spark):
    rng = np.random.default_rng(1)
    x = [None if rng.random() < 0.3 else float(v) for v in rng.normal(size=40)]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(x)], "lane long, frame long, x double")
    out = W.roll_dispersion(W.roll_median_valid(df, "x", "m", ["lane"], ["frame"], 6), "x", "d", ["lane"], ["frame"], 6).toPandas().sort_values("frame")
    s = pd.Series(x, dtype=float).dropna()
    med = s.rolling(6, center=True, min_periods=1).median().reindex(range(40))
    mad = s.rolling(6, center=True, min_periods=3).apply(lambda v: np.median(np.abs(v - np.median(v)))).reindex(range(40))
    np.testing.assert_allclose(out.m.to_numpy(float), med.to_numpy(), equal_nan=True)
    np.testing.assert_allclose(out.d.to_numpy(float), mad.to_numpy(), equal_nan=True)


def test_velocity_is_null_at_and_after_invalid_rows(spark):
    rows = [(1, k, k / 9, None if k in (3, 4) else float(k)) for k in range(8)]
    out = W.velocity(spark.createDataFrame(rows, "lane long, frame long, t double, x double"), "t", "x", None, ["lane"], ["frame"]).orderBy("frame").collect()
    assert [r.velocity is None for r in out] == [True, False, False, True, True, True, False, False]


def test_asof_nearest_ties_go_to_the_earlier_row(spark):
    left = spark.createDataFrame([(1, 3.0), (1, 4.5), (1, 99.0), (2, 1.0), (3, 1.0)], "lane long, t double")
    right = spark.createDataFrame([(1, 4.0, 14), (1, 5.0, 15), (1, 2.5, 12), (2, 1.5, 21), (2, None, 5)], "lane long, t double, v long")
    got = {(r.lane, r.t): r.v for r in J.asof_nearest(left, right, ["lane"], "t", ["v"], 0.5).collect()}
    assert got == {(1, 3.0): 12, (1, 4.5): 14, (1, 99.0): None, (2, 1.0): 21, (3, 1.0): None}


def test_resolve_statuses(spark):
    files = spark.createDataFrame([("a", "F", "1"), ("b", "F", "2"), ("c", "F", "3"), ("d", "F", "4"), ("e", "F", "5")], "stem string, lane string, token string")
    lut = spark.createDataFrame([("a", "F", "9", "x"), ("b", "F", "9", "y"), ("b", "F", "9", "z"), ("q", "F", "3", "w"), ("r", "F", "4", "u"), ("s", "F", "4", "v")], "stem string, lane string, token string, virus string")
    keys = lambda *n: ([F.col(c) for c in n], [F.col(c) for c in n])
    got = {r.stem: (r.status, r.meta and r.meta.virus) for r in J.resolve(files, lut, keys("stem", "lane"), keys("token", "lane")).collect()}
    assert got == {"a": ("matched_exact", "x"), "b": ("ambiguous_exact", None), "c": ("matched_token", "w"), "d": ("ambiguous_token", None), "e": ("unmatched", None)}


def test_strict_left_and_guard_raise(spark):
    facts = spark.createDataFrame([(1,), (2,)], "k long")
    with pytest.raises(Exception, match="no lookup row"):
        J.strict_left(facts, facts.filter("k = 1").withColumn("v", F.lit(1)), ["k"]).collect()
    with pytest.raises(Exception, match="duplicate key"):
        J.guard_unique(facts.union(facts), ["k"]).collect()


def test_names(spark):
    df = spark.createDataFrame([("07-28-25_4540_B_4541_F_Test3-004_Front.seq",), ("x_back_tracking.csv",), ("plain.csv",)], "name string")
    got = [(r.p.stem, r.p.lane) for r in df.select(C.stem_and_lane(F.col("name")).alias("p")).collect()]
    assert got == [("07-28-25_4540_B_4541_F_Test3-004", "F"), ("x", "B"), ("plain", "")]
    stem = spark.createDataFrame([("4540_B_4541_F_Test3",), ("07_4540_B",)], "s string")
    assert [r.m for r in stem.select(C.lane_tokens(F.col("s")).alias("m")).collect()] == [{}, {"B": "4540"}]
    assert stem.select(C.lane_tokens(F.col("s"), strict=False).alias("m")).first().m == {"B": "4540", "F": "4541"}


def test_gates(spark):
    df = spark.createDataFrame([(None, 0.2, True, True, None), (0.1, 0.9, False, True, False), (-0.5, 0.9, True, True, True)], "d double, c double, s boolean, h boolean, p boolean")
    got = [r.r for r in df.select(C.gate(F.col("d"), F.col("c"), F.col("s"), F.col("h"), F.col("p")).alias("r")).collect()]
    assert [len(r) for r in got] == [2, 3, 0]


def test_paired_t(spark):
    a, b = [28.5, 24.5, 24.1, 23.4], [27.4, 27.0, 24.1, 24.0]
    rows = [(k, "v", c, x) for k in range(4) for c, x in (("A", a[k]), ("R", b[k]))]
    df = spark.createDataFrame(rows, "mouse long, virus string, injection string, y double")
    r = M.with_p_values(A.paired_moments(df, "y", ["mouse"], ["virus"], "injection", "A", "R")).first()
    d = np.array(a) - np.array(b)
    u = abs(r.t) / 3**0.5  # the closed form for three degrees of freedom
    p = 1 - 2 / np.pi * (u / (1 + u * u) + np.arctan(u))
    assert r.t == pytest.approx(d.mean() / (d.std(ddof=1) / 2)) and r.p == pytest.approx(p) and r.ci_lower < r.mean_diff < r.ci_upper
    one = M.with_p_values(A.paired_moments(df.filter("mouse = 0"), "y", ["mouse"], ["virus"], "injection", "A", "R")).first()
    assert one.n == 1 and one.p is None and one.ci_lower is None


def test_t_distribution():
    assert M.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert M.t_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-5)


def test_lag_and_trajectory(spark):
    t = np.arange(0, 400, 0.5)
    x = 60 * np.sin(t / 7) + 40 * np.sin(t / 31) + 200
    lanes = spark.createDataFrame([(1, (t * 10).tolist(), x.tolist(), (t - 2.8).tolist(), x.tolist())], "lane long, frames array<double>, x array<double>, t array<double>, tx array<double>")
    r = M.trajectory_sync(lanes, reach=20.0, drift=0.005, outlier=1.0, least=100, apart=5.0).first()
    assert r.camera_fps == 10 and r.offset_sec == pytest.approx(-2.8, abs=0.3) and abs(r.drift_slope) < 0.002


def through(rule, readings):
    memory, short, out = [], 0, []
    for core, body in readings:
        reference, memory, short = gate_reading(rule, memory, short, core, body)
        out.append(reference)
    return out


def test_temperature_gate():
    rule = GateRule(5, 9, 3, 4)
    assert through(rule, [(v, v) for v in (30, 31, 30, 20, 20, 20, 20, 20)]) == [None] * 3 + [30] * 4 + [None]  # four in a row cleared the memory
    # the core is judged, the body remembered: a cool body with a warm core passes, and lowers the reference
    assert through(rule, [(31, 30), (31, 30), (31, 30), (26, 12), (24, 24)]) == [None] * 4 + [30]
    assert through(rule, [(31, 30)] * 3 + [(20, 20), (31, None), (20, 20), (20, 20), (20, 20), (0, 0)]) == [None] * 3 + [30, None, 30, 30, 30, None]  # no body: the streak goes on


def test_asof_is_linear_in_a_key(spark):
    """Twice the rows of one key don't take four times as long."""
    import time

    def seconds(n):
        left = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 1.0).alias("t"))
        right = spark.range(n // 2).select(F.lit(1).alias("k"), (F.col("id") * 2.0 + 0.4).alias("t"), F.col("id").alias("v"))
        start = time.time()
        got = J.asof_nearest(left, right, ["k"], "t", ["v"], 5.0).agg(F.count("v"), F.sum("v")).first()
        assert got[0] == n
        return time.time() - start

    seconds(1000)
    assert seconds(80_000) < 8


def test_sampling(spark):
    assert S.spread_positions(10, 4) == [0, 3, 6, 9] and S.spread_positions(3, 5) == [0, 1, 2]
    df = spark.createDataFrame([(k, k % 3, k % 7 == 0, "abc"[k % 3]) for k in range(300)], "id long, session long, nest boolean, zone string")
    got = S.stratified(df, "session", "zone", "nest", "id", 12, {"a": 0.5, "b": 0.3, "c": 0.2}).toPandas()
    assert (got.groupby("session").size() == 12).all() and (got.groupby("session").nest.sum() >= 4).all()
    again = S.stratified(df.repartition(9), "session", "zone", "nest", "id", 12, {"a": 0.5, "b": 0.3, "c": 0.2}).toPandas()
    assert set(got.id) == set(again.id)


def test_blob_and_track():
    bg = np.full((40, 80), 100.0)
    frames = []
    for k in range(10):
        f = bg.copy()
        f[I.disk(f.shape, 10 + 4 * k, 20, 5)] = 180
        frames.append(f)
    rows = list(I.track(enumerate(frames), bg, least=20, most=500))
    assert [r["flag"] for r in rows] == ["ok"] * 10
    assert np.allclose([r["x"] for r in rows], [10 + 4 * k for k in range(10)], atol=0.6)
    assert I.deepest(I.disk((20, 20), 10, 9, 6), 3) == (10, 9)
    assert I.best_shift(frames[0], I._moved(frames[0], 2, -1), 3) == (-2, 1)


def test_skeleton():
    line = {(5, x) for x in range(20)} | {(4, 10), (3, 10)}
    assert len(I.skeleton_path(line)) == 20 and (3, 10) not in I.pruned(line, 4)


def test_missing_columns_are_named(spark):
    from chronolane.schema import require_columns

    with pytest.raises(ValueError, match="velocity, flag"):
        require_columns(spark.range(1), "id", "velocity", "flag")
