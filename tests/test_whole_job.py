"""Registered queries answer for the whole of their tables, not for a prefix, a few keys or a smaller search."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolane.plans.catalogue import QUERIES
from chronolane.plans.registry import load

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_trajectory_sync_finds_the_clock_of_every_lane(spark):
    held = {r.user_id for r in load(spark, SF, "events").groupBy("user_id").count().filter("count >= 30").collect()}
    got = {r.lane: r for r in QUERIES["m_trajectory_sync"](spark, SF).collect()}
    assert len(held) > 4 and held <= set(got)
    # the loss is flat within the outlier limit, so the fine search may stop a little beside the clock
    assert all(r.camera_fps == 8.0 and abs(r.offset_sec - 5.5) < 1.0 and abs(r.drift_slope) < 0.0025 for r in got.values())


def test_trajectory_sync_searches_the_default_ranges(spark, monkeypatch):
    from chronolane.plans import model_queries

    asked = {}
    monkeypatch.setattr(model_queries.M, "trajectory_sync", lambda lanes, **k: asked.update(k) or lanes)
    QUERIES["m_trajectory_sync"](spark, SF)
    assert not {"reach", "drift", "rates"} & set(asked)


def test_stream_bouts_gives_every_bout_of_the_batch_form(spark):
    got = QUERIES["stream_bouts"](spark, SF).collect()
    want = QUERIES["w_bout_islands"](spark, SF).collect()
    assert sorted((r[0], round(r[1], 6), round(r[2], 6)) for r in got) == sorted((r.lane, r.bout_start_sec, r.bout_end_sec) for r in want)


def test_stream_activity_gives_every_window_of_the_batch_form(spark):
    rows = load(spark, SF, "events")
    want = rows.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day")["start"].alias("start"), F.col("user_id").alias("lane")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    key = lambda r: (str(r.start), r.lane, r.n, round(r.total, 6))
    assert sorted(map(key, QUERIES["stream_activity"](spark, SF).collect())) == sorted(map(key, want.collect()))


def test_bout_edge_lag_takes_the_starts_of_bouts(spark, monkeypatch):
    from chronolane.plans import model_queries

    asked = []
    real = model_queries.lags.edge_lag
    monkeypatch.setattr(model_queries.lags, "edge_lag", lambda df, edges, *a: asked.append(edges) or real(df, edges, *a))
    got = {r.lane: r for r in QUERIES["m_bout_edge_lag"](spark, SF).collect()}
    bouts = QUERIES["w_bout_islands"](spark, SF).collect()
    assert sorted((r.lane, r.bout_index, round(r.bout_start_sec * 3600 + model_queries.T0, 3)) for r in asked[0].collect()) == sorted((r.lane, r.bout_index, round(r.bout_start_sec, 3)) for r in bouts)
    count = {lane: sum(b.lane == lane for b in bouts) for lane in {b.lane for b in bouts}}
    assert set(got) == {lane for lane, n in count.items() if n >= 2}
    assert all(r.n == count[lane] and abs(r.offset_sec - 3) < 0.5 for lane, r in got.items())


def test_greedy_bouts_with_gap_take_all_rows(spark):
    rows = sorted((r.user_id, r.ts.timestamp(), r.event_id, r.value, json.loads(r.props)["k"]) for r in load(spark, SF, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value", "props").collect())
    want, held, before = [], [], None
    for lane, t, _, x, y in [*rows, (None, 0.0, 0, 0.0, 999)]:
        day = int(t // 86400)
        ended = before is not None and (before[0] != lane or day - before[1] > 1)
        xs = [h[2] for h in held]
        if held and (ended or y > 80 or max(*xs, x) - min(*xs, x) > 120):
            if held[-1][0] - held[0][0] >= 21600:
                want.append((before[0], held[0][1], held[-1][1]))
            held = []
        if y <= 80:
            held.append((t, day, x))
        before = (lane, day)
    got = QUERIES["w_greedy_range_bouts_gap"](spark, SF).collect()
    assert sorted((r.lane, r.first, r.last) for r in got) == sorted(want)
    assert {r.lane for r in got} == {lane for lane, _, _ in want} and min(r.bout_index for r in got) == 0


def test_a_jump_of_the_position_ends_a_greedy_bout(spark):
    from chronolane.operators import greedy as G

    df = spark.createDataFrame([(1, p, float(p), 0.0, 0.0) for p in (0, 1, 2, 5, 6, 7, 8)], "lane long, pos long, t double, x double, y double")
    found = G.range_bouts(df, {"lane": "long"}, "pos", "t", "x", "y", ["t"], 1.0, 10.0, 2.0, gap=1).collect()
    assert [tuple(r) for r in found] == [(1, 0, 0, 2, 2.0), (1, 1, 5, 8, 3.0)]


def test_jittered_sample_spreads_over_the_whole_table(spark, tmp_path):
    ids = spark.range(0, 90_000, 3).select(F.col("id").alias("event_id"))  # 30000 rows, ids with gaps
    ids.write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(r.event_id // 3 for r in QUERIES["s_linspace_jitter"](spark, str(tmp_path)).collect())
    assert len(got) == 50 and all(abs(p - k * 29_999 / 49) <= 3 for k, p in enumerate(got))


def test_every_written_lane_is_read_back(spark):
    got = {r.lane: r.n for r in QUERIES["sink_partition_by_lane"](spark, SF).collect()}
    assert len(got) > 5 and got == {r.user_id: r["count"] for r in load(spark, SF, "events").groupBy("user_id").count().collect()}


def test_stretch_takes_the_whole_frame(spark):
    e = {r.vec_id: np.array(r.embedding, float) for r in load(spark, SF, "embeddings").limit(20).collect()}
    got = {}
    for r in QUERIES["p_stretch_uint8"](spark, SF).filter(F.col("vec_id").isin(list(e))).collect():
        got.setdefault(r.vec_id, {})[r.i] = r.v
    for k, a in e.items():
        assert len(a) > 8 and [got[k][i + 1] for i in range(len(a))] == np.floor((a - a.min()) * 255.0 / (a.max() - a.min())).tolist()


def test_paths_are_built_from_all_rows_of_a_label(spark):
    paths, hot = {}, {}
    for r in load(spark, SF, "embeddings").orderBy("vec_id").collect():
        paths.setdefault(r.label, []).append((r.vec_id % 8, r.vec_id // 8 % 8))
        hot.setdefault(r.label, []).append(np.array(r.embedding, float).reshape(8, 8))
    y, x = np.mgrid[:8, :8]
    nearest = {(r.label, r.px, r.py): r.nearest for r in QUERIES["i_nearest_path"](spark, SF).collect()}
    curve = {r.label: r.curve for r in QUERIES["i_curve_max_percentile"](spark, SF).collect()}
    for k, p in paths.items():
        top = np.max(hot[k], axis=0)
        assert curve[k] == pytest.approx(np.percentile([top[(x - a) ** 2 + (y - b) ** 2 <= 2.25].max() for a, b in p], 90))
        for a in range(8):
            for b in range(8):
                assert nearest[k, a, b] == 1 + min(range(len(p)), key=lambda i: ((p[i][0] - a) ** 2 + (p[i][1] - b) ** 2, i))
    assert max(nearest.values()) > 5


def test_resampling_covers_each_trace(spark):
    from chronolane.plans.model_queries import timed

    got, traces = {}, {}
    for r in QUERIES["m_resample_grid"](spark, SF).collect():
        got.setdefault(r.lane, {})[r.g] = r.v
    for r in timed(spark, SF).orderBy("h", "frame").collect():
        traces.setdefault(r.lane, []).append((r.h, r.x))
    for lane, trace in traces.items():
        h, x = np.array(trace).T
        grid = np.arange(np.ceil(h[0] / 24), np.floor(h[-1] / 24) + 1) * 24
        assert sorted(got[lane]) == grid.tolist() and [got[lane][g] for g in grid] == pytest.approx(np.interp(grid, h, x).tolist(), abs=1e-5)
    assert max(g for v in got.values() for g in v) > 28 * 24


def test_sigma_search_tries_the_sigmas_of_the_reference(spark, monkeypatch):
    from chronolane.plans import model_queries

    asked = []
    monkeypatch.setattr(model_queries.I, "sigma_search", lambda *a: asked.append(a[-1]) or a[0].limit(0))
    QUERIES["i_sigma_grid_search"](spark, SF)
    assert asked == [[1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0]]


def test_alt_regime_fit_compares_two_homographies(spark):
    own = {r.lane: r.loss for r in QUERIES["m_trajectory_sync"](spark, SF).collect()}
    got = QUERIES["m_alt_regime_fit"](spark, SF).collect()
    assert {r.lane: r.loss for r in got} == own
    assert all(r.own_fits_better and r.alt_loss > r.loss + 0.1 for r in got)


def test_no_method_is_a_second_name_of_another():
    names = {}
    for name, query in QUERIES.items():
        names.setdefault(query, []).append(name)
    assert [n for n in names.values() if len(n) > 1 and set(n) != {"a_bout_metrics", "bouts"}] == []  # the headline query has a short name too
