"""Queries over fits, detectors, frames and stored documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolane.operators import aggregates as A
from chronolane.operators import columns as C
from chronolane.operators import greedy as G
from chronolane.operators import images as I
from chronolane.operators import lags, maps, mixed
from chronolane.operators import measure as P
from chronolane.operators import models as M
from chronolane.operators import slopes
from chronolane.operators import timeseries as T
from chronolane.operators import windows as W
from chronolane.operators.columns import homography
from chronolane.plans.registry import LANE, ORDER, SAMPLES, dealt, load, query, rounded, samples
from chronolane.plans.sequence_queries import bouts
from chronolane.plans.table_queries import LINES, lines
from chronolane.sources.scratch import stored

T0 = 1704067200


def timed(spark, sf):
    return samples(spark, sf).withColumn("h", (F.col("t") - T0) / 3600)


FIT = f"{SAMPLES}, p AS (SELECT *, (t - {T0}) / 3600 AS h FROM s)"


@query("m_fit_affine_lag", f"""WITH {FIT}, f AS (SELECT lane, regr_slope(x, h) AS a, regr_intercept(x, h) AS b, CASE WHEN count(*) > 2 THEN regr_r2(x, h) END AS r2, count(*) AS n FROM p GROUP BY lane HAVING count(*) >= 2)
SELECT f.lane, round(a, 6) AS drift_slope, round(b, 5) AS offset_sec, n, round(r2, 8) AS r_squared, round(max(abs(x - b - a * h)), 5) AS residual_max_sec FROM f JOIN p ON f.lane = p.lane GROUP BY f.lane, a, b, n, r2""")
def m_fit_affine_lag(spark, sf):
    out = M.affine_lag(timed(spark, sf), LANE, "h", "x")
    return out.select("lane", F.round("drift_slope", 6).alias("drift_slope"), F.round("offset_sec", 5).alias("offset_sec"), "n", F.round("r_squared", 8).alias("r_squared"), F.round("residual_max_sec", 5).alias("residual_max_sec"))


@query("m_theil_sen", f"""WITH {FIT}, q AS (SELECT a.lane, quantile_cont((b.x - a.x) / (b.h - a.h), 0.5) AS slope FROM p a JOIN p b ON a.lane = b.lane AND b.h > a.h GROUP BY a.lane), m AS (SELECT lane, quantile_cont(x, 0.5) AS mx, quantile_cont(h, 0.5) AS mh FROM p GROUP BY lane)
SELECT q.lane, round(slope, 7) AS slope, round(mx - slope * mh, 5) AS intercept FROM q JOIN m ON q.lane = m.lane""")
def m_theil_sen(spark, sf):
    out = slopes.theil_sen(timed(spark, sf), LANE, "h", "x")
    return out.select("lane", F.round("slope", 7).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query("m_measure_offset", f"""WITH {SAMPLES}, a AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY lane) AS mid FROM s), b AS (SELECT * FROM a WHERE abs(x - mid) < 30), c AS (SELECT *, quantile_cont(t, 0.5) OVER (PARTITION BY lane) AS half FROM b)
SELECT lane, round(quantile_cont(x, 0.5), 6) AS "offset", round(quantile_cont(CASE WHEN t < half THEN x END, 0.5), 6) AS first_half, round(quantile_cont(CASE WHEN t >= half THEN x END, 0.5), 6) AS second_half, count(*) AS n FROM c GROUP BY lane""")
def m_measure_offset(spark, sf):
    return rounded(M.measure_offset(samples(spark, sf), LANE, "t", "x", 30.0))


@query("m_x_bias", f"WITH {SAMPLES} SELECT lane, round(quantile_cont(x - y, 0.5), 6) AS bias FROM s GROUP BY lane")
def m_x_bias(spark, sf):
    return rounded(samples(spark, sf).groupBy("lane").agg(F.percentile(F.col("x") - F.col("y"), 0.5).alias("bias")))


@query("m_manual_sync", f"WITH {SAMPLES} SELECT lane, 2.5 AS offset_sec, CAST(NULL AS DOUBLE) AS r_squared, true AS low_confidence FROM s GROUP BY lane".replace("2.5 AS", "CAST(2.5 AS DOUBLE) AS"))
def m_manual_sync(spark, sf):
    return samples(spark, sf).select("lane").distinct().select("lane", F.lit(2.5).alias("offset_sec"), F.lit(None).cast("double").alias("r_squared"), F.lit(True).alias("low_confidence"))


@query("m_resample_grid", f"""WITH {FIT}, w AS (SELECT lane, h, x, lead(h) OVER v AS h1, lead(x) OVER v AS x1 FROM p WINDOW v AS (PARTITION BY lane ORDER BY h, frame)),
e AS (SELECT lane, CAST(ceil(min(h) / 24) AS BIGINT) AS k0, CAST(floor(max(h) / 24) AS BIGINT) AS k1 FROM p GROUP BY lane), g AS (SELECT lane, CAST(unnest(range(k0, k1 + 1)) * 24 AS DOUBLE) AS g FROM e)
SELECT g.lane, g.g, round(CASE WHEN h1 IS NULL THEN x ELSE x + (x1 - x) * (g - h) / (h1 - h) END, 6) AS v FROM g JOIN w ON g.lane = w.lane AND h <= g AND (g < h1 OR h1 IS NULL)""")
def m_resample_grid(spark, sf):
    """Each trace on a daily grid, from its first grid point to its last."""
    p = timed(spark, sf)
    ends = p.groupBy("lane").agg(F.ceil(F.min("h") / 24).alias("k0"), F.floor(F.max("h") / 24).alias("k1")).filter("k0 <= k1")
    grid = ends.select("lane", F.explode(F.sequence("k0", "k1")).alias("k")).select("lane", (F.col("k") * 24.0).alias("g"))
    nxt = Window.partitionBy("lane").orderBy("h", "frame")
    w = p.select("lane", "h", "x", F.lead("h").over(nxt).alias("h1"), F.lead("x").over(nxt).alias("x1"))
    found = grid.join(w, "lane").filter("h <= g AND (g < h1 OR h1 IS NULL)")
    between = F.col("x") + (F.col("x1") - F.col("x")) * (F.col("g") - F.col("h")) / (F.col("h1") - F.col("h"))
    return rounded(found.select("lane", "g", F.when(F.col("h1").isNull(), F.col("x")).otherwise(between).alias("v")))


def _traces(spark, sf):
    """Each lane's x, and the same three hours later as a second trace."""
    p = timed(spark, sf)
    a = p.select("lane", "h", F.col("x").alias("a"), F.lit(None).cast("double").alias("b"))
    return a.unionByName(p.select("lane", (F.col("h") + 3).alias("h"), F.lit(None).cast("double").alias("a"), F.col("x").alias("b")))


@query("m_cross_correlate")
def m_cross_correlate(spark, sf):
    return lags.cross_lag(_traces(spark, sf), LANE, "h", "a", "b", 0.25)


@query("m_windowed_lag")
def m_windowed_lag(spark, sf):
    return lags.windowed_lag(_traces(spark, sf), LANE, "h", "a", "b", 0.25)


@query("m_bout_edge_lag")
def m_bout_edge_lag(spark, sf):
    edges = bouts(spark, sf).select("lane", "bout_index", ((F.col("bout_start_sec") - T0) / 3600).alias("bout_start_sec"))
    return lags.edge_lag(_traces(spark, sf), edges, LANE, "h", "a", "b", 0.5, 100.0, 3.0)


#: Base homographies of the two orientations of a camera.
OWN_BASE, OTHER_BASE = [1, 0, 0, 0, 1, 0, 0, 0, 1], [-1, 0, 300, 0, 1, 0, 0, 0, 1]


def _tracks(spark, sf):
    """A lane's samples as one array in the order of time."""
    return timed(spark, sf).groupBy("lane").agg(F.array_sort(F.collect_list(F.struct("h", "x", "y"))).alias("s"))


def _clocks(lane, base):
    """Each lane's clock if the second track is warped by a base homography."""
    h, x = F.transform("s", lambda v: v["h"]), F.transform("s", lambda v: v["x"])
    warped = F.transform("s", lambda v: homography([F.lit(float(c)) for c in base], v["x"], v["y"])["x"])
    arrays = lane.select("lane", F.transform(h, lambda v: v * 8).alias("frames"), x.alias("x"), F.transform(h, lambda v: v + 5.5).alias("t"), warped.alias("tx"))
    return M.trajectory_sync(arrays, outlier=15.0, gap=200.0, least=20, apart=5.0)


@query("m_trajectory_sync")
def m_trajectory_sync(spark, sf):
    return _clocks(_tracks(spark, sf), OWN_BASE)


@query("m_alt_regime_fit")
def m_alt_regime_fit(spark, sf):
    """The fit under the other base homography beside the lane's own, which should have the clearly smaller loss."""
    lane = stored(_tracks(spark, sf), "tracks")
    own = _clocks(lane, OWN_BASE).select("lane", "offset_sec", "loss")
    other = _clocks(lane, OTHER_BASE).select("lane", F.col("offset_sec").alias("alt_offset_sec"), F.col("loss").alias("alt_loss"))
    return own.join(other, "lane", "left").withColumn("own_fits_better", F.col("loss") < F.col("alt_loss"))


#: What takes every lane's (x, y) to (u, v), and the width about which the odd lanes' clicked pairs are mirrored.
TRUE_MAP, MIRROR = [1.1, 0.02, 3.0, -0.01, 0.95, -2.0, 0.0001, 0.0002, 1.0], 500.0


def _mapped(x: str) -> tuple[str, str]:
    h = TRUE_MAP
    w = f"({h[6]} * ({x}) + {h[7]} * y + {h[8]})"
    return f"({h[0]} * ({x}) + {h[1]} * y + {h[2]}) / {w}", f"({h[3]} * ({x}) + {h[4]} * y + {h[5]}) / {w}"


def _pairs(spark, sf):
    s = samples(spark, sf)
    p = homography([F.lit(v) for v in TRUE_MAP], F.col("x"), F.col("y"))
    return s.select("lane", "state", "x", "y", p["x"].alias("u"), p["y"].alias("v"))


(_U, _V), (_MU, _MV) = _mapped("x"), _mapped(f"{MIRROR} - x")


@query("m_orientation_check", f"""WITH {SAMPLES}, e AS (SELECT lane, count(*) AS n, avg(sqrt(power({_MU} - {_U}, 2) + power({_MV} - {_V}, 2))) AS far FROM s WHERE state = 'view' GROUP BY lane),
c AS (SELECT lane, count(*) AS k FROM s WHERE state = 'click' GROUP BY lane), j AS (SELECT coalesce(e.lane, c.lane) AS lane, coalesce(n, 0) AS n, far, coalesce(n, 0) >= 12 AND coalesce(k, 0) >= 4 AS judged FROM e FULL JOIN c ON e.lane = c.lane)
SELECT lane, CASE WHEN judged THEN round(CASE WHEN lane % 2 = 1 THEN far ELSE 0.0 END, 4) END AS mean_err_as_clicked, CASE WHEN judged THEN round(CASE WHEN lane % 2 = 1 THEN 0.0 ELSE far END, 4) END AS mean_err_x_mirrored, n AS n_validation_points,
 CASE WHEN judged AND lane % 2 = 1 THEN 'x_mirrored' ELSE 'as_clicked' END AS recommendation, NOT judged OR lane % 2 = 1 AS flagged FROM j""")
def m_orientation_check(spark, sf):
    """Clicked pairs of odd lanes are mirrored by mistake; lanes with few matched pairs, or fewer than four clicked ones, are refused."""
    pairs = _pairs(spark, sf)
    clicked = pairs.filter("state = 'click'").withColumn("x", F.when(F.col("lane") % 2 == 1, MIRROR - F.col("x")).otherwise(F.col("x")))
    return rounded(maps.check_orientation(clicked, pairs.filter("state = 'view'"), LANE, MIRROR, 12), 4)


@query("m_fit_homography", f"WITH {SAMPLES} SELECT lane, count(*) AS n, {', '.join(f'CAST({v} AS DOUBLE) AS h{k}' for k, v in enumerate(TRUE_MAP[:8]))}, 0.0::DOUBLE AS rmse FROM s GROUP BY lane")
def m_fit_homography(spark, sf):
    """The map that every lane's points went through, fitted anew from its rows."""
    found = maps.fit_maps(_pairs(spark, sf), LANE)
    return rounded(found.select("lane", "n", *[F.get("map", k).alias(f"h{k}") for k in range(8)], "rmse"))


@query("a_paired_tests")
def a_paired_tests(spark, sf):
    return M.with_p_values(A.paired_moments(lines(spark, sf), "y", ["mouse"], ["virus", "stationary"], "injection", "A", "R"))


@query("m_lmm")
def m_lmm(spark, sf):
    per = lines(spark, sf).groupBy("session", "mouse", "virus", "injection").agg(F.avg("y").alias("y"))
    return mixed.factor_model(per, "y", "injection", "mouse", "R", {"virus": "string"})


@query("m_session_lmm")
def m_session_lmm(spark, sf):
    some = lines(spark, sf).filter(F.col("injection").isin("A", "R") & F.col("virus").isin("BUILDING", "MACHINERY"))
    per = some.groupBy("session", "mouse", "virus", "injection", "stationary").agg(F.avg("y").alias("y"))
    return mixed.interaction_model(per, "y", "injection", "R", "virus", ("BUILDING", "MACHINERY"), "mouse", {"stationary": "boolean"})


@query("m_timeseries_lmm")
def m_timeseries_lmm(spark, sf):
    """Prices of two flags by the days from an order to the shipping of its lines, in bins of ten days."""
    o, c, li = (load(spark, sf, n) for n in ("orders", "customer", "lineitem"))
    some = dealt(li, "l_orderkey").filter(F.col("l_returnflag").isin("A", "R")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    some = some.withColumn("elapsed", F.datediff("l_shipdate", "o_orderdate"))
    keys = {"virus": "c_mktsegment", "mouse": "c_custkey", "session": "l_orderkey", "injection": "l_returnflag"}
    per = T.binned_means(some.withColumnsRenamed({v: k for k, v in keys.items()}), list(keys), "elapsed", "l_extendedprice", 10.0)
    return T.timeseries_model(per, "injection", "R", "mouse", "session", {"virus": "string"}, 60.0)


@query("m_levene", f"""WITH {LINES}, z AS (SELECT virus, abs(y - quantile_cont(y, 0.5) OVER (PARTITION BY virus)) AS z FROM ln), g AS (SELECT virus, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY virus),
t AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS g, sum(n * m * m) AS s2, sum(n * v) AS w FROM g) SELECT round((nn - k) / (k - 1) * (s2 - nn * g * g) / w, 4) AS w, k - 1 AS df1, CAST(nn - k AS BIGINT) AS df2 FROM t""")
def m_levene(spark, sf):
    return M.levene(lines(spark, sf), "y", "virus").withColumn("w", F.round("w", 4))


# --- detectors with a memory of their own decisions ------------------------------------------------


def _numbered(spark, sf):
    rows = samples(spark, sf).withColumn("pos", F.row_number().over(W.sequence(LANE, ORDER)).cast("long") - 1)
    return rows.select("lane", "pos", "t", "frame", "x", "y")


GREEDY = f"""WITH RECURSIVE {SAMPLES}, p AS (SELECT lane, row_number() OVER (PARTITION BY lane ORDER BY t, frame) - 1 AS pos, t, x, y FROM s),
w AS (SELECT lane, pos, t, CASE WHEN y <= 80 THEN t END AS t0, CASE WHEN y <= 80 THEN pos END AS p0, CASE WHEN y <= 80 THEN x END AS lo, CASE WHEN y <= 80 THEN x END AS hi FROM p WHERE pos = 0
UNION ALL SELECT p.lane, p.pos, p.t,
 CASE WHEN p.y > 80 THEN NULL WHEN w.p0 IS NULL OR greatest(w.hi, p.x) - least(w.lo, p.x) > 120 THEN p.t ELSE w.t0 END,
 CASE WHEN p.y > 80 THEN NULL WHEN w.p0 IS NULL OR greatest(w.hi, p.x) - least(w.lo, p.x) > 120 THEN p.pos ELSE w.p0 END,
 CASE WHEN p.y > 80 THEN NULL WHEN w.p0 IS NULL OR greatest(w.hi, p.x) - least(w.lo, p.x) > 120 THEN p.x ELSE least(w.lo, p.x) END,
 CASE WHEN p.y > 80 THEN NULL WHEN w.p0 IS NULL OR greatest(w.hi, p.x) - least(w.lo, p.x) > 120 THEN p.x ELSE greatest(w.hi, p.x) END
 FROM w JOIN p ON p.lane = w.lane AND p.pos = w.pos + 1)
SELECT lane, p0 AS first, max(pos) AS last FROM w WHERE p0 IS NOT NULL GROUP BY lane, p0 HAVING max(t) - min(t0) >= 21600"""


@query("w_greedy_range_bouts", GREEDY)
def w_greedy_range_bouts(spark, sf):
    return G.range_bouts(_numbered(spark, sf), {"lane": "long"}, "pos", "t", "x", "y", ORDER, 80.0, 120.0, 21600.0).select("lane", "first", "last")


GREEDY_GAP = f"""WITH RECURSIVE {SAMPLES}, p AS (SELECT lane, row_number() OVER (PARTITION BY lane ORDER BY t, frame) - 1 AS rn, CAST(floor(t / 86400) AS BIGINT) AS pos, t, x, y FROM s),
w AS (SELECT lane, rn, pos, t, CASE WHEN y <= 80 THEN rn END AS r0, CASE WHEN y <= 80 THEN x END AS lo, CASE WHEN y <= 80 THEN x END AS hi FROM p WHERE rn = 0
UNION ALL SELECT lane, rn, pos, t, CASE WHEN fast THEN NULL WHEN begins THEN rn ELSE r0 END, CASE WHEN fast THEN NULL WHEN begins THEN x ELSE least(lo, x) END, CASE WHEN fast THEN NULL WHEN begins THEN x ELSE greatest(hi, x) END
 FROM (SELECT p.*, w.r0, w.lo, w.hi, p.y > 80 AS fast, w.r0 IS NULL OR p.pos - w.pos > 1 OR greatest(w.hi, p.x) - least(w.lo, p.x) > 120 AS begins FROM w JOIN p ON p.lane = w.lane AND p.rn = w.rn + 1)),
b AS (SELECT lane, r0, min(pos) AS first, max(pos) AS last, max(t) - min(t) AS duration FROM w WHERE r0 IS NOT NULL GROUP BY lane, r0 HAVING max(t) - min(t) >= 21600)
SELECT lane, row_number() OVER (PARTITION BY lane ORDER BY r0) - 1 AS bout_index, first, last, round(duration, 6) AS duration FROM b"""


@query("w_greedy_range_bouts_gap", GREEDY_GAP)
def w_greedy_range_bouts_gap(spark, sf):
    """Bouts by the day as position: a day without a sample ends one."""
    rows = samples(spark, sf).withColumn("pos", F.floor(F.col("t") / 86400).cast("long")).select("lane", "pos", "t", "frame", "x", "y")
    return rounded(G.range_bouts(rows, {"lane": "long"}, "pos", "t", "x", "y", ORDER, 80.0, 120.0, 21600.0, gap=1))


#: Memory of 9 readings, 5 at least, emptied by 6 short ones in a row.
GATE = G.GateRule(30.0, 9, 5, 6)


def readings(spark, sf):
    """Each sample's warm end (core) and mean (body)."""
    return samples(spark, sf).withColumns({"core": F.greatest("x", "y"), "body": (F.col("x") + F.col("y")) / 2})


GATE_SQL = f"""WITH RECURSIVE {SAMPLES}, p AS (SELECT lane, frame, row_number() OVER (PARTITION BY lane ORDER BY t, frame) AS pos, greatest(x, y) AS core, (x + y) / 2 AS body FROM s),
w AS (SELECT DISTINCT lane, CAST(0 AS BIGINT) AS frame, CAST(0 AS BIGINT) AS pos, CAST([] AS DOUBLE[]) AS held, 0 AS short, CAST(NULL AS DOUBLE) AS reference FROM p
UNION ALL SELECT lane, frame, pos, CASE WHEN NOT fell THEN list_append(held, body)[-{GATE.history}:] WHEN short + 1 >= {GATE.reset} THEN [] ELSE held END,
 CASE WHEN NOT fell OR short + 1 >= {GATE.reset} THEN 0 ELSE short + 1 END, CASE WHEN fell THEN wanted END
FROM (SELECT p.*, w.held, w.short, list_median(w.held) AS wanted, len(w.held) >= {GATE.least} AND p.core < list_median(w.held) - {GATE.margin} AS fell FROM w JOIN p ON p.lane = w.lane AND p.pos = w.pos + 1))
SELECT lane, frame, round(reference, 6) AS reference FROM w WHERE pos > 0"""


@query("w_temp_gate", GATE_SQL)
def w_temp_gate(spark, sf):
    return rounded(G.temperature_gate(readings(spark, sf), {"lane": "long"}, "frame", "core", "body", ORDER, GATE))


# --- frames: an embedding is an 8 x n image, its label the video ------------------------------------

WIDTH = 8
PIX = f"px AS (SELECT label, vec_id, (i - 1) % {WIDTH} AS px, (i - 1) // {WIDTH} AS py, CAST(v AS DOUBLE) AS value FROM (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"


def frames(spark, sf):
    return load(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("pixels"))


def pixels(spark, sf):
    return I.exploded(frames(spark, sf), ["label", "vec_id"], "pixels", WIDTH)


@query("i_background_median", f"WITH {PIX} SELECT label, CAST(py * {WIDTH} + px AS INTEGER) AS pos, round(quantile_cont(value, 0.5), 6) AS background FROM px GROUP BY 1, 2")
def i_background_median(spark, sf):
    return rounded(I.background_median(frames(spark, sf), ["label"], "pixels"))


@query("i_foreground_score", f"""WITH {PIX}, b AS (SELECT label, px, py, quantile_cont(value, 0.5) AS bg FROM px GROUP BY 1, 2, 3), s AS (SELECT vec_id, abs(value - bg) AS s FROM px JOIN b USING (label, px, py))
SELECT vec_id, round(avg(s) + 2 * stddev_pop(s), 6) AS threshold, round(max(s), 6) AS top FROM s GROUP BY vec_id""")
def i_foreground_score(spark, sf):
    f = frames(spark, sf)
    b = I.background_median(f, ["label"], "pixels").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "background"))), lambda s: s["background"]).alias("bg"))
    rows = f.join(b, "label").withColumn("score", I.foreground(F.col("pixels"), F.col("bg")))
    return rounded(rows.select("vec_id", I.threshold(F.col("score"), 2.0).alias("threshold"), F.array_max("score").alias("top")))


@query("i_roi_stats", f"WITH {PIX} SELECT vec_id, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS n FROM px WHERE (px - 3) * (px - 3) + (py - 3) * (py - 3) <= 4 GROUP BY vec_id")
def i_roi_stats(spark, sf):
    return rounded(I.roi_stats(pixels(spark, sf), ["vec_id"], I.in_circle(F.lit(3), F.lit(3), 2)))


@query("i_circular_mask", f"WITH {PIX} SELECT vec_id, count(*) AS area, sum(px) AS sum_px, sum(py) AS sum_py, min(px) AS left, max(py) AS bottom FROM px WHERE (px - vec_id % 8) * (px - vec_id % 8) + (py - (vec_id // 8) % 8) * (py - (vec_id // 8) % 8) <= 6 GROUP BY vec_id".replace("AS left", 'AS "left"').replace("sum(px)", "CAST(sum(px) AS BIGINT)").replace("sum(py)", "CAST(sum(py) AS BIGINT)"))
def i_circular_mask(spark, sf):
    """A disk whose centre goes over the whole frame, so that each edge cuts it off somewhere."""
    inside = I.in_circle(F.col("vec_id") % 8, F.floor(F.col("vec_id") / 8) % 8, 6**0.5)
    found = pixels(spark, sf).filter(inside).groupBy("vec_id")
    return found.agg(F.count("*").alias("area"), F.sum("px").alias("sum_px"), F.sum("py").alias("sum_py"), F.min("px").cast("long").alias("left"), F.max("py").cast("long").alias("bottom"))


@query("i_polygon_mask", f"WITH {PIX} SELECT vec_id, count(*) AS n FROM px WHERE px < 4 AND py < 3 GROUP BY vec_id")
def i_polygon_mask(spark, sf):
    return pixels(spark, sf).filter(I.in_polygon([(0, 0), (4, 0), (4, 3), (0, 3)])).groupBy("vec_id").agg(F.count("*").alias("n"))


@query("i_bbox", f"WITH {PIX} SELECT vec_id, count(*) AS area, round(avg(px), 6) AS cx, round(avg(py), 6) AS cy, max(px) - min(px) + 1 AS w, max(py) - min(py) + 1 AS h FROM px WHERE value > 0.05 GROUP BY vec_id")
def i_bbox(spark, sf):
    found = I.mask_summary(pixels(spark, sf), ["vec_id"], F.col("value") > 0.05).filter("area > 0")
    return rounded(found.select("vec_id", "area", "cx", "cy", F.col("w").cast("long"), F.col("h").cast("long")))


@query("i_roi_predicates", f"WITH {PIX} SELECT vec_id, true AS in_bounds, min(CASE WHEN (px - 3) * (px - 3) + (py - 3) * (py - 3) <= 1 THEN CASE WHEN value > -0.05 THEN 1 ELSE 0 END END) = 1 AS inside, max(CASE WHEN (px - 3) * (px - 3) + (py - 3) * (py - 3) <= 1 AND value > -0.05 THEN 1 ELSE 0 END) = 1 AS overlaps FROM px GROUP BY vec_id")
def i_roi_predicates(spark, sf):
    return I.roi_predicates(pixels(spark, sf), ["vec_id"], F.lit(3), F.lit(3), 1, WIDTH, 8, F.col("value") > -0.05)


@query("i_blob_posture", f"WITH {PIX}, b AS (SELECT vec_id, count(*) AS area, max(px) - min(px) + 1 AS w, max(py) - min(py) + 1 AS h FROM px WHERE value > 0.15 GROUP BY vec_id) SELECT vec_id, CASE WHEN area < 6 THEN NULL WHEN greatest(w, h) * 1.0 / least(w, h) >= 1.2 THEN 'extended' ELSE 'curled' END AS posture FROM b")
def i_blob_posture(spark, sf):
    b = I.mask_summary(pixels(spark, sf), ["vec_id"], F.col("value") > 0.15).filter("area > 0")
    return b.select("vec_id", I.posture(F.col("area"), F.col("w"), F.col("h"), 6, 1.2).alias("posture"))


@query("i_frame_state", f"WITH {PIX}, b AS (SELECT vec_id, count(*) FILTER (value > 0.15) AS area, avg(CASE WHEN abs(value) > 0.1 THEN 1.0 ELSE 0.0 END) AS ch FROM px GROUP BY vec_id) SELECT vec_id, CASE WHEN ch >= 0.5 THEN 'intrusion' WHEN area BETWEEN 4 AND 9 THEN 'mouse' ELSE 'empty' END AS state FROM b")
def i_frame_state(spark, sf):
    b = pixels(spark, sf).groupBy("vec_id").agg(F.count_if(F.col("value") > 0.15).alias("area"), F.avg((F.abs("value") > 0.1).cast("double")).alias("ch"))
    return b.select("vec_id", I.entry_state(F.col("area"), F.col("ch"), 4, 9, 0.5).alias("state"))


@query("i_split_row", f"""WITH {PIX}, r AS (SELECT vec_id, py, avg(value) AS b FROM px GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, py < 4 ORDER BY b DESC, py) AS k FROM r),
e AS (SELECT vec_id, max(py) FILTER (k = 1 AND py < 4) AS t, max(py) FILTER (k = 1 AND py >= 4) AS l FROM k GROUP BY 1), m AS (SELECT r.vec_id, r.py, row_number() OVER (PARTITION BY r.vec_id ORDER BY b, r.py) AS k FROM r JOIN e ON r.vec_id = e.vec_id AND r.py BETWEEN t AND l)
SELECT vec_id, CAST(py AS INTEGER) AS split FROM m WHERE k = 1""")
def i_split_row(spark, sf):
    return I.split_row(pixels(spark, sf), ["vec_id"], 8)


@query("lane_crop_iter", f"WITH {PIX} SELECT vec_id, round(sum(value), 6) AS total FROM px WHERE py < 4 GROUP BY vec_id")
def lane_crop_iter(spark, sf):
    top = F.slice("pixels", 1, 4 * WIDTH)
    return rounded(frames(spark, sf).select("vec_id", F.aggregate(top, F.lit(0.0), lambda a, v: a + v).alias("total")))


@query("i_iou", f"WITH {PIX} SELECT vec_id, round(count(*) FILTER (value > 0 AND px < 4) * 1.0 / count(*) FILTER (value > 0 OR px < 4), 9) AS iou FROM px GROUP BY vec_id")
def i_iou(spark, sf):
    return rounded(I.iou(pixels(spark, sf), ["vec_id"], F.col("value") > 0, F.col("px") < 4), 9)


@query("i_sigma_grid_search", f"""WITH {PIX}, c AS (SELECT vec_id, avg(value) AS m, stddev_pop(value) AS s FROM px GROUP BY 1), g AS (SELECT unnest(range(2, 13)) / 2.0 AS sigma),
i AS (SELECT sigma, px.vec_id, count(*) FILTER (value > m + sigma * s AND px < 4) * 1.0 / count(*) FILTER (value > m + sigma * s OR px < 4) AS iou FROM px JOIN c ON px.vec_id = c.vec_id, g GROUP BY 1, 2)
SELECT CAST(sigma AS DOUBLE) AS sigma, round(avg(iou), 9) AS mean_iou FROM i GROUP BY sigma ORDER BY avg(iou) DESC, sigma LIMIT 1""")
def i_sigma_grid_search(spark, sf):
    return rounded(I.sigma_search(pixels(spark, sf), ["vec_id"], "value", F.col("px") < 4, [k / 2 for k in range(2, 13)]), 9)


@query("i_warm_spot", f"WITH {PIX} SELECT vec_id, round(CASE WHEN count(*) >= 5 THEN quantile_cont(value, 0.95) END, 6) AS warm FROM px WHERE px < 3 GROUP BY vec_id")
def i_warm_spot(spark, sf):
    return rounded(pixels(spark, sf).filter("px < 3").groupBy("vec_id").agg(I.guarded(F.col("value"), 5, "p95").alias("warm")))


@query("i_dorsal", f"WITH {PIX} SELECT vec_id, round(CASE WHEN count(*) >= 10 THEN avg(value) END, 6) AS mean, round(CASE WHEN count(*) >= 10 THEN quantile_cont(value, 0.5) END, 6) AS median FROM px WHERE py BETWEEN 2 AND 5 GROUP BY vec_id")
def i_dorsal(spark, sf):
    return rounded(pixels(spark, sf).filter("py BETWEEN 2 AND 5").groupBy("vec_id").agg(I.guarded(F.col("value"), 10, "mean").alias("mean"), I.guarded(F.col("value"), 10).alias("median")))


@query("i_local_floor", f"WITH {PIX}, d AS (SELECT *, (px - 3) * (px - 3) + (py - 3) * (py - 3) AS r2 FROM px) SELECT vec_id, round(CASE WHEN count(*) >= 10 THEN quantile_cont(value, 0.5) END, 6) AS floor FROM d WHERE r2 <= 9 AND r2 > 1 AND value < 0.2 GROUP BY vec_id")
def i_local_floor(spark, sf):
    ring = pixels(spark, sf).filter(I.in_annulus(F.lit(3), F.lit(3), 1, 3) & (F.col("value") < 0.2))
    return rounded(ring.groupBy("vec_id").agg(I.guarded(F.col("value"), 10).alias("floor")))


@query("i_arc_length_fraction", f"""WITH {SAMPLES}, d AS (SELECT lane, frame, t, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS d FROM s WINDOW w AS (PARTITION BY lane ORDER BY t))
SELECT lane, frame, round(sum(d) OVER (PARTITION BY lane ORDER BY t) / sum(d) OVER (PARTITION BY lane), 9) AS fraction FROM d""")
def i_arc_length_fraction(spark, sf):
    return rounded(I.arc_fractions(samples(spark, sf), LANE, "t").select("lane", "frame", "fraction"), 9)


PATH = "path AS (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS i, vec_id % 8 AS x, (vec_id // 8) % 8 AS y FROM embeddings)"


def _path(spark, sf):
    r = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    e = load(spark, sf, "embeddings").withColumn("i", r)
    return e.select("label", "i", (F.col("vec_id") % 8).alias("x"), (F.floor(F.col("vec_id") / 8) % 8).alias("y"))


@query("i_nearest_path", f"""WITH {PIX}, {PATH}, q AS (SELECT DISTINCT label, px, py FROM px), d AS (SELECT q.label, px, py, i, row_number() OVER (PARTITION BY q.label, px, py ORDER BY (px - x) * (px - x) + (py - y) * (py - y), i) AS k FROM q JOIN path ON q.label = path.label)
SELECT label, CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py, i AS nearest FROM d WHERE k = 1""")
def i_nearest_path(spark, sf):
    q = pixels(spark, sf).select("label", "px", "py").distinct()
    return I.nearest_path(q, _path(spark, sf), ["label"], "i").select("label", F.col("px").cast("long"), F.col("py").cast("long"), "nearest")


@query("i_curve_max_percentile")
def i_curve_max_percentile(spark, sf):
    return I.curve_percentile(_path(spark, sf), pixels(spark, sf), ["label"], 1.5)


def _per_frame(spark, sf, kernel, schema, numbered=False):
    """A numpy kernel on each frame (8 pixels wide), and its number if asked for."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = [(int(i), *kernel(np.array(p).reshape(-1, WIDTH), *([int(i)] if numbered else []))) for i, p in zip(pdf["vec_id"], pdf["pixels"], strict=True)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in f"vec_id long, {schema}".split(", ")])

    return frames(spark, sf).select("vec_id", "pixels").mapInPandas(run, f"vec_id long, {schema}")


@query("i_segment_blob")
def i_segment_blob(spark, sf):
    def kernel(f):
        s = I.segment(f * 100, np.full(f.shape, np.median(f) * 100), 0.5, 2, 60)
        return (s["x"], s["y"], s["area"], s["confidence"]) if s else (None, None, 0, 0.0)

    return _per_frame(spark, sf, kernel, "x double, y double, area long, confidence double")


@query("i_local_fallback")
def i_local_fallback(spark, sf):
    def kernel(f):
        s = I.local_fallback(f, (3.0, 3.0), 3, 80, 2)
        return (s["x"], s["y"], s["area"]) if s else (None, None, 0)

    return _per_frame(spark, sf, kernel, "x double, y double, area long")


_EDT = f"""WITH {PIX}, m AS (SELECT vec_id, px, py, value > -0.1 AS inside FROM px), i AS (SELECT DISTINCT vec_id FROM px),
d AS (SELECT a.vec_id, a.px, a.py, min((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) AS far FROM m a LEFT JOIN m b ON a.vec_id = b.vec_id AND NOT b.inside WHERE a.inside GROUP BY 1, 2, 3),
p AS (SELECT vec_id, px, py, least(coalesce(far, 999), (px + 1) * (px + 1), (8 - px) * (8 - px), (py + 1) * (py + 1), (8 - py) * (8 - py)) AS far FROM d),
a AS (SELECT vec_id, px, py, row_number() OVER (PARTITION BY vec_id ORDER BY far DESC, py, px) AS k FROM d WHERE far >= 4), b AS (SELECT vec_id, px, py, row_number() OVER (PARTITION BY vec_id ORDER BY far DESC, py, px) AS k FROM p WHERE far >= 4)
SELECT i.vec_id, CAST(a.px AS BIGINT) AS x, CAST(a.py AS BIGINT) AS y, CAST(b.px AS BIGINT) AS padded_x, CAST(b.py AS BIGINT) AS padded_y FROM i LEFT JOIN a ON i.vec_id = a.vec_id AND a.k = 1 LEFT JOIN b ON i.vec_id = b.vec_id AND b.k = 1"""


@query("i_edt_roi_center", _EDT)
def i_edt_roi_center(spark, sf):
    """Where a disk of radius 2 lies deepest in the warm part of a frame, and where if the frame's border counts as outside."""
    mask = F.transform("pixels", lambda v: v > -0.1)
    found = frames(spark, sf).select("vec_id", I.deepest_pixel(mask, WIDTH, 2.0).alias("a"), I.deepest_pixel(mask, WIDTH, 2.0, pad=True).alias("b"))
    return found.select("vec_id", "a.x", "a.y", F.col("b.x").alias("padded_x"), F.col("b.y").alias("padded_y"))


@query("i_floor_roi_search")
def i_floor_roi_search(spark, sf):
    return _per_frame(spark, sf, lambda f: I.floor_roi(np.ones(f.shape, bool), f > 0.2, 3, 3, 1, 3) or (None, None), "direction string, shift double")


@query("i_best_integer_shift")
def i_best_integer_shift(spark, sf):
    return _per_frame(spark, sf, lambda f: I.best_shift(f, I._moved(f, 1, -1), 2), "dy long, dx long")


@query("i_local_edge_refine")
def i_local_edge_refine(spark, sf):
    return _per_frame(spark, sf, lambda f: I.edge_refine(f, I.disk(f.shape, 3, 3, 1), 2), "dx long, dy long, gain double")


@query("i_skeleton_path")
def i_skeleton_path(spark, sf):
    def kernel(f):
        points = {(int(a), int(b)) for a, b in zip(*np.nonzero(f > 0.15), strict=True)}
        path = I.skeleton_path(points)
        return len(I.pruned(points, 2)), len(path), I.tail_base(path, f > 0.0)

    return _per_frame(spark, sf, kernel, "kept long, length long, base double")


@query("i_track_row")
def i_track_row(spark, sf):
    """A row of 34 columns per frame, against its video's background."""
    import pandas as pd

    f = frames(spark, sf)
    b = I.background_median(f, ["label"], "pixels").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "background"))), lambda s: s["background"]).alias("bg"))
    named = f"video_file string, frame_number long, elapsed_time_sec double, sampling_interval_frames int, {P.TRACK_ROW}"

    def run(batches):
        for pdf in batches:
            out = []
            for v, i, p, bg in zip(pdf["label"], pdf["vec_id"], pdf["pixels"], pdf["bg"], strict=True):
                frame, back = (np.array(a).reshape(-1, WIDTH) * 100 for a in (p, bg))
                out.append((f"{v}.seq", int(i), i / 8.0, 1, *P.track_row(frame, back, np.ones(frame.shape, bool), 0.5, 2, 60, 1.0, 4)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in named.split(", ")])

    return f.join(b, "label").select("label", "vec_id", "pixels", "bg").mapInPandas(run, named)


@query("i_measure_sample")
def i_measure_sample(spark, sf):
    """Each frame's blob as the other camera's mask, a pixel off; registered, refined, measured, then gated."""

    def kernel(f):
        f = f * 100
        found = I.segment(f, np.full(f.shape, np.median(f)), 0.5, 2, 60)
        mask = np.zeros(f.shape, bool)
        if found:
            mask[tuple(found["pixels"].T)] = True
        native = (found["x"], found["y"]) if found else None
        return P.sample(f, mask, P.translation(1, -1), native, 1.0, (1.5, 4.0), 1, least=5)

    rows = _per_frame(spark, sf, kernel, P.SAMPLE)
    reasons = C.gate(F.col("delta"), F.lit(1.0), F.lit(True), F.lit(True), F.col("posture") == "extended", 0.3, 0.5)
    return rows.withColumn("qc", F.when(F.col("posture").isNotNull(), F.array_join(reasons, "; ")))


@query("i_tail_delta", f"""WITH {PIX}, k AS (SELECT unnest(range(4)) + 0.5 AS x), near AS (SELECT vec_id, x, max(value) AS v FROM px, k WHERE (px - x) * (px - x) + (py - vec_id % 8) * (py - vec_id % 8) <= 1 GROUP BY 1, 2), t AS (SELECT vec_id, quantile_cont(v, 0.9) AS tail FROM near GROUP BY 1),
f AS (SELECT vec_id, CASE WHEN count(*) >= 10 THEN quantile_cont(value, 0.5) END AS floor FROM (SELECT *, (px - 2) * (px - 2) + (py - vec_id % 8) * (py - vec_id % 8) AS r2 FROM px) WHERE r2 <= 16 AND r2 > 2.25 AND value <= 0.2 GROUP BY 1)
SELECT t.vec_id, round(tail, 6) AS tail, round(floor, 6) AS floor, round(tail - floor, 6) AS delta, CASE WHEN floor IS NULL THEN 'insufficient clean floor annulus pixels' ELSE '' END AS reason FROM t LEFT JOIN f ON t.vec_id = f.vec_id""")
def i_tail_delta(spark, sf):
    """The tail along four points of one pixel row, half a pixel off, less the floor around them."""

    def kernel(f, k):
        points = np.array([(x, k % 8) for x in range(4)]) + np.array([0.5, 0.0])
        return P.tail_delta(f, points, 1.0, 1.5, 4.0, f > 0.2)

    return rounded(_per_frame(spark, sf, kernel, "tail double, floor double, delta double, reason string", numbered=True))


@query("i_registration_correction", f"""WITH {PIX}, w AS (SELECT vec_id, avg(px + 1) AS x, avg(py - 1) AS y FROM px WHERE value > 0.05 AND px < 7 AND py > 0 GROUP BY 1), n AS (SELECT vec_id, avg(px) AS x, avg(py) AS y FROM px WHERE value > 0.15 GROUP BY 1), i AS (SELECT DISTINCT vec_id FROM px)
SELECT i.vec_id, round(n.x - w.x, 6) AS dx, round(n.y - w.y, 6) AS dy FROM i LEFT JOIN w ON i.vec_id = w.vec_id LEFT JOIN n ON i.vec_id = n.vec_id""")
def i_registration_correction(spark, sf):
    """The shift that takes a mask's centroid, warped by one pixel each way, to that of the frame's warm pixels."""

    def kernel(f):
        warm = np.argwhere(f > 0.15)
        native = tuple(warm.mean(axis=0)[::-1]) if len(warm) else None
        return P.registered(P.translation(1, -1), f > 0.05, f.shape, native)[1] or (None, None)

    return rounded(_per_frame(spark, sf, kernel, "dx double, dy double"))


@query("i_track_file")
def i_track_file(spark, sf):
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values("vec_id")
        stack = [np.array(p).reshape(-1, WIDTH) * 100 for p in pdf["pixels"]]
        rows = list(I.track(enumerate(stack), np.median(stack, axis=0), 1, 0.5, 2, 60, 1.5, 4.0))
        return pd.DataFrame(rows).assign(label=int(pdf["label"].iloc[0]))[["label", "frame", "x", "y", "area", "confidence", "method", "flag"]]

    return frames(spark, sf).groupBy("label").applyInPandas(run, "label long, frame long, x double, y double, area double, confidence double, method string, flag string")


@query("i_landmark_errors", f"WITH {SAMPLES} SELECT frame, round(sqrt(power(x - y, 2) + power(y - 10, 2)), 6) AS pixel_error, round(x - y, 6) AS value_error FROM s")
def i_landmark_errors(spark, sf):
    return rounded(samples(spark, sf).select("frame", F.hypot(F.col("x") - F.col("y"), F.col("y") - 10).alias("pixel_error"), (F.col("x") - F.col("y")).alias("value_error")))
