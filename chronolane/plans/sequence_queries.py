"""Queries over ordered sequences: features, bouts, activity, runs and state machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import columns as C
from chronolane.operators import windows as W
from chronolane.plans.registry import LANE, ORDER, SAMPLES, query, rounded, samples

HOUR = 3600.0
DISPERSION, SPEED = 30.0, 0.02
LEAST, GAP, UNKNOWN_GAP = 6 * HOUR, 12 * HOUR, 48 * HOUR


def featured(spark, sf):
    return W.features(samples(spark, sf), "t", "x", "y", F.col("ok"), LANE, ORDER)


def classified(spark, sf):
    df = featured(spark, sf)
    df = df.withColumn("still", C.stationary(F.col("ok"), F.col("x_dispersion"), DISPERSION, F.col("velocity_smooth"), SPEED))
    return df.withColumn("frame_state", C.frame_state(F.col("ok"), F.col("x_dispersion"), F.col("still")))


def bouts(spark, sf):
    return W.islands(classified(spark, sf), "t", "frame_state", LANE, ORDER, LEAST, GAP, UNKNOWN_GAP)


FEATURES = f"""{SAMPLES},
v AS (SELECT *, CASE WHEN ok THEN x END AS vx, CASE WHEN ok THEN y END AS vy FROM s),
l AS (SELECT *, t - lag(t) OVER w AS dt, vx - lag(vx) OVER w AS dx, vy - lag(vy) OVER w AS dy FROM v WINDOW w AS (PARTITION BY lane ORDER BY t, frame)),
k AS (SELECT *, dx / nullif(dt, 0) AS velocity_x, sqrt(dx * dx + dy * dy) / nullif(dt, 0) AS velocity FROM l),
f AS (SELECT *,
  CASE WHEN count(velocity) OVER r >= 2 THEN quantile_cont(velocity, 0.5) OVER r END AS velocity_smooth,
  CASE WHEN vx IS NOT NULL THEN quantile_cont(vx, 0.5) OVER q END AS x_smooth,
  CASE WHEN vx IS NOT NULL AND count(vx) OVER q >= 3 THEN mad(vx) OVER q END AS x_dispersion,
  CASE WHEN vx IS NOT NULL AND count(vx) OVER q >= 3 THEN quantile_cont(vx, 0.75) OVER q - quantile_cont(vx, 0.25) OVER q END AS x_iqr,
  CASE WHEN vx IS NOT NULL AND count(vx) OVER q >= 3 THEN stddev_samp(vx) OVER q END AS x_sd
  FROM k WINDOW r AS (PARTITION BY lane ORDER BY t, frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
                q AS (PARTITION BY lane, vx IS NULL ORDER BY t, frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
c AS (SELECT *, coalesce(ok AND x_dispersion < {DISPERSION} AND coalesce(velocity_smooth < {SPEED}, true), false) AS still FROM f),
z AS (SELECT *, CASE WHEN still THEN 'stationary' WHEN NOT ok OR x_dispersion IS NULL THEN 'unknown' ELSE 'moving' END AS frame_state FROM c)"""

BOUTS = f"""{FEATURES},
n AS (SELECT *, row_number() OVER w AS r, sum(CASE WHEN frame_state = 'moving' THEN 1 ELSE 0 END) OVER w AS mv,
  CASE WHEN frame_state = 'stationary' AND coalesce(lag(frame_state) OVER w, '') <> 'stationary' THEN 1 ELSE 0 END AS st FROM z WINDOW w AS (PARTITION BY lane ORDER BY t, frame)),
g AS (SELECT *, sum(st) OVER (PARTITION BY lane ORDER BY t, frame) AS run FROM n),
u AS (SELECT lane, run, min(r) AS r0, max(r) AS r1, min(t) AS t0, max(t) AS t1, min(mv) AS mv FROM g WHERE frame_state = 'stationary' GROUP BY lane, run),
b AS (SELECT *, CASE WHEN lag(t1) OVER w IS NULL OR t0 - lag(t1) OVER w > CASE WHEN mv = lag(mv) OVER w THEN {UNKNOWN_GAP} ELSE {GAP} END THEN 1 ELSE 0 END AS br FROM u WINDOW w AS (PARTITION BY lane ORDER BY run)),
m AS (SELECT *, sum(br) OVER (PARTITION BY lane ORDER BY run) AS bout FROM b),
o AS (SELECT lane, bout, min(t0) AS bout_start_sec, max(t1) AS bout_end_sec, min(r0) AS first_row, max(r1) AS last_row FROM m GROUP BY lane, bout HAVING max(t1) - min(t0) >= {LEAST}),
bouts AS (SELECT lane, row_number() OVER (PARTITION BY lane ORDER BY bout) - 1 AS bout_index, bout_start_sec, bout_end_sec, bout_end_sec - bout_start_sec AS bout_duration_sec, last_row - first_row + 1 AS n_samples, first_row, last_row FROM o),
bm AS (SELECT bouts.lane, bouts.bout_index, avg(n.x) AS mean_x, avg(n.y) AS mean_y, avg(CASE WHEN n.ok THEN n.x END) AS mean_valid_x FROM bouts JOIN n ON n.lane = bouts.lane AND n.r BETWEEN bouts.first_row AND bouts.last_row GROUP BY 1, 2)"""


@query("w_compute_velocity", f"WITH {FEATURES} SELECT lane, frame, round(velocity_x, 6) AS velocity_x, round(velocity, 6) AS velocity, round(velocity_smooth, 6) AS velocity_smooth, round(x_smooth, 6) AS x_smooth, round(x_dispersion, 6) AS x_dispersion FROM f")
def w_compute_velocity(spark, sf):
    return rounded(featured(spark, sf).select("lane", "frame", "velocity_x", "velocity", "velocity_smooth", "x_smooth", "x_dispersion"))


@query("w_velocity", f"WITH {FEATURES} SELECT lane, frame, round(velocity_x, 6) AS velocity_x, round(velocity, 6) AS velocity FROM k")
def w_velocity(spark, sf):
    df = samples(spark, sf).withColumns({"vx": F.when(F.col("ok"), F.col("x")), "vy": F.when(F.col("ok"), F.col("y"))})
    return rounded(W.velocity(df, "t", "vx", "vy", LANE, ORDER).select("lane", "frame", "velocity_x", "velocity"))


@query("w_velocity_smooth", f"WITH {FEATURES} SELECT lane, frame, round(velocity_smooth, 6) AS velocity_smooth FROM f")
def w_velocity_smooth(spark, sf):
    return rounded(featured(spark, sf).select("lane", "frame", "velocity_smooth"))


@query("w_roll_median_valid", f"WITH {FEATURES} SELECT lane, frame, round(x_smooth, 6) AS x_smooth FROM f")
def w_roll_median_valid(spark, sf):
    df = samples(spark, sf).withColumn("vx", F.when(F.col("ok"), F.col("x")))
    return rounded(W.roll_median_valid(df, "vx", "x_smooth", LANE, ORDER, 5).select("lane", "frame", "x_smooth"))


@query("w_temp_smooth", f"""WITH {SAMPLES}, v AS (SELECT *, CASE WHEN ok THEN y END AS vy FROM s)
SELECT lane, frame, round(CASE WHEN vy IS NOT NULL THEN quantile_cont(vy, 0.5) OVER (PARTITION BY lane, vy IS NULL ORDER BY t, frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END, 6) AS y_smooth FROM v""")
def w_temp_smooth(spark, sf):
    df = samples(spark, sf).withColumn("vy", F.when(F.col("ok"), F.col("y")))
    return rounded(W.roll_median_valid(df, "vy", "y_smooth", LANE, ORDER, 3).select("lane", "frame", "y_smooth"))


def _dispersion(metric, column):
    def run(spark, sf):
        df = samples(spark, sf).withColumn("vx", F.when(F.col("ok"), F.col("x")))
        return rounded(W.roll_dispersion(df, "vx", column, LANE, ORDER, 5, metric).select("lane", "frame", column))

    return run


for _metric, _column in (("mad", "x_dispersion"), ("iqr", "x_iqr"), ("sd", "x_sd")):
    query(f"w_roll_{_metric}", f"WITH {FEATURES} SELECT lane, frame, round({_column}, 6) AS {_column} FROM f")(_dispersion(_metric, _column))


@query("w_roll_median_trunc", f"WITH {SAMPLES} SELECT lane, frame, round(quantile_cont(x, 0.5) OVER (PARTITION BY lane ORDER BY t, frame ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), 6) AS x_median FROM s")
def w_roll_median_trunc(spark, sf):
    return rounded(W.roll_median_raw(samples(spark, sf), "x", "x_median", LANE, ORDER, 1, 2).select("lane", "frame", "x_median"))


@query("p_classify_stationary", f"WITH {FEATURES} SELECT lane, frame, still FROM c")
def p_classify_stationary(spark, sf):
    return classified(spark, sf).select("lane", "frame", "still")


@query("p_classify_frame_state", f"WITH {FEATURES} SELECT lane, frame, frame_state FROM z")
def p_classify_frame_state(spark, sf):
    return classified(spark, sf).select("lane", "frame", "frame_state")


@query("w_rle_runs", f"""WITH {SAMPLES}, a AS (SELECT *, CASE WHEN lag(ok) OVER w IS DISTINCT FROM ok OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS ch, row_number() OVER w - 1 AS pos FROM s WINDOW w AS (PARTITION BY lane ORDER BY t, frame)),
b AS (SELECT *, sum(ch) OVER (PARTITION BY lane ORDER BY t, frame) AS run FROM a)
SELECT lane, ok AS state, min(pos) AS run_start, max(pos) AS run_end, count(*) AS run_length FROM b GROUP BY lane, run, ok""")
def w_rle_runs(spark, sf):
    return W.state_runs(samples(spark, sf), "ok", LANE, ORDER).select("lane", "state", F.col("run_start").cast("long"), F.col("run_end").cast("long"), F.col("run_length").cast("long"))


@query("w_bout_islands", f"WITH {BOUTS} SELECT lane, bout_index, round(bout_start_sec, 6) AS bout_start_sec, round(bout_end_sec, 6) AS bout_end_sec, round(bout_duration_sec, 6) AS bout_duration_sec, n_samples FROM bouts")
def w_bout_islands(spark, sf):
    return rounded(bouts(spark, sf).drop("first_row", "last_row"))


@query("a_bout_metrics", f"WITH {BOUTS} SELECT lane, bout_index, round(bout_duration_sec, 6) AS bout_duration_sec, n_samples, round(mean_x, 9) AS mean_x, round(mean_y, 9) AS mean_y, round(mean_valid_x, 9) AS mean_valid_x FROM bouts JOIN bm USING (lane, bout_index)")
@query("bouts", f"WITH {BOUTS} SELECT lane, bout_index, round(bout_duration_sec, 6) AS bout_duration_sec, n_samples, round(mean_x, 9) AS mean_x, round(mean_y, 9) AS mean_y, round(mean_valid_x, 9) AS mean_valid_x FROM bouts JOIN bm USING (lane, bout_index)")
def a_bout_metrics(spark, sf):
    rows = classified(spark, sf)
    found = W.islands(rows, "t", "frame_state", LANE, ORDER, LEAST, GAP, UNKNOWN_GAP)
    metrics = {"mean_x": F.col("x"), "mean_y": F.col("y"), "mean_valid_x": F.when(F.col("ok"), F.col("x"))}
    return rounded(W.bout_metrics(rows, found, LANE, ORDER, metrics).select("lane", "bout_index", F.round("bout_duration_sec", 6).alias("bout_duration_sec"), "n_samples", *metrics), 9)


@query("a_bout_summary", f"""WITH {BOUTS}, h AS (SELECT lane, max(t) AS trial FROM s GROUP BY lane),
a AS (SELECT lane, count(*) AS n, sum(bout_duration_sec) AS total, avg(bout_duration_sec) AS mean_d, quantile_cont(bout_duration_sec, 0.5) AS med_d, avg(mean_y) AS pref FROM bouts JOIN bm USING (lane, bout_index) GROUP BY lane)
SELECT h.lane, round(trial, 6) AS trial_length_sec, coalesce(n, 0) AS n_bouts, round(coalesce(total, 0), 6) AS total_sec, round(coalesce(total, 0) / trial, 9) AS fraction, round(mean_d, 6) AS mean_bout_duration_sec, round(med_d, 6) AS median_bout_duration_sec, round(coalesce(n, 0) / trial * 1000, 9) AS bouts_per_1000s, round(pref, 6) AS mean_preferred FROM h LEFT JOIN a ON h.lane = a.lane""")
def a_bout_summary(spark, sf):
    rows = classified(spark, sf)
    found = W.bout_metrics(rows, W.islands(rows, "t", "frame_state", LANE, ORDER, LEAST, GAP, UNKNOWN_GAP), LANE, ORDER, {"mean_y": F.col("y")})
    out = W.bout_summary(rows, found, LANE, "t", "mean_y")
    return out.withColumns({c: F.round(c, 9 if c in ("fraction", "bouts_per_1000s") else 6) for c, k in out.dtypes if k == "double"}).withColumn("n_bouts", F.col("n_bouts").cast("long"))


STEPS = f"""{SAMPLES}, p AS (SELECT *, t - lag(t) OVER w AS dt, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS far FROM s WHERE ok WINDOW w AS (PARTITION BY lane ORDER BY t, frame)),
q AS (SELECT *, CASE WHEN dt > {12 * HOUR} OR far < 10 THEN 0 ELSE coalesce(far, 0) END AS step FROM p)"""


def stepped(spark, sf):
    return W.steps(samples(spark, sf), "t", "x", "y", F.col("ok"), LANE, ORDER, 10.0, 12 * HOUR)


@query("w_lag_diff_steps", f"WITH {STEPS} SELECT lane, frame, round(dt, 6) AS dt, round(step, 6) AS step FROM q")
def w_lag_diff_steps(spark, sf):
    return rounded(stepped(spark, sf).select("lane", "frame", "dt", "step"))


@query("w_cumsum", f"""WITH {STEPS}, d AS (SELECT lane, greatest(ceil((t - 1704067200) / 86400), 1) * 86400 AS bin_end, sum(step) AS step FROM q GROUP BY 1, 2)
SELECT lane, CAST(bin_end AS DOUBLE) AS bin_end, round(sum(step) OVER (PARTITION BY lane ORDER BY bin_end), 6) AS total FROM d""")
def w_cumsum(spark, sf):
    binned = stepped(spark, sf).groupBy("lane", C.end_bin(F.col("t") - 1704067200, 86400.0).alias("bin_end")).agg(F.sum("step").alias("step"))
    return rounded(W.running_total(binned, "step", "total", LANE, ["bin_end"]).select("lane", F.col("bin_end").cast("double"), "total"))


@query("w_motion_energy", f"""WITH {SAMPLES}, p AS (SELECT *, count(*) OVER (PARTITION BY lane) AS n, t - lag(t) OVER w AS dt, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS far FROM s WHERE ok WINDOW w AS (PARTITION BY lane ORDER BY t, frame))
SELECT lane, frame, round(coalesce(far / nullif(dt, 0), 0), 6) AS energy FROM p WHERE n >= 2""")
def w_motion_energy(spark, sf):
    return rounded(W.motion_energy(samples(spark, sf), "t", "x", "y", F.col("ok"), LANE, ORDER).select("lane", "frame", "energy"))


@query("w_bounded_background", f"""WITH {SAMPLES}, e AS (SELECT *, abs(x - quantile_cont(x, 0.5) OVER (PARTITION BY lane ORDER BY t, frame ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING)) AS energy FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY energy DESC, t, frame) AS k FROM e WHERE energy IS NOT NULL) SELECT lane, frame, round(energy, 6) AS energy FROM r WHERE k = 1""")
def w_bounded_background(spark, sf):
    return rounded(W.motion_peak(samples(spark, sf), "x", LANE, ORDER).select("lane", "frame", "energy"))


@query("w_pick_moments", f"""WITH {SAMPLES}, e AS (SELECT *, ntile(6) OVER w AS moment, abs(x - lag(x) OVER w) AS dx FROM s WINDOW w AS (PARTITION BY lane ORDER BY t, frame)),
r AS (SELECT *, row_number() OVER (PARTITION BY lane, moment ORDER BY dx DESC, t, frame) AS k FROM e WHERE dx IS NOT NULL) SELECT lane, CAST(moment AS BIGINT) AS moment, frame FROM r WHERE k = 1""")
def w_pick_moments(spark, sf):
    return W.pick_moments(samples(spark, sf), "x", LANE, ORDER, 6).select("lane", F.col("moment").cast("long"), "frame")


@query("w_local_minima", f"""WITH {SAMPLES}, m AS (SELECT *, min(x) OVER (PARTITION BY lane ORDER BY t, frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS lo FROM s),
b AS (SELECT lane, t AS best FROM (SELECT lane, t, row_number() OVER (PARTITION BY lane ORDER BY x, t) AS k FROM s) WHERE k = 1),
c AS (SELECT m.lane, m.t, m.x, row_number() OVER (PARTITION BY m.lane ORDER BY m.x, m.t) AS k FROM m JOIN b ON m.lane = b.lane WHERE m.x = m.lo AND abs(m.t - b.best) > 86400)
SELECT lane, round(t, 6) AS competing_at, round(x, 6) AS competing FROM c WHERE k = 1""")
def w_local_minima(spark, sf):
    return rounded(W.competing_minimum(samples(spark, sf), "t", "x", LANE, ORDER, 3, 86400.0))


@query("w_trace_up_to", f"""WITH {SAMPLES}, n AS (SELECT lane, t, x, lead(t) OVER w AS t1, lead(x) OVER w AS x1 FROM s WINDOW w AS (PARTITION BY lane ORDER BY t))
SELECT lane, round(t, 6) AS t, round(x, 6) AS x FROM n WHERE t <= 1705000000 UNION ALL
SELECT lane, 1705000000.0 AS t, round(x + (x1 - x) * (1705000000 - t) / (t1 - t), 6) AS x FROM n WHERE t < 1705000000 AND t1 > 1705000000""")
def w_trace_up_to(spark, sf):
    return rounded(W.trace_up_to(samples(spark, sf), "t", "x", LANE, 1705000000.0))


@query("w_detect_nudges", f"""WITH {SAMPLES}, n AS (SELECT lane, frame, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS displacement FROM s WINDOW w AS (PARTITION BY lane ORDER BY t, frame)) SELECT lane, frame, round(displacement, 6) AS displacement FROM n WHERE displacement > 150""")
def w_detect_nudges(spark, sf):
    return rounded(W.nudges(samples(spark, sf), "x", "y", LANE, ORDER, 150.0).select("lane", "frame", "displacement"))


@query("w_jump_flag", f"""WITH {SAMPLES}, n AS (SELECT *, last_value(CASE WHEN ok THEN x END IGNORE NULLS) OVER w AS lx, last_value(CASE WHEN ok THEN y END IGNORE NULLS) OVER w AS ly FROM s WINDOW w AS (PARTITION BY lane ORDER BY t, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT lane, frame, ok AND coalesce(sqrt(power(x - lx, 2) + power(y - ly, 2)) > 80, false) AS jump FROM n""")
def w_jump_flag(spark, sf):
    return W.jump_flag(samples(spark, sf), "x", "y", F.col("ok"), LANE, ORDER, 80.0).select("lane", "frame", "jump")


@query("w_mouse_rank_color", "SELECT c_mktsegment, c_custkey, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) % 6 AS color FROM customer")
def w_mouse_rank_color(spark, sf):
    from chronolane.plans.registry import load

    return W.rank_color(load(spark, sf, "customer"), "c_mktsegment", "c_custkey")


RUNS = f"""{SAMPLES}, e AS (SELECT lane, t, frame, CASE WHEN state IN ('view', 'click') THEN 'mouse' WHEN state IN ('error', 'signup') THEN 'intrusion' ELSE 'empty' END AS st FROM s),
a AS (SELECT *, CASE WHEN lag(st) OVER w IS DISTINCT FROM st THEN 1 ELSE 0 END AS ch, row_number() OVER w - 1 AS pos FROM e WINDOW w AS (PARTITION BY lane ORDER BY t, frame)),
b AS (SELECT *, sum(ch) OVER (PARTITION BY lane ORDER BY t, frame) AS run FROM a),
r AS (SELECT lane, st, min(pos) AS r0, max(pos) AS r1 FROM b GROUP BY lane, run, st),
own AS (SELECT lane, min(CASE WHEN st = 'intrusion' AND r1 - r0 + 1 >= 3 THEN r0 + 2 END) AS own FROM r GROUP BY lane)"""


def staged(spark, sf):
    kind = F.when(F.col("state").isin("view", "click"), "mouse").when(F.col("state").isin("error", "signup"), "intrusion").otherwise("empty")
    return samples(spark, sf).withColumn("st", kind)


@query("w_first_qualifying_run", f"WITH {RUNS} SELECT lane, own AS position FROM own")
def w_first_qualifying_run(spark, sf):
    return W.first_qualifying_run(staged(spark, sf), "st", "intrusion", 3, LANE, ORDER).withColumn("position", F.col("position").cast("long"))


@query("w_entry_state_machine", f"WITH {RUNS} SELECT own.lane, min(CASE WHEN st = 'mouse' AND r1 - greatest(r0, own) + 1 >= 3 AND own IS NOT NULL THEN greatest(r0, own) END) AS entry FROM r JOIN own ON r.lane = own.lane GROUP BY own.lane")
def w_entry_state_machine(spark, sf):
    return W.entry_index(staged(spark, sf), "st", LANE, ORDER, 3, 3).withColumn("entry", F.col("entry").cast("long"))


@query("w_entries_two_lanes", f"""WITH {RUNS}, w2 AS (SELECT lane, own, coalesce(own, min(own) OVER (PARTITION BY lane // 2)) AS seen FROM own)
SELECT lane // 2 AS session, w2.lane, min(CASE WHEN st = 'mouse' AND r1 - greatest(r0, seen) + 1 >= 3 AND seen IS NOT NULL THEN greatest(r0, seen) END) AS entry,
min(CASE WHEN st = 'mouse' AND r1 - greatest(r0, seen) + 1 >= 3 AND seen IS NOT NULL THEN greatest(r0, seen) END) IS NOT NULL AND min(own) IS NULL AS via_other_lane FROM r JOIN w2 USING (lane) GROUP BY 1, 2""".replace("lane // 2 AS session, w2.lane", "w2.lane // 2 AS session, w2.lane"))
def w_entries_two_lanes(spark, sf):
    df = staged(spark, sf).withColumn("session", F.floor(F.col("lane") / 2))
    return W.entries_with_borrowing(df, "st", ["session"], "lane", ORDER, 3, 3).select("session", "lane", F.col("entry").cast("long"), "via_other_lane")


@query("w_tracking_start", f"""WITH {SAMPLES}, e AS (SELECT lane, t, frame, x <= 60 AS okk FROM s),
a AS (SELECT *, CASE WHEN lag(okk) OVER w IS DISTINCT FROM okk THEN 1 ELSE 0 END AS ch FROM e WINDOW w AS (PARTITION BY lane ORDER BY t, frame)),
b AS (SELECT *, sum(ch) OVER (PARTITION BY lane ORDER BY t, frame) AS run, first_value(frame) OVER (PARTITION BY lane ORDER BY t, frame) AS f0 FROM a),
r AS (SELECT lane, run, okk, count(*) AS n, min(t) AS t0 FROM b GROUP BY lane, run, okk),
k AS (SELECT lane, min(run) AS run FROM r WHERE okk AND n >= 8 GROUP BY lane),
g AS (SELECT b.lane, b.frame, row_number() OVER (PARTITION BY b.lane ORDER BY b.t, b.frame) AS q FROM b JOIN k ON b.lane = k.lane AND b.run = k.run)
SELECT l.lane, coalesce(g.frame, 0) AS start_frame, CASE WHEN g.frame IS NULL THEN 'fallback' ELSE 'auto' END AS method FROM (SELECT DISTINCT lane FROM s) l LEFT JOIN (SELECT * FROM g WHERE q = 1) g ON l.lane = g.lane""")
def w_tracking_start(spark, sf):
    return W.tracking_start(samples(spark, sf), F.col("x") <= 60, "frame", LANE, ORDER, 8)
