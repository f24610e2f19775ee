"""Queries over joins, aggregates, column expressions and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolane.operators import aggregates as A
from chronolane.operators import columns as C
from chronolane.operators import joins as J
from chronolane.operators import sampling as S
from chronolane.plans.registry import LANE, SAMPLES, dealt, load, query, rounded, samples
from chronolane.plans.sequence_queries import BOUTS, STEPS, bouts, stepped

DAY = 86400.0

# --- as-of, interpolation and intervals ----------------------------------------------------------

CLICKS = f"""{SAMPLES}, l AS (SELECT lane, frame, t FROM s WHERE state = 'click'), r AS (SELECT lane, t, x FROM s WHERE state = 'view')"""


def _sides(spark, sf):
    s = samples(spark, sf)
    return s.filter("state = 'click'").select("lane", "frame", "t"), s.filter("state = 'view'").select("lane", "t", "x")


BRACKET = f"""{CLICKS}, k AS (SELECT lane, frame, t, 1 AS side, NULL AS rt, NULL AS rx FROM l UNION ALL SELECT lane, NULL, t, 0, t, x FROM r),
w AS (SELECT *, last_value(rt IGNORE NULLS) OVER b AS bt, last_value(rx IGNORE NULLS) OVER b AS bx, first_value(rt IGNORE NULLS) OVER f AS ft, first_value(rx IGNORE NULLS) OVER f AS fx FROM k
 WINDOW b AS (PARTITION BY lane ORDER BY t, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY lane ORDER BY t, side ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
h AS (SELECT * FROM w WHERE side = 1)"""


@query("j_asof_nearest", f"""WITH {CLICKS}, d AS (SELECT l.lane, l.frame, r.x, row_number() OVER (PARTITION BY l.lane, l.frame ORDER BY abs(l.t - r.t), r.t) AS k FROM l JOIN r ON l.lane = r.lane WHERE abs(l.t - r.t) <= 21600)
SELECT l.lane, l.frame, round(d.x, 6) AS x FROM l LEFT JOIN (SELECT * FROM d WHERE k = 1) d ON l.lane = d.lane AND l.frame = d.frame""")
def j_asof_nearest(spark, sf):
    left, right = _sides(spark, sf)
    return rounded(J.asof_nearest(left, right, LANE, "t", ["x"], 21600.0).select("lane", "frame", "x"))


@query("s_sort_stable_restore", f"""WITH {CLICKS}, d AS (SELECT l.lane, l.frame, r.t AS rt, row_number() OVER (PARTITION BY l.lane, l.frame ORDER BY abs(l.t - r.t), r.t) AS k FROM l JOIN r ON l.lane = r.lane)
SELECT row_number() OVER (ORDER BY l.frame) AS place, l.frame, round(d.rt, 6) AS matched_t FROM l LEFT JOIN (SELECT * FROM d WHERE k = 1) d ON l.lane = d.lane AND l.frame = d.frame""")
def s_sort_stable_restore(spark, sf):
    left, right = _sides(spark, sf)
    left = S.global_row_number(left, [F.col("frame")], "place")
    return rounded(J.asof_nearest(left, right, LANE, "t", ["x"], 1e12).select("place", "frame", "matched_t"))


@query("j_interp_at_time", f"""WITH {BRACKET} SELECT lane, frame, round(CASE WHEN least(t - bt, ft - t) <= 86400 THEN CASE WHEN t = bt THEN bx WHEN bt IS NULL THEN fx WHEN ft IS NULL THEN bx ELSE bx + (fx - bx) * (t - bt) / (ft - bt) END END, 6) AS value FROM h""")
def j_interp_at_time(spark, sf):
    left, right = _sides(spark, sf)
    return rounded(J.interpolate_at(left, right, LANE, "t", "x", "value", max_gap=DAY).select("lane", "frame", "value"))


@query("j_interp_gap_limited", f"""WITH {BRACKET} SELECT lane, frame, round(CASE WHEN t = bt THEN bx WHEN ft - bt <= 172800 THEN bx + (fx - bx) * (t - bt) / (ft - bt) END, 6) AS value FROM h""")
def j_interp_gap_limited(spark, sf):
    left, right = _sides(spark, sf)
    return rounded(J.interpolate_at(left, right, LANE, "t", "x", "value", max_bracket=2 * DAY, clamp=False).select("lane", "frame", "value"))


@query("j_interval_frames_in_bout", f"WITH {BOUTS} SELECT s.lane, s.frame, bouts.bout_index FROM s JOIN bouts ON s.lane = bouts.lane AND s.t BETWEEN bout_start_sec AND bout_end_sec WHERE s.ok")
def j_interval_frames_in_bout(spark, sf):
    return J.frames_in_bouts(samples(spark, sf), bouts(spark, sf), LANE, "t", valid=F.col("ok")).select("lane", "frame", "bout_index")


@query("j_interval_nonempty", f"WITH {BOUTS} SELECT lane, bout_index FROM bouts WHERE EXISTS (SELECT 1 FROM s WHERE s.lane = bouts.lane AND s.state = 'purchase' AND s.t BETWEEN bout_start_sec AND bout_end_sec)")
def j_interval_nonempty(spark, sf):
    return J.nonempty_bouts(samples(spark, sf), bouts(spark, sf), LANE, "t", valid=F.col("state") == "purchase").select("lane", "bout_index")


@query("j_interval_overlap", f"WITH {BOUTS} SELECT lane, bout_index FROM bouts WHERE bout_end_sec >= 1704900000 - 3600 AND bout_start_sec <= 1705000000 + 3600")
def j_interval_overlap(spark, sf):
    return J.overlapping(bouts(spark, sf), 1704900000.0, 1705000000.0, 3600.0).select("lane", "bout_index")


@query("j_interval_two_clock", f"""WITH {BOUTS}, a AS (SELECT b.lane, b.bout_index, quantile_cont(s.x, 0.5) AS median_a, count(s.x) AS n_a FROM bouts b JOIN s ON s.lane = b.lane AND s.t BETWEEN bout_start_sec AND bout_end_sec WHERE ok GROUP BY 1, 2),
d AS (SELECT b.lane, b.bout_index, quantile_cont(s.x, 0.5) AS median_b, count(s.x) AS n_b FROM bouts b JOIN s ON s.lane = b.lane AND s.t BETWEEN bout_start_sec + 3600.0 AND bout_end_sec + 3600.0 GROUP BY 1, 2)
SELECT a.lane, a.bout_index, round(median_a, 6) AS median_a, n_a, round(median_b, 6) AS median_b, n_b FROM a JOIN d ON a.lane = d.lane AND a.bout_index = d.bout_index WHERE n_a >= 3 AND n_b >= 3""")
def j_interval_two_clock(spark, sf):
    s = samples(spark, sf)
    return rounded(J.matched_medians(bouts(spark, sf), s.filter("ok"), s, LANE, "t", "x", F.lit(3600.0), 3))


@query("j_lane_window", f"""WITH {BOUTS}, e AS (SELECT lane, min(t) AS entry, max(t) AS lane_end FROM s GROUP BY lane)
SELECT bouts.lane, bout_index, round(bout_start_sec, 6) AS bout_start_sec, round(least(bout_end_sec, entry + 1728000), 6) AS bout_end_sec FROM bouts JOIN e ON bouts.lane = e.lane WHERE lane_end >= entry + 1728000 AND bout_start_sec < entry + 1728000""")
def j_lane_window(spark, sf):
    entries = samples(spark, sf).groupBy("lane").agg(F.min("t").alias("entry"), F.max("t").alias("lane_end"))
    return rounded(J.clip_to_window(bouts(spark, sf), entries, LANE, "entry", 20 * DAY, "lane_end").select("lane", "bout_index", "bout_start_sec", "bout_end_sec"))


@query("f_after_entry", f"WITH {BOUTS}, e AS (SELECT lane, min(t) AS entry FROM s WHERE state = 'purchase' GROUP BY lane) SELECT bouts.lane, bout_index FROM bouts JOIN e ON bouts.lane = e.lane WHERE bout_start_sec >= entry")
def f_after_entry(spark, sf):
    entries = samples(spark, sf).filter("state = 'purchase'").groupBy("lane").agg(F.min("t").alias("entry"))
    return bouts(spark, sf).join(entries, "lane").filter("bout_start_sec >= entry").select("lane", "bout_index")


@query("p_bout_in_window", f"WITH {BOUTS} SELECT s.lane, s.frame, EXISTS (SELECT 1 FROM bouts b WHERE b.lane = s.lane AND s.t BETWEEN bout_start_sec AND bout_end_sec) AS inside FROM s")
def p_bout_in_window(spark, sf):
    return J.inside_any(samples(spark, sf), bouts(spark, sf), LANE, "t", "inside").select("lane", "frame", "inside")


# --- lookups --------------------------------------------------------------------------------------
# customers with even keys form the lookup, some of them twice; the token is the last digits of the name

LUT = """lut AS (SELECT c_name AS stem, CAST(c_nationkey AS VARCHAR) AS lane, right(c_name, 3) AS token, c_mktsegment AS virus, c_custkey FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_name, CAST(c_nationkey AS VARCHAR), right(c_name, 3), c_mktsegment, c_custkey FROM customer WHERE c_custkey % 20 = 0),
files AS (SELECT c_custkey AS file, c_name AS stem, CAST(c_nationkey AS VARCHAR) AS lane, right(c_name, 3) AS token FROM customer),
x AS (SELECT f.file, count(l.stem) AS n, min(l.virus) AS v FROM files f LEFT JOIN lut l ON f.stem = l.stem AND f.lane = l.lane GROUP BY f.file),
k AS (SELECT f.file, count(l.stem) AS n, min(l.virus) AS v FROM files f LEFT JOIN lut l ON f.token = l.token AND f.lane = l.lane GROUP BY f.file),
rep AS (SELECT x.file, CASE WHEN x.n = 1 THEN 'matched_exact' WHEN x.n > 1 THEN 'ambiguous_exact' WHEN k.n = 1 THEN 'matched_token' WHEN k.n > 1 THEN 'ambiguous_token' ELSE 'unmatched' END AS status,
 CASE WHEN x.n = 1 THEN x.v WHEN x.n = 0 AND k.n = 1 THEN k.v END AS virus FROM x JOIN k ON x.file = k.file)"""


def lookup(spark, sf):
    c = load(spark, sf, "customer")
    cols = [F.col("c_name").alias("stem"), F.col("c_nationkey").cast("string").alias("lane"), F.expr("right(c_name, 3)").alias("token")]
    meta = c.select(*cols, F.col("c_mktsegment").alias("virus"), "c_custkey")
    return meta.filter("c_custkey % 2 = 0").union(meta.filter("c_custkey % 20 = 0")), c.select(F.col("c_custkey").alias("file"), *cols)


def resolved(spark, sf):
    lut, files = lookup(spark, sf)
    sides = lambda *names: ([F.col(n) for n in names], [F.col(n) for n in names])
    return J.resolve(files, lut, sides("stem", "lane"), sides("token", "lane"))


@query("j_lut_exact", f"WITH {LUT} SELECT x.file, x.n FROM x")
def j_lut_exact(spark, sf):
    lut, files = lookup(spark, sf)
    keys = [F.col("stem"), F.col("lane")]
    return J.unique_lookup(files, lut, keys, keys, "hit").select("file", F.col("hit_n").alias("n"))


@query("j_lut_token_fallback", f"WITH {LUT} SELECT file, status, virus FROM rep")
def j_lut_token_fallback(spark, sf):
    return resolved(spark, sf).select("file", "status", F.col("meta.virus").alias("virus"))


@query("j_metadata_attach", f"WITH {LUT} SELECT o_orderkey, rep.virus FROM orders JOIN rep ON o_custkey = rep.file WHERE status LIKE 'matched%'")
def j_metadata_attach(spark, sf):
    facts = load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("file"))
    return J.attach_metadata(facts, resolved(spark, sf), "file", ["virus"]).select("o_orderkey", "virus")


@query("a_join_coverage", f"WITH {LUT} SELECT count(*) FILTER (status LIKE 'matched%') AS matched, count(*) FILTER (status = 'unmatched') AS unmatched, count(*) FILTER (status LIKE 'ambiguous%') AS ambiguous FROM rep")
def a_join_coverage(spark, sf):
    return A.coverage(resolved(spark, sf))


@query("a_status_counts", f"WITH {LUT} SELECT status, count(*) AS n FROM rep GROUP BY status")
def a_status_counts(spark, sf):
    return resolved(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("j_lut_lane_lookup", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j_lut_lane_lookup(spark, sf):
    lanes = J.guard_unique(load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), ["c_nationkey"])
    return load(spark, sf, "customer").join(lanes, "c_nationkey").select("c_custkey", "n_name")


@query("j_lookup_left_strict", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j_lookup_left_strict(spark, sf):
    nations = load(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return J.strict_left(load(spark, sf, "supplier"), nations, ["s_nationkey"]).select("s_suppkey", "n_name")


@query("j_distinct_dim_left", "SELECT l_orderkey, l_linenumber, p.brand FROM lineitem LEFT JOIN (SELECT DISTINCT p_partkey, p_brand AS brand FROM part) p ON l_partkey = p.p_partkey")
def j_distinct_dim_left(spark, sf):
    dim = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    return J.strict_left(load(spark, sf, "lineitem"), dim, ["l_partkey"], strict=False).select("l_orderkey", "l_linenumber", "brand")


@query("j_fill_missing_dim", "SELECT o_orderkey, d.part FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey) d ON o_orderkey = d.l_orderkey")
def j_fill_missing_dim(spark, sf):
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part"))
    return J.fill_dimension(load(spark, sf, "orders").select("o_orderkey"), lines, ["o_orderkey"], ["part"])


@query("j_override", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_custkey % 5 = 0 AS overridden FROM customer")
def j_override(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return J.override(c, c.filter("c_custkey % 5 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"], ["c_acctbal"])


@query("j_append_missing", "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def j_append_missing(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey")
    return J.append_missing(c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 3 = 0"), ["c_custkey"])


@query("j_setlookup", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def j_setlookup(spark, sf):
    chosen = load(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return load(spark, sf, "supplier").join(chosen, "s_nationkey", "left_semi").select("s_suppkey")


@query("j_status_counts", "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
def j_status_counts(spark, sf):
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return J.count_lookup(load(spark, sf, "customer").select("c_custkey"), orders, ["c_custkey"], "n_orders")


@query("j_pair_lookup_check", "SELECT coalesce(a.k, b.k) AS k, a.v AS left_value, b.v AS right_value FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer) a FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def j_pair_lookup_check(spark, sf):
    a = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    return J.mismatches(a, load(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v")), ["k"], "v")


def _three(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("unit"), "o_orderkey")
    return [o.filter("o_orderkey % 3 = 0"), o.filter("o_orderkey % 3 = 1"), o.filter("o_orderkey % 3 = 2")]


for _name, _pick in (("scan_multi_latest_wins", "max"), ("scan_first_existing_wins", "min")):
    query(_name, f"SELECT unit, o_orderkey FROM (SELECT o_custkey AS unit, o_orderkey, o_orderkey % 3 AS src, {_pick}(o_orderkey % 3) OVER (PARTITION BY o_custkey) AS pick FROM orders) WHERE src = pick")(
        lambda spark, sf, last=_pick == "max": J.by_precedence(_three(spark, sf), ["unit"], last)
    )


@query("scan_dup_lane_guard", "SELECT o_custkey AS unit, count(DISTINCT o_orderkey % 3) AS n_sources, true AS refused FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 3) > 1")
def scan_dup_lane_guard(spark, sf):
    """Units of several sources, and that a reader who wants one source a unit is refused them."""
    found = J.duplicates(_three(spark, sf), ["unit"])
    every = reduce(DataFrame.unionByName, [s.select("unit").distinct() for s in _three(spark, sf)])
    try:
        J.guard_unique(every, ["unit"]).write.format("noop").mode("overwrite").save()
        refused = False
    except Exception as e:  # the guard's own error is a failure of the job
        if "duplicate key" not in str(e):
            raise
        refused = True
    return found.withColumn("refused", F.lit(refused))


@query("scan_duplicate_key_guard", "SELECT c_custkey, c_name FROM customer")
def scan_duplicate_key_guard(spark, sf):
    return J.guard_unique(load(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"])


# --- units: customer is the animal, segment the group, return flag the treatment, line status the state

LINES = "ln AS (SELECT l_orderkey AS session, c_custkey AS mouse, c_mktsegment AS virus, l_returnflag AS injection, l_linestatus = 'O' AS stationary, l_extendedprice AS y, l_quantity AS q, l_discount AS disc FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


def lines(spark, sf):
    li, o, c = (load(spark, sf, n) for n in ("lineitem", "orders", "customer"))
    joined = dealt(li, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("l_orderkey").alias("session"), F.col("c_custkey").alias("mouse"), F.col("c_mktsegment").alias("virus"), F.col("l_returnflag").alias("injection"), (F.col("l_linestatus") == "O").alias("stationary"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("disc"))


@query("a_descriptive", f"WITH {LINES} SELECT virus, injection, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS sd, count(y) AS n, round(stddev_samp(y) / sqrt(count(y)), 4) AS se FROM ln GROUP BY 1, 2")
def a_descriptive(spark, sf):
    return rounded(A.descriptive(lines(spark, sf), "y", ["virus", "injection", "absent"]), 4)


@query("a_unit_means", f"WITH {LINES} SELECT mouse, virus, injection, stationary, round(avg(y), 8) AS unit_mean, count(y) AS n FROM ln GROUP BY 1, 2, 3, 4")
def a_unit_means(spark, sf):
    return rounded(A.unit_means(lines(spark, sf), "y", ["mouse"], ["virus", "injection", "stationary"]), 8)


UNITS = f"{LINES}, u AS (SELECT mouse, virus, injection, avg(y) AS m FROM ln GROUP BY 1, 2, 3)"
SEM = "CASE WHEN count(m) <= 1 THEN 0.0 ELSE stddev_samp(m) / sqrt(count(m)) END"


@query("a_two_level_mean", f"WITH {UNITS} SELECT virus, injection, round(avg(m), 4) AS mean, round({SEM}, 4) AS sem, count(*) AS n_units FROM u GROUP BY 1, 2")
def a_two_level_mean(spark, sf):
    return rounded(A.two_level_mean(lines(spark, sf), "y", ["mouse"], ["virus", "injection"]), 4)


@query("a_sem_zero", f"WITH {LINES}, u AS (SELECT mouse, session, y AS m FROM ln) SELECT mouse, session, round({SEM}, 4) AS sem FROM u GROUP BY 1, 2")
def a_sem_zero(spark, sf):
    return rounded(lines(spark, sf).groupBy("mouse", "session").agg(A.sem("y").alias("sem")), 4)


def _timecourse(name, width, least, bin_sql, bin_col):
    sql = f"""WITH {SAMPLES}, b AS (SELECT lane, state, {bin_sql} AS bin, x FROM s), u AS (SELECT lane, state, bin, avg(x) AS m FROM b GROUP BY 1, 2, 3)
SELECT state, CAST(bin AS DOUBLE) AS bin, round(avg(m), 6) AS mean, round({SEM}, 6) AS sem, count(*) AS n_units FROM u GROUP BY 1, 2 HAVING count(*) >= {least}"""
    query(name, sql)(lambda spark, sf: rounded(A.timecourse(samples(spark, sf), "x", bin_col().cast("double"), LANE, ["state"], least)))


_timecourse("a_timecourse", DAY, 1, "floor(t / 86400) * 86400", lambda: C.floor_bin(F.col("t"), DAY))
_timecourse("a_floor_timecourse", 43200, 1, "floor(t / 43200) * 43200 + 21600", lambda: C.floor_bin(F.col("t"), 43200.0, True))
_timecourse("a_activity_timecourse", 1440, 2, "(floor(t / 60 / 1440) + 0.5) * 1440", lambda: C.minute_bin(F.col("t"), 1440))


@query("a_experiment_means", f"WITH {LINES} SELECT session, mouse, virus, stationary, round(avg(y), 8) AS unit_mean, count(y) AS n FROM ln GROUP BY 1, 2, 3, 4")
def a_experiment_means(spark, sf):
    return rounded(A.unit_means(lines(spark, sf), "y", ["session", "mouse"], ["virus", "stationary"]), 8)


@query("a_time_weighted_states", f"""WITH {LINES}, p AS (SELECT mouse, avg(CASE WHEN stationary THEN y END) AS mi, avg(CASE WHEN NOT stationary THEN y END) AS mo, sum(CASE WHEN stationary THEN q END) AS wi, sum(CASE WHEN NOT stationary THEN q END) AS wo FROM ln GROUP BY 1)
SELECT mouse, round(CASE WHEN mi IS NULL THEN mo WHEN mo IS NULL THEN mi WHEN wi + wo > 0 THEN (mi * wi + mo * wo) / (wi + wo) ELSE coalesce(mi, mo) END, 4) AS weighted_mean FROM p""")
def a_time_weighted_states(spark, sf):
    return rounded(A.time_weighted(lines(spark, sf), "y", F.col("stationary"), F.col("q"), ["mouse"]), 4)


@query("a_floor_means", f"WITH {LINES} SELECT mouse, round(avg(y), 8) AS mean_y, round(quantile_cont(CASE WHEN NOT stationary THEN y END, 0.5), 8) AS median_moving FROM ln GROUP BY mouse")
def a_floor_means(spark, sf):
    return rounded(lines(spark, sf).groupBy("mouse").agg(F.avg("y").alias("mean_y"), F.percentile(F.when(~F.col("stationary"), F.col("y")), 0.5).alias("median_moving")), 8)


@query("a_bouts_per_session", f"WITH {LINES}, c AS (SELECT session, mouse, virus, count(*) AS n FROM ln GROUP BY 1, 2, 3) SELECT mouse, virus, round(avg(n), 6) AS mean_count, count(*) AS n_sessions FROM c GROUP BY 1, 2")
def a_bouts_per_session(spark, sf):
    return rounded(A.count_then_mean(lines(spark, sf), ["session"], ["mouse"], ["virus"]))


@query("a_bout_duration_mean", f"WITH {BOUTS} SELECT lane, round(avg(bout_duration_sec), 6) AS mean_duration FROM bouts GROUP BY lane")
def a_bout_duration_mean(spark, sf):
    return rounded(bouts(spark, sf).groupBy("lane").agg(F.avg("bout_duration_sec").alias("mean_duration")))


@query("a_bout_count_by_group", f"""WITH {LINES}, g AS (SELECT virus, 'y' AS metric, y AS m FROM ln UNION ALL SELECT virus, 'q', q FROM ln UNION ALL SELECT virus, 'disc', disc FROM ln)
SELECT virus, metric, round(avg(m), 4) AS mean, round({SEM}, 4) AS sem, count(m) AS n FROM g GROUP BY 1, 2""")
def a_bout_count_by_group(spark, sf):
    return rounded(A.unpivoted_mean(lines(spark, sf), ["y", "q", "disc"], ["virus"]), 4)


@query("a_boxplot_stats", f"""WITH {LINES}, b AS (SELECT virus, count(y) AS n, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS q3 FROM ln GROUP BY virus)
SELECT b.virus, b.n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(y) AS low, max(y) AS high FROM b JOIN ln ON b.virus = ln.virus AND y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def a_boxplot_stats(spark, sf):
    return rounded(A.boxplot(lines(spark, sf), "y", ["virus"]), 4)


@query("a_histogram_density", f"""WITH {LINES}, e AS (SELECT *, min(y) OVER (PARTITION BY virus) AS lo, max(y) OVER (PARTITION BY virus) AS hi FROM ln),
b AS (SELECT virus, CAST(least(19, floor((y - lo) / ((hi - lo) / 20))) AS BIGINT) AS bin, (hi - lo) / 20 AS width FROM e)
SELECT virus, bin, count(*) AS n, round(min(width), 6) AS width, round(count(*) / (sum(count(*)) OVER (PARTITION BY virus) * min(width)), 12) AS density FROM b GROUP BY virus, bin""")
def a_histogram_density(spark, sf):
    out = A.histogram(lines(spark, sf), "y", ["virus"], 20)
    return out.withColumns({"width": F.round("width", 6), "density": F.round("density", 12)})


@query("a_yield_by_zone", "SELECT CASE WHEN p_retailprice <= 1000 THEN 'cool' WHEN p_retailprice >= 1800 THEN 'hot' ELSE 'mid' END AS zone, round(avg(CASE WHEN p_size > 25 THEN 1 ELSE 0 END), 6) AS yield FROM part GROUP BY 1")
def a_yield_by_zone(spark, sf):
    p = load(spark, sf, "part").select(C.zone(F.col("p_retailprice"), 1000, 1800).alias("zone"), (F.col("p_size") > 25).alias("valid"))
    return rounded(A.yields(p, "valid", "zone"))


@query("p_classify_zone", "SELECT p_partkey, CASE WHEN p_retailprice <= 1000 THEN 'cool' WHEN p_retailprice >= 1800 THEN 'hot' ELSE 'mid' END AS zone FROM part")
def p_classify_zone(spark, sf):
    return load(spark, sf, "part").select("p_partkey", C.zone(F.col("p_retailprice"), 1000, 1800).alias("zone"))


@query("a_average_valid", "SELECT p_brand, p_type, round(CASE WHEN count(p_retailprice) >= 10 THEN avg(p_retailprice) END, 6) AS price FROM part GROUP BY 1, 2")
def a_average_valid(spark, sf):
    return rounded(load(spark, sf, "part").groupBy("p_brand", "p_type").agg(A.average_valid("p_retailprice", 10).alias("price")))


@query("a_landmark_bout_rollup", f"""WITH {LINES}, g AS (SELECT mouse, count(*) AS n_attempted FROM ln GROUP BY 1), r AS (SELECT mouse, y, q, stationary, CASE WHEN disc > 0.08 THEN 'high' WHEN disc < 0.02 THEN 'low' END AS why FROM ln WHERE q >= 5),
o AS (SELECT mouse, round(CASE WHEN count(y) >= 2 THEN avg(y) END, 8) AS y, round(CASE WHEN count(q) >= 2 THEN avg(q) END, 8) AS q, bool_or(stationary) AS any_valid, coalesce(string_agg(DISTINCT why, '; ' ORDER BY why), '') AS reasons, count(*) AS n_averaged FROM r GROUP BY 1)
SELECT g.mouse, n_attempted, y, q, any_valid, reasons, n_averaged FROM g LEFT JOIN o ON g.mouse = o.mouse""")
def a_landmark_bout_rollup(spark, sf):
    df = lines(spark, sf).withColumn("why", C.reasons((F.col("disc") > 0.08, "high"), (F.col("disc") < 0.02, "low")))
    return rounded(A.bout_rollup(df, ["mouse"], F.col("q") >= 5, ["y", "q"], "stationary", "why", 2), 8)


@query("a_qc_summary", f"""WITH {SAMPLES} SELECT lane, count(*) AS n_rows, round(100 * avg(CASE WHEN state = 'view' THEN 1.0 ELSE 0.0 END), 1) AS percent_ok, round(100 * avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 1) AS percent_valid, round(quantile_cont(x, 0.5), 6) AS median_confidence, count(*) FILTER (state = 'error') AS n_error FROM s GROUP BY lane""")
def a_qc_summary(spark, sf):
    df = samples(spark, sf).withColumn("flag", F.when(F.col("state") == "view", "ok").otherwise(F.col("state")))
    found = A.qc_summary(df, LANE, "flag", "ok", "x")
    return found.select("lane", "n_rows", "percent_ok", "percent_valid", F.round("median_confidence", 6).alias("median_confidence"), F.coalesce(F.try_element_at("flags", F.lit("error")), F.lit(0)).alias("n_error"))


LANES = f"""{SAMPLES}, fit AS (SELECT lane // 2 AS session, 'L' || CAST(lane % 2 AS VARCHAR) AS lane, round(avg(x), 4) AS offset_sec, round(avg(y) / 1000, 6) AS drift_slope, CASE WHEN count(*) > 66 THEN 10.0 ELSE 8.0 END AS camera_fps, CASE WHEN avg(x) > 55 THEN 'poor_fit' ELSE '' END AS flags FROM s GROUP BY 1, 2),
g AS (SELECT *, flags = '' AS clean, count(*) FILTER (flags = '') OVER (PARTITION BY session) AS nc FROM fit)"""


@query("a_session_sync_consolidate", f"""WITH {LANES}, a AS (SELECT session, avg(CASE WHEN clean OR nc = 0 THEN offset_sec END) AS o, avg(CASE WHEN clean OR nc = 0 THEN drift_slope END) AS d, count(*) AS n_lanes, count(*) FILTER (clean) AS n_clean_lanes,
 CASE WHEN count(*) > 1 THEN max(offset_sec) - min(offset_sec) END AS sp, count(DISTINCT camera_fps) AS rates FROM g GROUP BY session)
SELECT session, round(o, 3) AS offset_sec, n_lanes, n_clean_lanes, round(sp, 4) AS lane_spread_sec, n_clean_lanes = 0 OR coalesce(sp > 5, false) OR rates > 1 AS low_confidence,
 concat_ws(';', CASE WHEN n_clean_lanes = 0 THEN 'no_clean_lane' END, CASE WHEN sp > 5 THEN 'lane_disagreement' END, CASE WHEN rates > 1 THEN 'lane_fps_mismatch' END) AS low_confidence_reasons,
 concat_ws(';', CASE WHEN n_lanes = 1 THEN 'single_lane' END, CASE WHEN abs(o) > 55 THEN 'large_offset' END) AS review_reasons FROM a""")
def a_session_sync_consolidate(spark, sf):
    s = samples(spark, sf)
    per = s.groupBy("lane").agg(F.round(F.avg("x"), 4).alias("offset_sec"), F.round(F.avg("y") / 1000, 6).alias("drift_slope"), F.when(F.count("*") > 66, 10.0).otherwise(8.0).alias("camera_fps"), F.when(F.avg("x") > 55, "poor_fit").otherwise("").alias("flags"))
    per = per.withColumns({"session": F.floor(F.col("lane") / 2), "lane": F.concat(F.lit("L"), (F.col("lane") % 2).cast("string"))})
    found = A.consolidate_sync(per, 5.0, 55.0)
    return found.select("session", "offset_sec", "n_lanes", "n_clean_lanes", F.round("lane_spread_sec", 4).alias("lane_spread_sec"), "low_confidence", "low_confidence_reasons", "review_reasons")


@query("a_homography_correction_summary", "SELECT p_brand, round(avg(p_retailprice), 6) AS mean, min(p_retailprice) AS min, max(p_retailprice) AS max, count(*) FILTER (p_size < 10) AS n_bad FROM part GROUP BY 1")
def a_homography_correction_summary(spark, sf):
    return rounded(A.spread(load(spark, sf, "part"), "p_retailprice", ["p_brand"], F.col("p_size") < 10))


@query("a_pivot_counts", f"WITH {LINES} SELECT mouse, count(*) FILTER (injection = 'A') AS n_A, count(*) FILTER (injection = 'N') AS n_N, count(*) FILTER (injection = 'R') AS n_R FROM ln GROUP BY mouse")
def a_pivot_counts(spark, sf):
    return A.pivot_counts(lines(spark, sf), ["mouse"], "injection", ["A", "N", "R"])


@query("a_session_distinct_first", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def a_session_distinct_first(spark, sf):
    return A.distinct_first(load(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("a_lane_activity", f"WITH {STEPS} SELECT lane, round(sum(step), 6) AS distance, round(avg(CASE WHEN dt > 0 AND dt <= 43200 THEN step / dt END), 9) AS mean_speed, round(max(t), 6) AS last_time, round(sum(CASE WHEN dt > 43200 THEN dt ELSE 0 END), 6) AS gap_time FROM q GROUP BY lane")
def a_lane_activity(spark, sf):
    out = A.lane_activity(stepped(spark, sf), LANE, "t", 43200.0)
    return out.withColumns({c: F.round(c, 9 if c == "mean_speed" else 6) for c in ("distance", "mean_speed", "last_time", "gap_time")})


@query("a_feasibility", f"""WITH {LINES}, a AS (SELECT virus AS l, count(*) AS n FROM ln GROUP BY 1), b AS (SELECT injection AS l, count(*) AS n FROM ln GROUP BY 1), t AS (SELECT count(*) AS n_rows, count(DISTINCT mouse) AS n_units FROM ln)
SELECT n_rows, n_units, CASE WHEN n_rows < 20 THEN 'too few rows' WHEN n_units < 3 THEN 'too few units' WHEN least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) < 2 THEN 'a factor has one level' WHEN least((SELECT min(n) FROM a), (SELECT min(n) FROM b)) < 1000000 THEN 'a level has too few rows' END AS reason FROM t""")
def a_feasibility(spark, sf):
    return A.feasibility(lines(spark, sf), "y", ["virus", "injection"], "mouse", 20, 3, 1000000)


PAIRED = f"{LINES}, w AS (SELECT mouse, virus, avg(CASE WHEN injection = 'A' THEN y END) - avg(CASE WHEN injection = 'R' THEN y END) AS d FROM ln GROUP BY 1, 2)"


@query("a_paired_t", f"WITH {PAIRED} SELECT virus, count(d) AS n, round(avg(d), 4) AS mean_diff, round(stddev_samp(d), 4) AS sd_diff, round(stddev_samp(d) / sqrt(count(d)), 4) AS se, round(avg(d) / nullif(stddev_samp(d) / sqrt(count(d)), 0), 6) AS t, CASE WHEN count(d) > 1 THEN count(d) - 1 END AS df FROM w GROUP BY virus")
def a_paired_t(spark, sf):
    out = A.paired_moments(lines(spark, sf), "y", ["mouse"], ["virus"], "injection", "A", "R")
    return out.withColumns({c: F.round(c, 6 if c == "t" else 4) for c in ("mean_diff", "sd_diff", "se", "t")})


@query("a_n_label", f"WITH {LINES} SELECT virus, 'n = ' || CAST(count(DISTINCT mouse) AS VARCHAR) AS label FROM ln GROUP BY virus")
def a_n_label(spark, sf):
    return A.n_label(lines(spark, sf), "mouse", ["virus"])


@query("a_paired_count", f"WITH {LINES} SELECT count(*) AS n_paired FROM (SELECT mouse FROM ln WHERE injection IN ('A', 'R') GROUP BY mouse HAVING count(DISTINCT injection) = 2)")
def a_paired_count(spark, sf):
    return A.paired_units(lines(spark, sf), ["mouse"], "injection", ["A", "R"])


@query("a_landmark_error_tables", f"WITH {LINES} SELECT virus, round(avg(y - 50000), 4) AS mean_error, round(avg(abs(y - 50000)), 4) AS mean_abs_error, count(*) AS n FROM ln GROUP BY virus")
def a_landmark_error_tables(spark, sf):
    return rounded(A.error_table(lines(spark, sf).withColumn("e", F.col("y") - 50000), "e", ["virus"]), 4)


@query("a_percentile_summary", f"WITH {SAMPLES} SELECT " + ", ".join(f"round(quantile_cont(x, {p / 100}), 6) AS p{p}" for p in (1, 5, 25, 50, 75, 95, 99)) + ", " + ", ".join(f"round(avg(CASE WHEN x <= {b} THEN 1.0 ELSE 0.0 END), 6) AS share_le_{b}" for b in (10, 100)) + " FROM s")
def a_percentile_summary(spark, sf):
    return rounded(A.percentile_summary(samples(spark, sf), "x", [1, 5, 25, 50, 75, 95, 99], [10, 100]))


@query("a_diff_percentiles_gate", f"WITH {SAMPLES} SELECT round(quantile_cont(abs(x - y), 0.5), 6) AS p50, round(quantile_cont(abs(x - y), 0.95), 6) AS p95, round(avg(abs(x - y)), 6) AS mean, round(max(abs(x - y)), 6) AS max, quantile_cont(abs(x - y), 0.95) <= 200 AND max(abs(x - y)) <= 1000 AS ok FROM s")
def a_diff_percentiles_gate(spark, sf):
    return rounded(A.difference_gate(samples(spark, sf), "x", "y", 200.0, 1000.0))


# --- filters --------------------------------------------------------------------------------------


@query("f_valid_rows", f"WITH {SAMPLES} SELECT lane, frame FROM s WHERE state = 'view' AND ok")
def f_valid_rows(spark, sf):
    df = samples(spark, sf).withColumns({"qc_flag": F.when(F.col("state") == "view", "ok").otherwise(F.col("state")), "mouse_roi_valid": F.col("ok")})
    return df.filter(C.valid_row()).select("lane", "frame")


@query("f_outcome_applicable", f"WITH {SAMPLES} SELECT lane, frame FROM s WHERE x IS NOT NULL AND ok")
def f_outcome_applicable(spark, sf):
    return C.applicable(samples(spark, sf).withColumn("qc_valid", F.col("ok")), "x", True).select("lane", "frame")


@query("f_excluded_split", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_mktsegment = 'BUILDING' THEN 'segment' END AS reason FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
def f_excluded_split(spark, sf):
    c = load(spark, sf, "customer")
    return C.split_excluded(c, (F.col("c_acctbal") < 0, "negative"), (F.col("c_mktsegment") == "BUILDING", "segment"))[1].select("c_custkey", "reason")


@query("f_experimental_scope", f"WITH {LINES} SELECT session, mouse, y FROM ln WHERE virus IN ('BUILDING', 'MACHINERY') AND injection IN ('A', 'R') AND stationary")
def f_experimental_scope(spark, sf):
    return lines(spark, sf).filter(F.col("virus").isin("BUILDING", "MACHINERY") & F.col("injection").isin("A", "R") & F.col("stationary")).select("session", "mouse", "y")


@query("f_craniotomy_contrast", f"WITH {LINES} SELECT session, mouse, CASE WHEN stationary THEN 'post' ELSE 'pre' END AS label FROM ln WHERE (stationary AND injection = 'N') OR (NOT stationary AND injection = 'A')")
def f_craniotomy_contrast(spark, sf):
    df = lines(spark, sf).filter((F.col("stationary") & (F.col("injection") == "N")) | (~F.col("stationary") & (F.col("injection") == "A")))
    return df.select("session", "mouse", C.cases((F.col("stationary"), "post"), otherwise="pre").alias("label"))


@query("f_nestlet_tier", "SELECT c_custkey, 'all' AS tier FROM customer UNION ALL SELECT c_custkey, 'rich' FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, 'poor' FROM customer WHERE c_acctbal <= 5000")
def f_nestlet_tier(spark, sf):
    return C.tiers(load(spark, sf, "customer"), "tier", all=F.lit(True), rich=F.col("c_acctbal") > 5000, poor=F.col("c_acctbal") <= 5000).select("c_custkey", "tier")


@query("f_timecourse_scope", f"WITH {LINES} SELECT count(*) AS n FROM ln WHERE NOT stationary OR injection IN ('N')")
def f_timecourse_scope(spark, sf):
    return lines(spark, sf).filter(~F.col("stationary") | F.col("injection").isin("N")).agg(F.count("*").alias("n"))


@query("f_non_null_or_scope_fallback", "SELECT s_suppkey FROM supplier")
def f_non_null_or_scope_fallback(spark, sf):
    return C.scope_or_all(load(spark, sf, "supplier"), F.col("s_acctbal") > 1e9, 2).select("s_suppkey")


@query("f_r_scopes", f"WITH {LINES} SELECT virus, injection, count(*) AS n FROM ln WHERE stationary AND injection IN ('N', 'R') AND virus <> 'FURNITURE' GROUP BY 1, 2")
def f_r_scopes(spark, sf):
    df = lines(spark, sf).filter(F.col("stationary") & F.col("injection").isin("N", "R") & (F.col("virus") != "FURNITURE"))
    return df.groupBy("virus", "injection").agg(F.count("*").alias("n"))


# --- sort, sets and samples -----------------------------------------------------------------------


@query("s_top1_by", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1")
def s_top1_by(spark, sf):
    return S.top_by(load(spark, sf, "part"), ["p_brand"], F.col("p_retailprice"), ["p_partkey"]).select("p_brand", "p_partkey")


@query("s_pick_diverse", "SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) > 1 THEN 1 ELSE 0 END AS again FROM part WHERE p_size > 10) ORDER BY again, p_partkey LIMIT 40")
def s_pick_diverse(spark, sf):
    return S.pick_diverse(load(spark, sf, "part").withColumn("ok", F.col("p_size") > 10), "p_brand", "ok", ["p_partkey"], 40).select("p_partkey")


@query("s_pick_spread", f"""WITH {SAMPLES}, n AS (SELECT lane, frame, row_number() OVER (PARTITION BY lane ORDER BY t, frame) - 1 AS i, count(*) OVER (PARTITION BY lane) AS n FROM s),
k AS (SELECT DISTINCT lane, CAST(round_even(j * (n - 1) / 4.0, 0) AS BIGINT) AS i FROM n, (SELECT unnest(range(5)) AS j)) SELECT n.lane, n.frame FROM n JOIN k ON n.lane = k.lane AND n.i = k.i""")
def s_pick_spread(spark, sf):
    return S.pick_spread(samples(spark, sf), LANE, ["t", "frame"], 5).select("lane", "frame")


@query("s_every_nth", "SELECT event_id FROM events WHERE event_id % 7 = 0")
def s_every_nth(spark, sf):
    return S.every_nth(load(spark, sf, "events"), "event_id", 7).select("event_id")


@query("s_fraction_positions", f"WITH {BOUTS} SELECT lane, bout_index, f AS fraction, round(bout_start_sec + f * (bout_end_sec - bout_start_sec), 2) AS sample_t FROM bouts, (SELECT unnest([0.25, 0.5, 0.75]) AS f)".replace("f AS fraction", "CAST(f AS DOUBLE) AS fraction"))
def s_fraction_positions(spark, sf):
    return rounded(S.fraction_positions(bouts(spark, sf), [0.25, 0.5, 0.75]).select("lane", "bout_index", "fraction", "sample_t"), 2)


@query("s_sample_plan_union", f"WITH {SAMPLES} SELECT lane, frame, true AS stationary FROM s WHERE ok UNION ALL SELECT lane, frame, false FROM s WHERE NOT ok")
def s_sample_plan_union(spark, sf):
    s = samples(spark, sf).select("lane", "frame", "ok")
    return S.sample_plan(s.filter("ok").drop("ok"), s.filter("NOT ok").drop("ok"))


@query("s_concat_union", "SELECT c_custkey AS k, c_acctbal AS bal, CAST(NULL AS VARCHAR) AS note FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier")
def s_concat_union(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.lit("supplier").alias("note"))
    return c.unionByName(s, allowMissingColumns=True)


@query("s_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def s_distinct(spark, sf):
    return load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("s_set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def s_set_difference(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(load(spark, sf, "orders").select("o_custkey"))


@query("s_dedup_first_path", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def s_dedup_first_path(spark, sf):
    return S.first_path(load(spark, sf, "part"), "p_name", "p_partkey").select("p_name", "p_partkey")


@query("s_random_frames")
def s_random_frames(spark, sf):
    return S.random_rows(load(spark, sf, "events"), "event_id", 200, 7).select("event_id")


@query("s_linspace_jitter")
def s_linspace_jitter(spark, sf):
    rows = load(spark, sf, "events").select("event_id")
    at = S.jittered_positions(rows.count(), 50, 2, 7)
    numbered = S.global_row_number(rows, [F.col("event_id")], "_at")  # of all rows, as positions are
    return numbered.filter((F.col("_at") - 1).isin(at)).select("event_id")


@query("s_stratified_sample")
def s_stratified_sample(spark, sf):
    df = samples(spark, sf).withColumns({"session": F.floor(F.col("lane") / 10), "zone": C.zone(F.col("x"), 21, 70), "nest": F.col("state") == "purchase"})
    return S.stratified(df, "session", "zone", "nest", "frame", 30, {"cool": 0.3, "mid": 0.4, "hot": 0.3}, 3).select("session", "zone", "nest", "frame")
