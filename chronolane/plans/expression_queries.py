"""Queries over single-row expressions: names, classes, clocks, gates, calibration, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import columns as C
from chronolane.plans.registry import SAMPLES, load, query, rounded, samples

DATE = "strftime(TIMESTAMP '2025-07-01 00:00:00' + INTERVAL (c_custkey % 60) DAY, '%m-%d-%y')"
STEM = f"{DATE} || '_' || CAST(4000 + c_custkey % 900 AS VARCHAR) || '_B_' || CAST(5000 + c_custkey % 900 AS VARCHAR) || '_F_Test3-' || CAST(c_custkey AS VARCHAR)"
NAMES = f"n AS (SELECT c_custkey AS k, {STEM} AS stem, {STEM} || CASE c_custkey % 4 WHEN 0 THEN '_Front.seq' WHEN 1 THEN '_Back.seq' WHEN 2 THEN '_front_x.csv' ELSE '.csv' END AS name FROM customer)"


def names(spark, sf):
    c = load(spark, sf, "customer")
    k = F.col("c_custkey")
    date = F.date_format(F.date_add(F.lit("2025-07-01").cast("date"), (k % 60).cast("int")), "MM-dd-yy")
    stem = F.concat(date, F.lit("_"), (4000 + k % 900).cast("string"), F.lit("_B_"), (5000 + k % 900).cast("string"), F.lit("_F_Test3-"), k.cast("string"))
    ending = F.element_at(F.array(F.lit("_Front.seq"), F.lit("_Back.seq"), F.lit("_front_x.csv"), F.lit(".csv")), (k % 4 + 1).cast("int"))
    return c.select(k.alias("k"), stem.alias("stem"), F.concat(stem, ending).alias("name"))


@query("p_parse_suffix_lane", f"WITH {NAMES} SELECT k, CASE WHEN k % 4 = 3 THEN regexp_replace(name, '[.]csv$', '') ELSE stem END AS stem, CASE k % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'B' WHEN 2 THEN 'F' ELSE '' END AS lane FROM n")
def p_parse_suffix_lane(spark, sf):
    return names(spark, sf).withColumn("p", C.stem_and_lane(F.col("name"))).select("k", "p.stem", "p.lane")


@query("p_extract_tokens", f"WITH {NAMES} SELECT k, CASE WHEN k % 3 = 2 THEN CAST(4000 + k % 900 AS VARCHAR) END AS b, CASE WHEN k % 3 <> 1 THEN CAST(5000 + k % 900 AS VARCHAR) END AS f, CAST(CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS strict_found, CASE WHEN k % 3 <> 2 THEN CAST(4000 + k % 900 AS VARCHAR) END AS strict_b FROM n")
def p_extract_tokens(spark, sf):
    """Of each three stems one has a token that ends at a hyphen, one has two, one has none; only those are strict."""
    k, stem = F.col("k") % 3, F.col("stem")
    one = F.replace(stem, F.lit("_B_"), F.lit("_B-"))
    stem = F.when(k == 0, one).when(k == 1, F.replace(one, F.lit("_F_"), F.lit("_F-"))).otherwise(stem)
    df = names(spark, sf).withColumns({"loose": C.lane_tokens(stem, strict=False), "strict": C.lane_tokens(stem)})
    return df.select("k", F.col("loose")["B"].alias("b"), F.col("loose")["F"].alias("f"), F.size("strict").alias("strict_found"), F.col("strict")["B"].alias("strict_b"))


@query("p_extract_date", f"WITH {NAMES} SELECT k, strftime(TIMESTAMP '2025-07-01 00:00:00' + INTERVAL (k % 60) DAY, '%Y-%m-%d') AS day FROM n")
def p_extract_date(spark, sf):
    return names(spark, sf).select("k", C.leading_date(F.col("name")).cast("string").alias("day"))


@query("p_parse_full_filename", f"WITH {NAMES} SELECT k, CAST(4000 + k % 900 AS VARCHAR) AS animal1_id, 'B' AS animal1_sex, CAST(5000 + k % 900 AS VARCHAR) AS animal2_id, 'Test3-' || CAST(k AS VARCHAR) AS experiment, 'Front' AS track FROM n")
def p_parse_full_filename(spark, sf):
    return names(spark, sf).withColumn("p", C.full_name(F.concat("stem", F.lit("_Front")))).select("k", "p.animal1_id", "p.animal1_sex", "p.animal2_id", "p.experiment", "p.track")


@query("p_parse_mouse_trial", f"WITH {NAMES} SELECT k, CAST(5000 + k % 900 AS VARCHAR) || '_F' AS unit, stem AS trial FROM n")
def p_parse_mouse_trial(spark, sf):
    return names(spark, sf).withColumn("p", C.unit_and_trial(F.concat("stem", F.lit("_Front_tracked_edge20")))).select("k", "p.unit", "p.trial")


@query("p_mouse_id_for_lane", f"WITH {NAMES} SELECT k, CAST(5000 + k % 900 AS VARCHAR) AS id FROM n")
def p_mouse_id_for_lane(spark, sf):
    return names(spark, sf).select("k", C.lane_id(F.col("stem"), "F").alias("id"))


@query("p_strip_suffix", f"WITH {NAMES} SELECT k, regexp_replace(name, '(_Front[.]seq|_Back[.]seq)$', '') AS stem FROM n WHERE k % 4 < 2")
def p_strip_suffix(spark, sf):
    return names(spark, sf).filter("k % 4 < 2").select("k", C.strip_suffix(F.col("name"), ["_Front.seq", "_Back.seq"]).alias("stem"))


@query("p_reroot_path", "SELECT page_id, '/mnt/data/' || regexp_replace(url, '^.*example[.]', '') AS path FROM pages")
def p_reroot_path(spark, sf):
    return load(spark, sf, "pages").select("page_id", C.reroot(F.col("url"), "example.", "/mnt/data").alias("path"))


@query("p_normalize", "SELECT c_custkey, coalesce(trim(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '  ' || c_name || ' ' END), '') AS v FROM customer")
def p_normalize(spark, sf):
    raw = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("  "), "c_name", F.lit(" ")))
    return load(spark, sf, "customer").select("c_custkey", C.normalize(raw).alias("v"))


@query("p_dict_map_passthrough", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Gi' WHEN 'MACHINERY' THEN 'Gq' ELSE c_mktsegment END AS virus FROM customer")
def p_dict_map_passthrough(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", C.mapped(F.col("c_mktsegment"), {"building": "Gi", "machinery": "Gq"}).alias("virus"))


@query("p_to_numeric_coerce", "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS v, CAST(NULL AS DOUBLE) AS bad FROM orders")
def p_to_numeric_coerce(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", C.to_number(F.substring("o_orderpriority", 1, 1)).alias("v"), C.to_number(F.col("o_orderpriority")).alias("bad"))


@query("p_classify_condition", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'pre_cranio' WHEN c_custkey % 5 = 0 THEN 'post_saline' ELSE 'post_' || lower(c_mktsegment) || '_' || CASE WHEN c_acctbal > 0 THEN 'nestlet' ELSE 'no_nestlet' END END AS condition FROM customer")
def p_classify_condition(spark, sf):
    k = F.col("c_custkey")
    surgery, injection = F.when(k % 3 == 0, "Pre-craniotomy").otherwise("Post"), F.when(k % 5 == 0, "Saline").otherwise(F.col("c_mktsegment"))
    return load(spark, sf, "customer").select("c_custkey", C.condition(surgery, injection, F.when(F.col("c_acctbal") > 0, "Y")).alias("condition"))


@query("p_unusable_reason", "SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'none listed' WHEN o.o_custkey IS NULL THEN 'never ordered' WHEN c_acctbal < 0 THEN 'in debt' ELSE 'unknown' END AS reason FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c_custkey = o.o_custkey")
def p_unusable_reason(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey").distinct()
    df = load(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return df.select("c_custkey", C.cases((F.col("c_acctbal").isNull(), "none listed"), (F.col("o_custkey").isNull(), "never ordered"), (F.col("c_acctbal") < 0, "in debt"), otherwise="unknown").alias("reason"))


@query("p_classify_regime", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'none' WHEN o_orderdate < TIMESTAMP '1997-01-01 00:00:00' THEN 'vertical' ELSE 'horizontal+vertical' END AS flip, CASE WHEN o_orderkey % 11 = 0 THEN 'verified' ELSE 'date-inferred' END AS confidence FROM orders")
def p_classify_regime(spark, sf):
    r = C.regime(F.when(F.col("o_orderkey") % 11 == 0, "none"), F.to_date("o_orderdate"), "1997-01-01")
    return load(spark, sf, "orders").withColumn("r", r).select("o_orderkey", "r.flip", "r.confidence")


SIDE = "CASE WHEN abs({0} - 0.5) < 0.15 THEN 'center' WHEN {0} < 0.5 THEN 'low' ELSE 'high' END"


@query("p_classify_side", f"""WITH q AS (SELECT l_orderkey, l_linenumber, {SIDE.format('l_quantity / 50')} AS ax, {SIDE.format('l_discount * 10')} AS ay, {SIDE.format('l_tax * 12')} AS bx, {SIDE.format('l_linenumber / 7.0')} AS b2 FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN 'center' IN (ax, ay, bx, b2) THEN 'AMBIGUOUS (' || CASE WHEN 'center' NOT IN (ax, bx) AND ax <> bx THEN 'horizontal,' ELSE '' END || CASE WHEN 'center' NOT IN (ay, b2) AND ay <> b2 THEN 'vertical,' ELSE '' END || '?)'
WHEN ax = bx AND ay = b2 THEN 'none' WHEN ax <> bx AND ay <> b2 THEN 'horizontal+vertical' WHEN ax <> bx THEN 'horizontal' ELSE 'vertical' END AS label FROM q""")
def p_classify_side(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", C.flip_label(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_linenumber") / 7.0).alias("label"))


@query("p_clock_thermal_to_rgb", f"WITH {SAMPLES} SELECT frame, round(t - 1704067200 + 5.5 + 0.001 * (t - 1704067200), 4) AS other FROM s")
def p_clock_thermal_to_rgb(spark, sf):
    return rounded(samples(spark, sf).select("frame", C.to_other_clock(F.col("t") - 1704067200, 5.5, 0.001).alias("other")), 4)


@query("p_clock_rgb_to_thermal", f"WITH {SAMPLES} SELECT frame, round((t - 1704067200 - 5.5) / 1.001, 4) AS own, t - 1704067200 AS same FROM s".replace("t - 1704067200 AS same", "round(t - 1704067200, 4) AS same"))
def p_clock_rgb_to_thermal(spark, sf):
    t = F.col("t") - 1704067200
    return rounded(samples(spark, sf).select("frame", C.from_other_clock(t, F.lit(5.5), F.lit(0.001)).alias("own"), C.from_other_clock(t, F.lit(5.5), F.lit(-1.0)).alias("same")), 4)


@query("p_start_frame", f"WITH {SAMPLES} SELECT frame, CAST(greatest(0, ceil((x - 20) * 8)) AS BIGINT) AS start FROM s")
def p_start_frame(spark, sf):
    return samples(spark, sf).select("frame", C.start_frame(F.col("x") - 20, 8.0).alias("start"))


@query("p_time_bin_floor", f"WITH {SAMPLES} SELECT frame, CAST(floor(x / 30) * 30 AS DOUBLE) AS low, floor(x / 30) * 30 + 15.0 AS mid, (floor(x / 60 / 2) + 0.5) * 2 AS minute FROM s")
def p_time_bin_floor(spark, sf):
    x = F.col("x")
    return samples(spark, sf).select("frame", C.floor_bin(x, 30.0).alias("low"), C.floor_bin(x, 30.0, True).alias("mid"), C.minute_bin(x, 2).alias("minute"))


@query("p_time_bin_ceil_end", f"WITH {SAMPLES} SELECT frame, CAST(greatest(ceil(x / 30), 1) * 30 AS DOUBLE) AS bin_end FROM s")
def p_time_bin_ceil_end(spark, sf):
    return samples(spark, sf).select("frame", C.end_bin(F.col("x"), 30.0).cast("double").alias("bin_end"))


@query("p_confidence_alpha", f"WITH {SAMPLES} SELECT frame, round(CASE WHEN NOT ok THEN 0.5 ELSE 0.2 + 0.8 * exp(-abs(x - y) / 50) END, 9) AS alpha FROM s")
def p_confidence_alpha(spark, sf):
    return rounded(samples(spark, sf).select("frame", C.confidence_alpha(F.col("x"), F.when(F.col("ok"), F.col("y")), 50.0, 0.2).alias("alpha")), 9)


@query("p_thresholds_default", f"WITH {SAMPLES} SELECT frame, x < 5.0 AS below FROM s")
def p_thresholds_default(spark, sf):
    return samples(spark, sf).select("frame", (F.col("x") < C.threshold(None)).alias("below"))


@query("p_planck_celsius", f"WITH {SAMPLES} SELECT frame, round(CASE WHEN ok THEN 1501.0 / ln(21106.77 / (0.012545258 * ((x * 50 + 10000) - 7340)) + 1) - 273.15 ELSE (x * 50 + 10000) * 0.04 - 273.15 END, 6) AS celsius FROM s")
def p_planck_celsius(spark, sf):
    c = C.planck_celsius(F.col("x") * 50 + 10000, F.when(F.col("ok"), F.lit(21106.77)), F.lit(0.012545258), F.lit(1501.0), F.lit(1.0), F.lit(-7340))
    return rounded(samples(spark, sf).select("frame", c.alias("celsius")))


@query("p_quadratic_celsius", f"WITH {SAMPLES} SELECT frame, round(0.001 * x * x + 0.5 * x - 3.0, 9) AS celsius FROM s")
def p_quadratic_celsius(spark, sf):
    return rounded(samples(spark, sf).select("frame", C.quadratic_celsius(F.col("x"), 0.001, 0.5, -3.0).alias("celsius")), 9)


H = [1.1, 0.02, 3.0, -0.01, 0.95, -2.0, 0.0001, 0.0002, 1.0]
HW = "(0.0001 * x + 0.0002 * y + 1.0)"


def _h(values=H):
    return [F.lit(float(v)) for v in values]


@query("p_homography_apply", f"WITH {SAMPLES} SELECT frame, round((1.1 * x + 0.02 * y + 3.0) / {HW}, 6) AS px, round((-0.01 * x + 0.95 * y - 2.0) / {HW}, 6) AS py FROM s")
def p_homography_apply(spark, sf):
    return rounded(samples(spark, sf).withColumn("p", C.homography(_h(), F.col("x"), F.col("y"))).select("frame", F.col("p.x").alias("px"), F.col("p.y").alias("py")))


@query("p_homography_translate", f"WITH {SAMPLES} SELECT frame, round((1.1 * x + 0.02 * y + 3.0) / {HW} + 4.0, 6) AS px, round((-0.01 * x + 0.95 * y - 2.0) / {HW} - 1.5, 6) AS py FROM s")
def p_homography_translate(spark, sf):
    moved = C.translated(_h(), F.lit(4.0), F.lit(-1.5))
    return rounded(samples(spark, sf).withColumn("p", C.homography(moved, F.col("x"), F.col("y"))).select("frame", F.col("p.x").alias("px"), F.col("p.y").alias("py")))


@query("p_homography_deviation", "SELECT s_suppkey, round(CAST(s_nationkey AS DOUBLE), 6) AS deviation FROM supplier")
def p_homography_deviation(spark, sf):
    one = [F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)]
    other = [*one[:2], F.col("s_nationkey").cast("double"), *one[3:]]
    return rounded(load(spark, sf, "supplier").select("s_suppkey", C.deviation(one, other, [(0.0, 0.0), (100.0, 0.0), (100.0, 50.0)]).alias("deviation")))


@query("p_pixel_distance", f"WITH {SAMPLES} SELECT frame, round(sqrt(power(x - 50, 2) + power(CASE WHEN ok THEN y END - 20, 2)), 6) AS d FROM s")
def p_pixel_distance(spark, sf):
    return rounded(samples(spark, sf).select("frame", C.distance(F.col("x"), F.when(F.col("ok"), F.col("y")), F.lit(50.0), F.lit(20.0)).alias("d")))


@query("p_gate_measurement", "SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN l_linenumber = 7 THEN 'no delta_t (upstream measurement invalid)' WHEN l_discount < 0.03 THEN '|delta_t|=' || printf('%.2f', l_discount) || ' below threshold 0.03' END, CASE WHEN l_tax < 0.02 THEN 'landmark_confidence=' || printf('%.2f', l_tax) || ' below threshold' END, CASE WHEN l_returnflag = 'R' THEN 'sync QC failed' END, CASE WHEN l_linestatus = 'F' THEN 'homography QC failed' END, CASE WHEN l_quantity < 5 THEN 'posture is curled/rearing' END) AS reasons FROM lineitem")
def p_gate_measurement(spark, sf):
    delta = F.when(F.col("l_linenumber") != 7, F.col("l_discount"))
    found = C.gate(delta, F.col("l_tax"), F.col("l_returnflag") != "R", F.col("l_linestatus") != "F", ~(F.col("l_quantity") < 5), 0.03, 0.02)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(found, "; ").alias("reasons"))


@query("p_array_join_export", "SELECT p_partkey, concat_ws('; ', CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END) AS tags FROM part")
def p_array_join_export(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.array_join(C.reasons((F.col("p_size") > 40, "large"), (F.col("p_retailprice") > 1500, "dear")), "; ").alias("tags"))


@query("p_flags_for_sync", "SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN l_linenumber = 7 OR NOT l_tax * 6 <= 0.3 THEN 'flat_minimum' END, CASE WHEN l_discount * 4 > 0.25 THEN 'poor_fit' END, CASE WHEN abs(l_quantity / 10000) > 0.002 THEN 'timing_anomaly' END, CASE WHEN l_tax < 2 * (l_discount * 4) THEN 'fps_ambiguous' END) AS flags FROM lineitem")
def p_flags_for_sync(spark, sf):
    ratio = F.when(F.col("l_linenumber") != 7, F.col("l_tax") * 6)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.sync_flags(ratio, F.col("l_discount") * 4, F.col("l_quantity") / 10000, F.col("l_tax")).alias("flags"))


@query("p_passes_acceptance", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber <> 7 THEN l_discount END < 0.06, false) AND (l_tax > 0.05 OR abs(l_quantity / 10000) < 0.001) AS ok FROM lineitem")
def p_passes_acceptance(spark, sf):
    residual = F.when(F.col("l_linenumber") != 7, F.col("l_discount"))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.accepted(residual, 0.06, F.col("l_tax"), 0.05, F.col("l_quantity") / 10000, 0.001).alias("ok"))


@query("p_pre_entry_row", f"WITH {SAMPLES} SELECT frame, CASE WHEN frame >= 500 THEN x END AS x, CASE WHEN frame >= 500 THEN y END AS y, CASE WHEN frame < 500 THEN 'pre_entry' ELSE state END AS flag FROM s")
def p_pre_entry_row(spark, sf):
    before = F.col("frame") < 500
    return samples(spark, sf).withColumns(C.blanked(["x", "y"], before)).select("frame", "x", "y", F.when(before, "pre_entry").otherwise(F.col("state")).alias("flag"))


@query("p_join_key", f"WITH {NAMES} SELECT k, CASE WHEN k % 4 = 3 THEN regexp_replace(name, '[.]csv$', '') ELSE stem END || '|' || CASE k % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'B' WHEN 2 THEN 'F' ELSE '' END AS key FROM n")
def p_join_key(spark, sf):
    p = C.stem_and_lane(F.col("name"))
    return names(spark, sf).select("k", F.concat_ws("|", p["stem"], p["lane"]).alias("key"))


@query("p_session_qc_report", f"WITH {SAMPLES} SELECT lane, count(*) AS n_rows, CASE WHEN max(CASE WHEN ok THEN x END) IS NULL THEN NULL ELSE max(CASE WHEN ok THEN x END) < 250 END AS accepted FROM s GROUP BY lane")
def p_session_qc_report(spark, sf):
    top = F.max(F.when(F.col("ok"), F.col("x")))
    report = samples(spark, sf).groupBy("lane").agg(F.struct(F.count("*").alias("n_rows"), F.when(top.isNotNull(), top < 250).alias("accepted")).alias("report"))
    return report.select("lane", "report.n_rows", "report.accepted")


@query("p_height_correction", f"WITH {SAMPLES} SELECT frame, round(x * 1.02, 6) AS x, round(y * 0.98, 6) AS y FROM s")
def p_height_correction(spark, sf):
    point = C.corrected(F.struct("x", "y"), lambda p: F.struct((p["x"] * 1.02).alias("x"), (p["y"] * 0.98).alias("y")))
    return rounded(samples(spark, sf).select("frame", point.alias("p")).select("frame", "p.x", "p.y"))


@query("p_stretch_uint8", """WITH e AS (SELECT vec_id, embedding AS a FROM embeddings), f AS (SELECT vec_id, list_min(a) AS lo, list_max(a) AS hi, a FROM e), g AS (SELECT vec_id, lo, hi, unnest(a) AS p, generate_subscripts(a, 1) AS i FROM f)
SELECT vec_id, CAST(i AS BIGINT) AS i, CAST(CASE WHEN hi > lo THEN floor((CAST(p AS DOUBLE) - CAST(lo AS DOUBLE)) * 255.0 / (CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE))) ELSE 0 END AS INTEGER) AS v FROM g""")
def p_stretch_uint8(spark, sf):
    e = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return e.select("vec_id", F.posexplode(C.stretch(F.col("a")))).select("vec_id", (F.col("pos") + 1).cast("long").alias("i"), F.col("col").alias("v"))
