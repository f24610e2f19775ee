"""Aggregations with the conventions of unit-based analysis: units first, then groups of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.sources.scratch import stored


def sem(x: str) -> Column:
    """Standard error of the mean; 0 for a single value."""
    return F.when(F.count(x) <= 1, F.lit(0.0)).otherwise(F.stddev_samp(x) / F.sqrt(F.count(x)))


def descriptive(df: DataFrame, value: str, factors: list[str]) -> DataFrame:
    """mean, sd, n and se by the factors that exist (over everything if none does)."""
    have = [f for f in factors if f in df.columns]
    n = F.count(value)
    return df.groupBy(*have).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), n.alias("n"), (F.stddev_samp(value) / F.sqrt(n)).alias("se"))


def unit_means(df: DataFrame, value: str, unit: list[str], factors: list[str], out: str = "unit_mean") -> DataFrame:
    return df.groupBy(*unit, *factors).agg(F.avg(value).alias(out), F.count(value).alias("n"))


def two_level_mean(df: DataFrame, value: str, unit: list[str], factors: list[str]) -> DataFrame:
    """Mean and SEM over unit means."""
    per = unit_means(df.filter(F.col(value).isNotNull()), value, unit, factors)
    return per.groupBy(*factors).agg(F.avg("unit_mean").alias("mean"), sem("unit_mean").alias("sem"), F.count("*").alias("n_units"))


def timecourse(df: DataFrame, value: str, bin: Column, unit: list[str], factors: list[str], least_units: int = 1) -> DataFrame:
    """Time bins: mean and SEM over units, for bins with enough units."""
    return two_level_mean(df.withColumn("bin", bin), value, unit, [*factors, "bin"]).filter(F.col("n_units") >= least_units)


def time_weighted(df: DataFrame, value: str, state: Column, seconds: Column, unit: list[str]) -> DataFrame:
    """Means of two states weighted by the time in each; one state alone counts as it is; without any time the means' coalesce."""
    rows = df.withColumns({"_s": F.when(state, "in").otherwise("out"), "_w": seconds})
    wide = rows.groupBy(*unit).pivot("_s", ["in", "out"]).agg(F.avg(value).alias("mean"), F.sum("_w").alias("sec"))
    mi, mo, wi, wo = (F.col(c) for c in ("in_mean", "out_mean", "in_sec", "out_sec"))
    both = F.when(wi + wo > 0, (mi * wi + mo * wo) / (wi + wo)).otherwise(F.coalesce(mi, mo))
    return wide.select(*unit, F.when(mi.isNull(), mo).when(mo.isNull(), mi).otherwise(both).alias("weighted_mean"))


def count_then_mean(df: DataFrame, session: list[str], unit: list[str], factors: list[str]) -> DataFrame:
    """Rows per session, then the mean per unit; sessions without rows don't appear."""
    per = df.groupBy(*session, *unit, *factors).agg(F.count("*").alias("_n"))
    return per.groupBy(*unit, *factors).agg(F.avg("_n").alias("mean_count"), F.count("*").alias("n_sessions"))


def unpivoted_mean(df: DataFrame, metrics: list[str], factors: list[str]) -> DataFrame:
    """Mean and SEM of several columns by factors, one row per metric."""
    long = df.unpivot(factors, metrics, "metric", "value")
    return long.groupBy(*factors, "metric").agg(F.avg("value").alias("mean"), sem("value").alias("sem"), F.count("value").alias("n"))


def exact_percentiles(df: DataFrame, value: str, factors: list[str], shares: dict[str, float], buckets: int = 4096) -> DataFrame:
    """Per group the number of values (n) and exact percentiles by name, interpolated as ``percentile`` does; groups without values are left out.

    Equal values are counted, counts are summed over ``buckets`` equal stretches of a group's range, and only the
    stretches that a percentile lies in are put in order: no task holds the values of a group.
    """
    counts = stored(df.filter(F.col(value).isNotNull()).groupBy(*factors, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")), "counts")
    real = F.when(~F.isnan("_v"), F.col("_v"))
    ends = counts.groupBy(*factors).agg(F.sum("_c").alias("n"), F.min(real).alias("_lo"), F.max(real).alias("_hi"))
    same = F.lit(True)
    for c in factors:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    few = lambda rows: F.broadcast(rows.withColumnsRenamed({c: f"_of_{c}" for c in factors}))  # noqa: E731  a row or a few a group
    step = F.nullif((F.col("_hi") - F.col("_lo")) / buckets, F.lit(0.0))
    bucket = F.when(F.isnan("_v"), buckets + 1).otherwise(F.least(F.coalesce(F.floor((F.col("_v") - F.col("_lo")) / step), F.lit(0)), F.lit(buckets))).cast("long")
    dealt = counts.join(few(ends), same).select(*factors, "_v", "_c", "n", bucket.alias("_b"))
    sums = dealt.groupBy(*factors, "n", "_b").agg(F.sum("_c").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*factors).orderBy("_b")) - F.col("_c")
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for k, p in shares.items()]))
    ranks = F.explode(F.array(F.struct(F.floor("_at").alias("r"), (F.floor("_at") + 1 - F.col("_at")).alias("w")), F.struct((F.floor("_at") + 1).alias("r"), (F.col("_at") - F.floor("_at")).alias("w"))))
    wanted = sums.withColumn("_before", before).select(*factors, "n", "_b", "_before", "_c", asked.alias("_a")).select("*", F.col("_a.k").alias("_k"), F.col("_a.at").alias("_at"))
    wanted = wanted.select("*", ranks.alias("_r")).filter("_r.w > 0 AND _r.r >= _before AND _r.r < _before + _c").select(*factors, F.col("_b").alias("_bucket"), "_before", "_k", "_r")
    inner = F.sum("_c").over(Window.partitionBy(*factors, "_b").orderBy("_v"))
    ordered = dealt.join(few(wanted.select(*factors, "_bucket").distinct()), same & (F.col("_b") == F.col("_bucket"))).select(*factors, "_v", "_c", "n", "_b", inner.alias("_upto"))
    found = ordered.join(few(wanted), same & (F.col("_b") == F.col("_bucket"))).filter("_r.r < _before + _upto AND _r.r >= _before + _upto - _c")
    part = F.when(F.col("_r.w") == 1, F.col("_v")).otherwise(F.col("_r.w") * F.col("_v"))
    return found.groupBy(*factors, "n").agg(*[F.sum(F.when(F.col("_k") == k, part)).alias(k) for k in shares])


def boxplot(df: DataFrame, value: str, factors: list[str], reach: float = 1.5) -> DataFrame:
    """Quartiles, and whiskers at the farthest values within ``reach`` interquartile ranges of the box; a factor has so few levels that a row of each is broadcast."""
    box = stored(exact_percentiles(df, value, factors, {"q1": 0.25, "median": 0.5, "q3": 0.75}), "box")
    every = df.groupBy(*factors).agg(F.count(value).alias("n")).filter("n = 0")  # groups without values have a row too
    box = box.unionByName(every, allowMissingColumns=True)
    spread = (F.col("q3") - F.col("q1")) * reach
    inside = F.col(value).between(F.col("q1") - spread, F.col("q3") + spread)
    ends = df.join(F.broadcast(box), factors) if factors else df.crossJoin(F.broadcast(box))
    ends = ends.groupBy(*factors).agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"))
    return box.join(ends, factors) if factors else box.crossJoin(F.broadcast(ends))


def histogram(df: DataFrame, value: str, factors: list[str], bins: int, common: bool = False) -> DataFrame:
    """Equal-width bins over each group's range (or the common one), with counts and densities; the top edge is in the last bin."""
    rows = df.filter(F.col(value).isNotNull())
    over = Window.partitionBy() if common else Window.partitionBy(*factors)
    if common:
        ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        rows = rows.crossJoin(F.broadcast(ends))  # one row
    else:
        rows = rows.withColumns({"_lo": F.min(value).over(over), "_hi": F.max(value).over(over)})
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col(value) - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(0))).cast("long")
    found = rows.withColumns({"bin": at, "_width": width}).groupBy(*factors, "bin").agg(F.count("*").alias("n"), F.first("_width").alias("width"))
    total = F.sum("n").over(Window.partitionBy(*factors)) if factors else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return found.withColumn("density", F.col("n") / (total * F.nullif(F.col("width"), F.lit(0.0))))


def yields(df: DataFrame, valid: str, zone: str) -> DataFrame:
    """Share of valid rows per zone; rows without a zone don't count."""
    return df.filter(F.col(zone).isNotNull()).groupBy(zone).agg(F.avg(F.col(valid).cast("int")).alias("yield"))


def yield_map(df: DataFrame, valid: str, zone: str) -> DataFrame:
    """yields() as one map."""
    return yields(df, valid, zone).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(zone, "yield")))).alias("yields"))


def average_valid(x: str, least: int) -> Column:
    """Mean of the values, or NULL if there are fewer than ``least``."""
    return F.when(F.count(x) >= least, F.avg(x))


def bout_rollup(df: DataFrame, keys: list[str], success: Column, values: list[str], valid: str, reasons: str, least: int = 1) -> DataFrame:
    """Per bout: averages over successful samples, whether any was valid, the distinct sorted reasons and counts."""
    ok = df.filter(success)
    aggs = [average_valid(v, least).alias(v) for v in values]
    found = ok.groupBy(*keys).agg(*aggs, F.bool_or(valid).alias("any_valid"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(reasons)))), "; ").alias("reasons"), F.count("*").alias("n_averaged"))
    return df.groupBy(*keys).agg(F.count("*").alias("n_attempted")).join(found, keys, "left")


def qc_summary(df: DataFrame, file: list[str], flag: str, valid: str, confidence: str) -> DataFrame:
    """Per file: rows, share ok and valid in percent (one decimal), median confidence and a count per flag."""
    share = lambda c: F.round(100 * F.avg(F.when(c, 1.0).otherwise(0.0)), 1)
    per = df.groupBy(*file, flag).agg(F.count("*").alias("_n"))
    flags = per.groupBy(*file).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(flag, "_n")))).alias("flags"))
    found = df.groupBy(*file).agg(F.count("*").alias("n_rows"), share(F.col(flag) == "ok").alias("percent_ok"), share(F.col(valid)).alias("percent_valid"), F.percentile(confidence, 0.5).alias("median_confidence"))
    return found.join(flags, file)


def consolidate_sync(lanes: DataFrame, spread: float, large: float) -> DataFrame:
    """One clock estimate per session from its lanes (session, lane, offset_sec, drift_slope, camera_fps, flags).

    Clean lanes (no flags) count if there are any, else all.  The rate is that of the first lane by name
    among those used.
    """
    rows = lanes.filter(F.col("offset_sec").isNotNull()).withColumn("flags", F.coalesce("flags", F.lit("")))
    clean = F.col("flags") == ""
    per = Window.partitionBy("session")
    rows = rows.withColumn("_clean", F.sum(clean.cast("int")).over(per)).withColumn("_use", clean | (F.col("_clean") == 0))
    sign = lambda c, d: F.concat(F.when(c >= 0, "+").otherwise(""), F.format_string(f"%.{d}f", c))
    text = F.concat("lane", F.lit("="), sign(F.col("offset_sec"), 2), F.lit("s/drift"), sign(F.col("drift_slope"), 4), F.when(~clean, F.concat(F.lit(" ["), "flags", F.lit("]"))).otherwise(""))
    used = lambda c: F.avg(F.when(F.col("_use"), F.col(c)))
    found = rows.groupBy("session").agg(
        used("offset_sec").alias("_offset"),
        used("drift_slope").alias("_drift"),
        F.min_by("camera_fps", F.when(F.col("_use"), F.col("lane"))).alias("camera_fps"),
        F.count("*").alias("n_lanes"),
        F.sum(clean.cast("int")).alias("n_clean_lanes"),
        (F.max("offset_sec") - F.min("offset_sec")).alias("_spread"),
        F.count_distinct("camera_fps").alias("_rates"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lane", text.alias("d")))), lambda x: x["d"]), "; ").alias("lanes"),
    )
    gap = F.when(F.col("n_lanes") > 1, F.col("_spread"))
    join = lambda *pairs: F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]), lambda x: x.isNotNull()), ";")
    low = join((F.col("n_clean_lanes") == 0, "no_clean_lane"), (gap > spread, "lane_disagreement"), (F.col("_rates") > 1, "lane_fps_mismatch"))
    review = join((F.col("n_lanes") == 1, "single_lane"), (F.abs("_offset") > large, "large_offset"))
    return found.select("session", F.round("_offset", 3).alias("offset_sec"), F.round("_drift", 5).alias("drift_slope"), "camera_fps", "n_lanes", "n_clean_lanes", gap.alias("lane_spread_sec"), (low != "").alias("low_confidence"), low.alias("low_confidence_reasons"), review.alias("review_reasons"), "lanes")


def pivot_counts(df: DataFrame, unit: list[str], column: str, values: list, prefix: str = "n_") -> DataFrame:
    """How often each unit has each of a fixed list of values, 0 where never."""
    wide = df.groupBy(*unit).pivot(column, values).count().fillna(0)
    return wide.select(*unit, *[F.col(f"`{v}`").cast("long").alias(f"{prefix}{v}") for v in values])


def distinct_first(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """The first row of each combination, by an explicit order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*subset).orderBy(*order))).filter("_r = 1").drop("_r")


def coverage(report: DataFrame, status: str = "status") -> DataFrame:
    """Counts of matched, unmatched and ambiguous files."""
    count = lambda c: F.sum(c.cast("long"))
    s = F.col(status)
    return report.agg(count(s.startswith("matched")).alias("matched"), count(s == "unmatched").alias("unmatched"), count(s.startswith("ambiguous")).alias("ambiguous"))


def lane_activity(rows: DataFrame, lane: list[str], t: str, longest_gap: float) -> DataFrame:
    """Per lane: distance, mean speed, last time and the time in gaps that don't count (rows as steps() makes them)."""
    return rows.groupBy(*lane).agg(
        F.sum("step").alias("distance"), F.avg(F.when((F.col("dt") > 0) & (F.col("dt") <= longest_gap), F.col("step") / F.col("dt"))).alias("mean_speed"), F.max(t).alias("last_time"), F.sum(F.when(F.col("dt") > longest_gap, F.col("dt")).otherwise(0.0)).alias("gap_time")
    )


def feasibility(df: DataFrame, outcome: str, factors: list[str], unit: str, least_rows: int, least_units: int, least_level: int) -> DataFrame:
    """One row: complete cases, units, and the first reason against a model (NULL if none)."""
    rows = df.dropna(subset=[outcome, unit, *factors])
    levels = None
    for f in factors:
        one = rows.groupBy(F.col(f).cast("string").alias("level")).agg(F.count("*").alias("n")).agg(F.lit(f).alias("factor"), F.count("*").alias("levels"), F.min("n").alias("fewest"))
        levels = one if levels is None else levels.unionByName(one)
    worst = levels.agg(F.min("levels").alias("levels"), F.min("fewest").alias("fewest"))
    total = rows.agg(F.count("*").alias("n_rows"), F.count_distinct(unit).alias("n_units"))
    reason = (
        F.when(F.col("n_rows") < least_rows, "too few rows").when(F.col("n_units") < least_units, "too few units").when(F.col("levels") < 2, "a factor has one level").when(F.col("fewest") < least_level, "a level has too few rows")
    )
    return total.crossJoin(worst).select("n_rows", "n_units", reason.alias("reason"))  # one row each


def paired_moments(df: DataFrame, value: str, unit: list[str], factors: list[str], condition: str, a: str, b: str) -> DataFrame:
    """Over units with both conditions: n, mean difference (a - b), its sd, se, t and degrees of freedom.

    n = 0 leaves all NULL; n = 1 gives the mean alone; se = 0 leaves t NULL.
    """
    wide = df.groupBy(*unit, *factors).pivot(condition, [a, b]).agg(F.avg(value))
    rows = wide.withColumn("_d", F.col(f"`{a}`") - F.col(f"`{b}`"))
    n = F.count("_d")
    found = rows.groupBy(*factors).agg(n.alias("n"), F.avg("_d").alias("mean_diff"), F.stddev_samp("_d").alias("sd_diff"))
    se = F.col("sd_diff") / F.sqrt("n")
    return found.withColumn("se", se).withColumns({"t": F.col("mean_diff") / F.nullif(F.col("se"), F.lit(0.0)), "df": F.when(F.col("n") > 1, F.col("n") - 1)})


def paired_units(df: DataFrame, unit: list[str], condition: str, levels: list[str]) -> DataFrame:
    """How many units have every one of the levels."""
    per = df.filter(F.col(condition).isin(levels)).groupBy(*unit).agg(F.count_distinct(condition).alias("_n"))
    return per.filter(F.col("_n") == len(levels)).agg(F.count("*").alias("n_paired"))


def n_label(df: DataFrame, unit: str, factors: list[str]) -> DataFrame:
    return df.groupBy(*factors).agg(F.format_string("n = %d", F.count_distinct(unit)).alias("label"))


def error_table(df: DataFrame, error: str, factors: list[str]) -> DataFrame:
    """Mean and mean absolute error where there is one."""
    return df.filter(F.col(error).isNotNull()).groupBy(*factors).agg(F.avg(error).alias("mean_error"), F.avg(F.abs(error)).alias("mean_abs_error"), F.count("*").alias("n"))


def percentile_summary(df: DataFrame, value: str, points: list[float], below: list[float]) -> DataFrame:
    """One row: percentiles and the shares of values at or below thresholds."""
    return df.agg(*[F.percentile(value, p / 100).alias(f"p{p:g}") for p in points], *[F.avg((F.col(value) <= x).cast("double")).alias(f"share_le_{x:g}") for x in below])


def difference_gate(df: DataFrame, a: str, b: str, p95: float, worst: float) -> DataFrame:
    """One row: percentiles, mean and maximum of |a - b|, and whether they are within tolerance."""
    d = F.abs(F.col(a) - F.col(b))
    found = df.agg(F.percentile(d, 0.5).alias("p50"), F.percentile(d, 0.95).alias("p95"), F.avg(d).alias("mean"), F.max(d).alias("max"))
    return found.withColumn("ok", (F.col("p95") <= p95) & (F.col("max") <= worst))


def spread(df: DataFrame, value: str, factors: list[str], bad: Column) -> DataFrame:
    """Mean, smallest and largest value by factors, and how many rows are ``bad``."""
    return df.groupBy(*factors).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(bad.cast("long")).alias("n_bad"))
