"""Joins that SQL has no single word for: as-of, interpolation, intervals, unique lookups, source precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.sources.scratch import stored


def _bracketed(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: dict[str, Column]) -> DataFrame:
    """Rows of ``left`` (as a struct ``_l``) with the last right row at or before and the first one after, as structs _b and _f.

    A union and two running picks, one in each direction: linear in rows, one exchange on the keys, no join.
    """
    held = F.struct(F.col(t).alias("t"), *[c.alias(n) for n, c in value.items()])
    lefts = left.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    rights = right.filter(F.col(t).isNotNull()).select(*keys, F.col(t).alias("_t"), F.lit(0).alias("_side"), held.alias("_r"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side")
    back = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_side"))
    fore = F.last("_r", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumns({"_b": back, "_f": fore}).filter("_side = 1")


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, columns: list[str], tolerance: float) -> DataFrame:
    """Every row of ``left`` with ``columns`` of the nearest right row in time and its ``matched_t``.

    Ties go to the earlier row; a distance of exactly ``tolerance`` still matches; others get NULLs.
    """
    found = _bracketed(left, right, keys, t, {c: F.col(c) for c in columns})
    db, df_ = F.col("_t") - F.col("_b.t"), F.col("_f.t") - F.col("_t")
    near = F.when(df_.isNull() | (db <= df_), F.col("_b")).otherwise(F.col("_f"))
    found = found.withColumn("_n", near).withColumn("_n", F.when(F.abs(F.col("_n.t") - F.col("_t")) <= tolerance, F.col("_n")))
    return found.select("_l.*", F.col("_n.t").alias("matched_t"), *[F.col(f"_n.{c}").alias(c) for c in columns])


def interpolate_at(left: DataFrame, right: DataFrame, keys: list[str], t: str, column: str, out: str, max_gap: float | None = None, max_bracket: float | None = None, clamp: bool = True) -> DataFrame:
    """Every row of ``left`` with ``column`` interpolated between the right rows around it.

    max_gap: NULL if the nearer of the two is farther away.  max_bracket: NULL if the two are farther
    apart.  Outside the right rows' range the end value holds if ``clamp``, else NULL.
    """
    found = _bracketed(left, right.filter(F.col(column).isNotNull()), keys, t, {"v": F.col(column)})
    t0, v0, t1, v1 = (F.col(c) for c in ("_b.t", "_b.v", "_f.t", "_f.v"))
    at = F.col("_t")
    value = F.when(at == t0, v0).when(t0.isNull(), v1 if clamp else F.lit(None)).when(t1.isNull(), v0 if clamp else F.lit(None)).otherwise(v0 + (v1 - v0) * (at - t0) / (t1 - t0))
    if max_gap is not None:
        value = F.when(F.least(at - t0, t1 - at) <= max_gap, value)
    if max_bracket is not None:
        value = F.when((at == t0) | (t1 - t0 <= max_bracket), value)
    return found.select("_l.*", value.alias(out))


#: Intervals shorter than this power of two (of the time's unit) share cells of that size.
FINEST = -16


def _covered(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Each interval once per cell that it touches: cells of a power of two (_width) between an eighth and a fourth of its length, by their begin (_cell)."""
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    held = intervals.filter(e >= s).withColumn("_width", F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(e - s, F.lit(4 * 2.0**FINEST)))) - 2))
    low = s - F.pmod(s, F.col("_width"))
    cells = F.sequence(F.lit(0), F.floor((e - low) / F.col("_width")).cast("int"))
    return held.withColumn("_cell", F.explode(F.transform(cells, lambda k: low + k * F.col("_width"))))


def cell_pairs(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str, end: str) -> DataFrame:
    """Points beside the intervals of their key with which they share a cell; a pair that matches comes once, others lie within a fourth of the interval's length of it.

    Lengths that differ by less than a factor of two share a cell size.  A point looks up its cell of each
    size that occurs (one number a power of two), so the join is an equality on (key, size, cell): intervals
    may overlap, and a key with most of the rows is dealt out by its cells.
    """
    cells = stored(_covered(intervals, start, end), "cells")
    sizes = cells.agg(F.collect_set("_width").alias("_width"))
    at = F.col(t).cast("double")
    looked = points.crossJoin(F.broadcast(sizes)).withColumn("_width", F.explode("_width")).withColumn("_cell", at - F.pmod(at, F.col("_width")))  # one row of sizes
    return looked.join(cells, [*keys, "_width", "_cell"]).drop("_width", "_cell")


def frames_in_bouts(frames: DataFrame, bouts: DataFrame, keys: list[str], t: str, start: str = "bout_start_sec", end: str = "bout_end_sec", valid: Column | None = None) -> DataFrame:
    """Frames inside closed intervals of the same key, with the interval's columns; only valid frames if asked.

    Intervals may overlap; one that ends before it starts, or has no start or end, holds nothing.
    """
    rows = frames if valid is None else frames.filter(valid)
    return cell_pairs(rows, bouts, keys, t, start, end).filter(F.col(t).between(F.col(start), F.col(end)))


def nonempty_bouts(frames: DataFrame, bouts: DataFrame, keys: list[str], t: str, start: str = "bout_start_sec", end: str = "bout_end_sec", valid: Column | None = None) -> DataFrame:
    """Intervals that hold at least one (valid) frame; equal ones as often as they occur."""
    rows = (frames if valid is None else frames.filter(valid)).select(*keys, F.col(t).alias("_t"))
    counted = bouts.groupBy(*bouts.columns).agg(F.count("*").alias("_times"))
    found = cell_pairs(rows, counted, keys, "_t", start, end).filter(F.col("_t").between(F.col(start), F.col(end)))
    held = found.groupBy(*bouts.columns).agg(F.first("_times").alias("_times"))
    return held.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*bouts.columns)


def inside_any(frames: DataFrame, bouts: DataFrame, keys: list[str], t: str, out: str, start: str = "bout_start_sec", end: str = "bout_end_sec") -> DataFrame:
    """``frames`` with ``out``: whether an interval of the key holds the frame."""
    at = frames.select(*keys, F.col(t).alias("_t")).distinct()
    spans = bouts.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).distinct()
    held = cell_pairs(at, spans, keys, "_t", "_s", "_e").filter("_t BETWEEN _s AND _e").select(*[F.col(k).alias(f"_{k}") for k in keys], "_t").distinct()
    on = F.col(t) == F.col("_t")
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    return frames.join(held, on, "left").withColumn(out, F.col("_t").isNotNull()).drop("_t", *[f"_{k}" for k in keys])


def overlapping(bouts: DataFrame, t0: float, t1: float, pad: float = 0.0, start: str = "bout_start_sec", end: str = "bout_end_sec") -> DataFrame:
    """Intervals that touch [t0 - pad, t1 + pad]."""
    return bouts.filter((F.col(end) >= t0 - pad) & (F.col(start) <= t1 + pad))


def matched_medians(bouts: DataFrame, a: DataFrame, b: DataFrame, keys: list[str], t: str, value: str, offset: Column, least: int) -> DataFrame:
    """Per interval the median of ``value`` in two tracks, the second on a clock shifted by ``offset``; both need ``least`` samples."""
    bouts = stored(bouts, "bouts")  # both tracks read it, and intervals are dear to find
    one = frames_in_bouts(a, bouts, keys, t).groupBy(*keys, "bout_index").agg(F.percentile(value, 0.5).alias("median_a"), F.count(value).alias("n_a"))
    shifted = bouts.withColumns({"_s": F.col("bout_start_sec") + offset, "_e": F.col("bout_end_sec") + offset})
    two = frames_in_bouts(b, shifted, keys, t, "_s", "_e").groupBy(*keys, "bout_index").agg(F.percentile(value, 0.5).alias("median_b"), F.count(value).alias("n_b"))
    return one.join(two, [*keys, "bout_index"]).filter((F.col("n_a") >= least) & (F.col("n_b") >= least))


def clip_to_window(bouts: DataFrame, entries: DataFrame, lane: list[str], entry: str, length: float, lane_end: str | None = None) -> DataFrame:
    """Intervals that start before entry + length, their ends clipped there; lanes that end before that are left out."""
    found = bouts.join(entries, lane)
    cut = F.col(entry) + length
    if lane_end:
        found = found.filter(F.col(lane_end) >= cut)
    return found.filter(F.col("bout_start_sec") < cut).withColumn("bout_end_sec", F.least("bout_end_sec", cut)).withColumn("bout_duration_sec", F.col("bout_end_sec") - F.col("bout_start_sec"))


def unique_lookup(facts: DataFrame, lut: DataFrame, fact_keys: list[Column], lut_keys: list[Column], prefix: str) -> DataFrame:
    """``facts`` with <prefix>_n, the number of lookup rows that match, and <prefix>, the row itself if there is exactly one."""
    names = [f"_k{i}" for i in range(len(lut_keys))]
    keyed = lut.select(*[c.alias(n) for c, n in zip(lut_keys, names, strict=True)], F.struct(*lut.columns).alias("_row"))
    keyed = keyed.groupBy(*names).agg(F.count("*").alias("_c"), F.first("_row").alias("_one"))
    on = F.lit(True)
    for c, n in zip(fact_keys, names, strict=True):
        on &= c == F.col(n)
    found = facts.join(keyed, on, "left")
    return found.withColumns({f"{prefix}_n": F.coalesce("_c", F.lit(0)), prefix: F.when(F.col("_c") == 1, F.col("_one"))}).drop(*names, "_c", "_one")


def resolve(files: DataFrame, lut: DataFrame, exact: tuple[list[Column], list[Column]], token: tuple[list[Column], list[Column]]) -> DataFrame:
    """Files with ``status`` and the lookup row ``meta``: exact match first, by token only where exact found nothing."""
    found = unique_lookup(files, lut, *exact, "_exact")
    found = unique_lookup(found, lut, *token, "_token")
    status = (
        F.when(F.col("_exact_n") == 1, "matched_exact")
        .when(F.col("_exact_n") > 1, "ambiguous_exact")
        .when(F.col("_token_n") == 1, "matched_token")
        .when(F.col("_token_n") > 1, "ambiguous_token")
        .otherwise("unmatched")
    )
    meta = F.when(F.col("_exact_n") > 0, F.col("_exact")).otherwise(F.col("_token"))
    return found.withColumns({"status": status, "meta": meta}).drop("_exact", "_exact_n", "_token", "_token_n")


def attach_metadata(facts: DataFrame, resolved: DataFrame, file_key: str, columns: list[str]) -> DataFrame:
    """Facts of matched files with metadata columns; unmatched files are left out (they stay in the report)."""
    meta = resolved.filter(F.col("status").startswith("matched")).select(F.col(file_key), *[F.col(f"meta.{c}").alias(c) for c in columns])
    return facts.join(meta, file_key)


def strict_left(facts: DataFrame, lookup: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Left join to a lookup made distinct; an unmatched row is an error when it is read (or keeps NULLs if not strict)."""
    found = facts.join(lookup.dropna(subset=keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    if strict:
        found = found.withColumn("_hit", F.coalesce("_hit", F.raise_error(F.concat(F.lit("no lookup row for "), F.to_json(F.struct(*keys)))).cast("boolean"))).filter("_hit")
    return found.drop("_hit")


def by_precedence(sources: list[DataFrame], unit: list[str], last: bool = True) -> DataFrame:
    """Whole units from the last (or first) source that has them."""
    every = None
    for k, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(k))
        every = s if every is None else every.unionByName(s, allowMissingColumns=True)
    pick = (F.max if last else F.min)("_source").over(Window.partitionBy(*unit))
    return every.withColumn("_pick", pick).filter("_source = _pick").drop("_source", "_pick")


def duplicates(sources: list[DataFrame], unit: list[str]) -> DataFrame:
    """Units that more than one source has, with how many."""
    every = None
    for s in sources:
        s = s.select(*unit).distinct()
        every = s if every is None else every.unionByName(s)
    return every.groupBy(*unit).agg(F.count("*").alias("n_sources")).filter("n_sources > 1")


def guard_unique(df: DataFrame, unit: list[str]) -> DataFrame:
    """``df``, whose reading fails if a unit occurs twice."""
    n = F.count("*").over(Window.partitionBy(*unit))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.to_json(F.struct(*unit)))).cast("long")).otherwise(n)
    return df.withColumn("_n", checked).filter("_n = 1").drop("_n")


def override(base: DataFrame, overrides: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` replaced where an override row gives them, and ``overridden``."""
    new = overrides.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns], F.lit(True).alias("_hit"))
    found = base.join(new, keys, "left")
    found = found.withColumns({c: F.coalesce(f"_o_{c}", c) for c in columns} | {"overridden": F.coalesce("_hit", F.lit(False))})
    return found.drop("_hit", *[f"_o_{c}" for c in columns])


def append_missing(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and the rows of ``extra`` whose keys it lacks."""
    return base.unionByName(extra.join(base.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def count_lookup(base: DataFrame, events: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``base`` with how many rows of ``events`` have its keys, 0 where none."""
    n = events.groupBy(*keys).agg(F.count("*").alias(out))
    return base.join(n, keys, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys whose ``column`` differs between two tables, or that only one has."""
    both = a.select(*keys, F.col(column).alias("left_value")).join(b.select(*keys, F.col(column).alias("right_value")), keys, "full")
    return both.filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def fill_dimension(df: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with the first non-null value of each column per key of ``source``, by order of the values."""
    dim = source.groupBy(*keys).agg(*[F.min(c).alias(c) for c in columns])
    return df.drop(*columns).join(dim, keys, "left")
