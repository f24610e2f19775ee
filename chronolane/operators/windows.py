"""Ordered-sequence operators: rolling statistics, steps, runs, islands and closed-form state machines.

Every operator partitions by the sequence key, so one exchange and one sort serve a whole chain of
them; orders end in a unique column, so results don't depend on how rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronolane.operators.joins import frames_in_bouts
from chronolane.sources.scratch import stored


def sequence(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def centred(spec: WindowSpec, width: int) -> WindowSpec:
    """``width`` rows around the current one; an even width has one more before than after."""
    return spec.rowsBetween(-(width // 2), (width - 1) // 2)


def _on_valid(df: DataFrame, x: str, keys: list[str], order: list[str], width: int) -> WindowSpec:
    """A centred frame over the rows where ``x`` isn't null, as if the others weren't there."""
    return centred(Window.partitionBy(*keys, F.col(x).isNull()).orderBy(*order), width)


def median_of(values: Column) -> Column:
    """The median of an array without nulls."""
    s = F.array_sort(values)
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def roll_median_valid(df: DataFrame, x: str, out: str, keys: list[str], order: list[str], width: int) -> DataFrame:
    """Centred rolling median over the non-null values of ``x``; NULL where ``x`` is."""
    w = _on_valid(df, x, keys, order, width)
    return df.withColumn(out, F.when(F.col(x).isNotNull(), F.percentile(x, 0.5).over(w)))


def roll_dispersion(df: DataFrame, x: str, out: str, keys: list[str], order: list[str], width: int, metric: str = "mad") -> DataFrame:
    """Centred rolling "mad", "iqr" or "sd" over the non-null values; fewer than three in the frame give NULL."""
    w = _on_valid(df, x, keys, order, width)
    if metric == "mad":
        held = f"_{out}_values"
        df = df.withColumn(held, F.collect_list(x).over(w))
        mid = median_of(F.col(held))
        return df.withColumn(out, F.when(F.col(x).isNotNull() & (F.size(held) >= 3), median_of(F.transform(held, lambda v: F.abs(v - mid))))).drop(held)
    spread = {"iqr": F.percentile(x, 0.75).over(w) - F.percentile(x, 0.25).over(w), "sd": F.stddev_samp(x).over(w)}[metric]
    return df.withColumn(out, F.when(F.col(x).isNotNull() & (F.count(x).over(w) >= 3), spread))


def roll_median_raw(df: DataFrame, x: str, out: str, keys: list[str], order: list[str], before: int, after: int, least: int = 1) -> DataFrame:
    """Rolling median where nulls take up places; NULL with fewer than ``least`` values in the frame."""
    w = sequence(keys, order).rowsBetween(-before, after)
    return df.withColumn(out, F.when(F.count(x).over(w) >= least, F.percentile(x, 0.5).over(w)))


def velocity(df: DataFrame, t: str, x: str, y: str | None, keys: list[str], order: list[str], out: str = "velocity", out_x: str = "velocity_x") -> DataFrame:
    """Signed x speed and speed from the row just before; NULL if either end is NULL or no time passed."""
    w = sequence(keys, order)
    dt = F.nullif(F.col(t) - F.lag(t).over(w), F.lit(0.0))
    dx = F.col(x) - F.lag(x).over(w)
    step = F.abs(dx) if y is None else F.hypot(dx, F.col(y) - F.lag(y).over(w))
    return df.withColumns({out_x: dx / dt, out: step / dt})


def features(
    df: DataFrame, t: str, x: str, y: str, valid: Column, keys: list[str], order: list[str], smooth: int = 5, dispersion: int = 5, speed: int = 5, metric: str = "mad", temperature: str | None = None
) -> DataFrame:
    """The feature layer: x_smooth, x_dispersion, velocity_x, velocity, velocity_smooth (and temperature_smooth).

    Coordinates of invalid rows are NULL, never 0, so speeds at and after them are NULL.
    """
    df = df.withColumns({"_vx": F.when(valid, F.col(x)), "_vy": F.when(valid, F.col(y))})
    df = velocity(df, t, "_vx", "_vy", keys, order)
    df = roll_median_raw(df, "velocity", "velocity_smooth", keys, order, speed // 2, (speed - 1) // 2, least=2)
    df = roll_median_valid(df, "_vx", "x_smooth", keys, order, smooth)
    df = roll_dispersion(df, "_vx", "x_dispersion", keys, order, dispersion, metric)
    if temperature:
        df = roll_median_valid(df, temperature, "temperature_smooth", keys, order, 3)
    return df.drop("_vx", "_vy")


def runs(df: DataFrame, flag: str, keys: list[str], order: list[str], out: str = "run") -> DataFrame:
    """Numbers the runs of equal values of ``flag`` in each sequence, from 1."""
    w = sequence(keys, order)
    changed = F.coalesce((~F.col(flag).eqNullSafe(F.lag(flag).over(w))) | (F.row_number().over(w) == 1), F.lit(True))
    return df.withColumn(out, F.sum(changed.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def islands(
    df: DataFrame, t: str, state: str, keys: list[str], order: list[str], least: float, gap: float, unknown_gap: float | None = None, inside: str = "stationary", unknown: str = "unknown"
) -> DataFrame:
    """One row per merged interval of ``inside`` rows: keys, bout_index, bout_start_sec, bout_end_sec, bout_duration_sec, n_samples, first_row, last_row.

    Runs merge when the time between them is at most ``gap``, or at most the larger of ``gap`` and
    ``unknown_gap`` if nothing but ``unknown`` rows lies between.  A merged interval counts if its last
    time minus its first is at least ``least``; intervals are numbered from 0.  The merge looks at the
    run before alone, so two passes of lag and running sums over runs do it.
    """
    w = sequence(keys, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(*keys, *order, F.col(t).alias("_t"), F.col(state).alias("_s")).withColumns({"_row": F.row_number().over(w), "_other": F.sum(F.when((F.col("_s") == inside) | (F.col("_s") == unknown), 0).otherwise(1)).over(upto)})
    begins = (F.col("_s") == inside) & ~F.lag("_s").over(w).eqNullSafe(F.lit(inside))
    rows = rows.withColumn("_run", F.sum(begins.cast("long")).over(upto)).filter(F.col("_s") == inside)
    run = rows.groupBy(*keys, "_run").agg(F.min("_row").alias("_r0"), F.max("_row").alias("_r1"), F.min("_t").alias("_t0"), F.max("_t").alias("_t1"), F.first("_other").alias("_other"))
    by = Window.partitionBy(*keys).orderBy("_run")
    wide = max(gap, gap if unknown_gap is None else unknown_gap)
    allowed = F.when(F.col("_other") == F.lag("_other").over(by), wide).otherwise(gap)
    fresh = F.lag("_t1").over(by).isNull() | (F.col("_t0") - F.lag("_t1").over(by) > allowed)
    run = run.withColumn("_new", fresh.cast("long")).withColumn("_bout", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    found = run.groupBy(*keys, "_bout").agg(F.min("_t0").alias("bout_start_sec"), F.max("_t1").alias("bout_end_sec"), F.min("_r0").alias("first_row"), F.max("_r1").alias("last_row"))
    found = found.withColumn("bout_duration_sec", F.col("bout_end_sec") - F.col("bout_start_sec")).filter(F.col("bout_duration_sec") >= least)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_bout")) - 1
    return found.select(*keys, number.cast("long").alias("bout_index"), "bout_start_sec", "bout_end_sec", "bout_duration_sec", (F.col("last_row") - F.col("first_row") + 1).cast("long").alias("n_samples"), "first_row", "last_row")


def bout_metrics(df: DataFrame, bouts: DataFrame, keys: list[str], order: list[str], metrics: dict[str, Column]) -> DataFrame:
    """Means over all rows from a bout's first to its last, bridged gaps included, nulls skipped."""
    bouts = stored(bouts, "bouts")
    rows = df.withColumn("_row", F.row_number().over(sequence(keys, order)))
    held = bouts.select(*keys, "bout_index", "first_row", "last_row")
    inside = frames_in_bouts(rows, held, keys, "_row", "first_row", "last_row")
    means = inside.groupBy(*keys, "bout_index").agg(*[F.avg(c).alias(n) for n, c in metrics.items()])
    return bouts.drop("first_row", "last_row").join(means, [*keys, "bout_index"], "left")


def bout_summary(files: DataFrame, bouts: DataFrame, keys: list[str], t: str, preferred: str | None = None) -> DataFrame:
    """Per sequence: trial length, bouts, total, fraction, mean and median duration, rate per 1000 s; sequences without bouts appear."""
    lengths = files.groupBy(*keys).agg(F.max(t).alias("trial_length_sec"))
    aggs = [F.count("*").alias("_n"), F.sum("bout_duration_sec").alias("_total"), F.avg("bout_duration_sec").alias("mean_bout_duration_sec"), F.percentile("bout_duration_sec", 0.5).alias("median_bout_duration_sec")]
    aggs += [F.avg(preferred).alias("mean_preferred")] if preferred else []
    found = lengths.join(bouts.groupBy(*keys).agg(*aggs), keys, "left")
    length = F.when(F.col("trial_length_sec") != 0, F.col("trial_length_sec"))
    n, total = F.coalesce("_n", F.lit(0)), F.coalesce("_total", F.lit(0.0))
    return found.select(
        *keys, "trial_length_sec", n.alias("n_bouts"), total.alias("total_sec"), (total / length).alias("fraction"), "mean_bout_duration_sec", "median_bout_duration_sec", (n / length * 1000).alias("bouts_per_1000s"), *(["mean_preferred"] if preferred else [])
    )


def steps(df: DataFrame, t: str, x: str, y: str, valid: Column, keys: list[str], order: list[str], floor: float, longest_gap: float) -> DataFrame:
    """Steps between successive valid rows: dt, and step (0 if below ``floor`` or after a gap above ``longest_gap``)."""
    w = sequence(keys, order)
    rows = df.filter(valid)
    dt = F.col(t) - F.lag(t).over(w)
    far = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return rows.withColumns({"dt": dt, "step": F.when((dt > longest_gap) | (far < floor), 0.0).otherwise(F.coalesce(far, F.lit(0.0)))})


def running_total(df: DataFrame, value: str, out: str, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(sequence(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def state_runs(df: DataFrame, state: str, keys: list[str], order: list[str]) -> DataFrame:
    """One row per run of a state: keys, state, run_start, run_end (row positions from 0) and run_length."""
    w = sequence(keys, order)
    rows = runs(df.select(*keys, *order, F.col(state).alias("state")), "state", keys, order, "_run").withColumn("_pos", F.row_number().over(w) - 1)
    found = rows.groupBy(*keys, "_run", "state").agg(F.min("_pos").alias("run_start"), F.max("_pos").alias("run_end"))
    return found.withColumn("run_length", F.col("run_end") - F.col("run_start") + 1).drop("_run")


def first_qualifying_run(df: DataFrame, state: str, value: str, length: int, keys: list[str], order: list[str], out: str = "position") -> DataFrame:
    """Per sequence the row position at which a run of ``length`` rows of ``value`` is first complete; NULL if none is."""
    found = state_runs(df, state, keys, order)
    done = F.when((F.col("state") == value) & (F.col("run_length") >= length), F.col("run_start") + length - 1)
    return found.groupBy(*keys).agg(F.min(done).alias(out))


def entry_index(df: DataFrame, state: str, keys: list[str], order: list[str], sustained: int, intrusion: int, seen_from: Column | None = None, inside: str = "mouse", handling: str = "intrusion") -> DataFrame:
    """First row of a sustained ``inside`` run once a run of ``handling`` has been long enough.

    The handling counts as seen from the row that completes its first qualifying run, or from
    ``seen_from`` (a column of the keys) if earlier.  An inside run counts from the later of its start and
    that row, and must go on for ``sustained`` rows from there.
    """
    found = state_runs(df, state, keys, order)
    by = Window.partitionBy(*keys)
    seen = F.min(F.when((F.col("state") == handling) & (F.col("run_length") >= intrusion), F.col("run_start") + intrusion - 1)).over(by)
    found = found.withColumn("_seen", seen if seen_from is None else F.least(seen, seen_from))
    start = F.greatest("run_start", "_seen")
    ok = (F.col("state") == inside) & F.col("_seen").isNotNull() & (F.col("run_end") - start + 1 >= sustained)
    return found.groupBy(*keys).agg(F.min(F.when(ok, start)).alias("entry"))


def entries_with_borrowing(df: DataFrame, state: str, session: list[str], lane: str, order: list[str], sustained: int, intrusion: int, inside: str = "mouse", handling: str = "intrusion") -> DataFrame:
    """entry_index() per lane, where a lane without a qualifying handling of its own borrows its session's earliest."""
    keys = [*session, lane]
    own = first_qualifying_run(df, state, handling, intrusion, keys, order, "own")
    own = own.withColumn("seen", F.coalesce("own", F.min("own").over(Window.partitionBy(*session))))
    marked = df.join(own, keys)
    found = state_runs(marked, state, keys, order).join(own, keys)
    start = F.greatest("run_start", "seen")
    ok = (F.col("state") == inside) & F.col("seen").isNotNull() & (F.col("run_end") - start + 1 >= sustained)
    entry = found.groupBy(*keys).agg(F.min(F.when(ok, start)).alias("entry"), F.first("own").alias("own"))
    return entry.withColumn("via_other_lane", F.col("entry").isNotNull() & F.col("own").isNull())


def tracking_start(df: DataFrame, stable: Column, frame: str, keys: list[str], order: list[str], required: int) -> DataFrame:
    """Frame of the first row of the first run of ``required`` stable rows; 0 with method "fallback" where there is none."""
    rows = runs(df.withColumn("_ok", F.coalesce(stable, F.lit(False))), "_ok", keys, order, "_run")
    found = rows.groupBy(*keys, "_run", "_ok").agg(F.min(F.struct(*order, F.col(frame).alias("_frame"))).alias("_at"), F.count("*").alias("_n"))
    start = F.min(F.when(F.col("_ok") & (F.col("_n") >= required), F.struct(F.col("_run"), F.col("_at._frame").alias("frame"))))
    found = found.groupBy(*keys).agg(start.alias("_start"))
    return found.select(*keys, F.coalesce(F.col("_start.frame"), F.lit(0)).alias("start_frame"), F.when(F.col("_start").isNull(), "fallback").otherwise("auto").alias("method"))


def jump_flag(df: DataFrame, x: str, y: str, detected: Column, keys: list[str], order: list[str], farthest: float, out: str = "jump") -> DataFrame:
    """Whether a detected row lies farther than ``farthest`` from the last detected one."""
    before = sequence(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    lx, ly = (F.last(F.when(detected, F.col(c)), ignorenulls=True).over(before) for c in (x, y))
    return df.withColumn(out, detected & F.coalesce(F.hypot(F.col(x) - lx, F.col(y) - ly) > farthest, F.lit(False)))


def nudges(df: DataFrame, x: str, y: str, keys: list[str], order: list[str], threshold: float) -> DataFrame:
    """Rows that lie more than ``threshold`` from the row before, with the displacement."""
    w = sequence(keys, order)
    far = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return df.withColumn("displacement", far).filter(F.col("displacement") > threshold)


def motion_energy(df: DataFrame, t: str, x: str, y: str, valid: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Speed between successive valid rows, the first being 0; sequences with fewer than two valid rows are left out."""
    w = sequence(keys, order)
    rows = df.filter(valid).withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n >= 2").drop("_n")
    rows = velocity(rows, t, x, y, keys, order, "energy", "_vx").drop("_vx")
    return rows.withColumn("energy", F.coalesce("energy", F.lit(0.0)))


def motion_peak(df: DataFrame, x: str, keys: list[str], order: list[str], history: int = 8, recent: int = 2) -> DataFrame:
    """The row of each sequence that differs most from the median of the ``history`` rows before it, less the ``recent`` last."""
    w = sequence(keys, order).rowsBetween(-history, -recent - 1)
    rows = df.withColumn("energy", F.abs(F.col(x) - F.percentile(x, 0.5).over(w))).filter("energy IS NOT NULL")
    best = Window.partitionBy(*keys).orderBy(F.desc("energy"), *order)
    return rows.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def pick_moments(df: DataFrame, x: str, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The row that moves most in each of ``n`` equal stretches of a sequence; the earliest of ties."""
    w = sequence(keys, order)
    rows = df.withColumns({"moment": F.ntile(n).over(w), "_dx": F.abs(F.col(x) - F.lag(x).over(w))}).filter("_dx IS NOT NULL")
    best = Window.partitionBy(*keys, "moment").orderBy(F.desc("_dx"), *order)
    return rows.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r", "_dx")


def local_minima(df: DataFrame, x: str, keys: list[str], order: list[str], reach: int) -> DataFrame:
    """Rows no larger than any other within ``reach`` rows."""
    w = sequence(keys, order).rowsBetween(-reach, reach)
    return df.withColumn("_m", F.min(x).over(w)).filter(F.col(x) == F.col("_m")).drop("_m")


def competing_minimum(df: DataFrame, at: str, x: str, keys: list[str], order: list[str], reach: int, distance: float) -> DataFrame:
    """Per sequence the best local minimum farther than ``distance`` from the best of all: competing_at, competing."""
    best = Window.partitionBy(*keys)
    rows = local_minima(df.withColumn("_best", F.min_by(at, F.struct(x, at)).over(best)), x, keys, order, reach)
    rows = rows.filter(F.abs(F.col(at) - F.col("_best")) > distance)
    return rows.groupBy(*keys).agg(F.min_by(at, F.struct(x, at)).alias("competing_at"), F.min(x).alias("competing"))


def trace_up_to(df: DataFrame, t: str, x: str, keys: list[str], until: float) -> DataFrame:
    """Rows up to a time, plus one interpolated there where a row follows it."""
    w = sequence(keys, [t])
    nxt, nx = F.lead(t).over(w), F.lead(x).over(w)
    rows = df.select(*keys, F.col(t), F.col(x), nxt.alias("_t1"), nx.alias("_x1")).filter(F.col(t) <= until)
    last = rows.filter((F.col("_t1") > until) & (F.col(t) < until))
    end = last.select(*keys, F.lit(float(until)).alias(t), (F.col(x) + (F.col("_x1") - F.col(x)) * (until - F.col(t)) / (F.col("_t1") - F.col(t))).alias(x))
    return rows.select(*keys, t, x).unionByName(end)


def rank_color(df: DataFrame, group: str, unit: str, colors: int = 6) -> DataFrame:
    """A colour index for each unit: its place within its group, modulo the palette."""
    return df.select(group, unit).distinct().withColumn("color", ((F.row_number().over(Window.partitionBy(group).orderBy(unit)) - 1) % colors).cast("long"))
