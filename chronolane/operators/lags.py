"""Lags between two traces from correlograms that are sums.

Both traces are read on one grid and cut into blocks of time.  A pair of blocks adds its products to the lags
it spans, whatever task it is in; what pairs of one distance give is one array, so a task hands on an array per
key and distance, and the sums of all tasks meet by (key, lag).  No trace is ever in one place.

For lags alone the grid isn't stored: a block travels as the samples it is interpolated from, and a trace of
one block is done where it is filled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.operators.joins import frames_in_bouts, interpolate_at
from chronolane.operators.models import affine_lag
from chronolane.sources.scratch import stored

BLOCK = 4096
POINTS = 1 << 20  # steps that a task fills at a time


def common_grid(df: DataFrame, keys: list[str], t: str, a: str, b: str, dt: float) -> DataFrame:
    """Both traces at every ``dt`` of their overlap, interpolated: keys, _i, _x and _y; keys with an overlap under four steps are left out."""
    ends = df.groupBy(*keys).agg(*[f(F.when(F.col(c).isNotNull(), F.col(t))).alias(n) for c, f, n in ((a, F.min, "a0"), (b, F.min, "b0"), (a, F.max, "a1"), (b, F.max, "b1"))])
    span = ends.select(*keys, F.greatest("a0", "b0").alias("_lo"), F.least("a1", "b1").alias("_hi")).filter(F.col("_hi") - F.col("_lo") >= 4 * dt)
    steps = F.sequence(F.lit(0).cast("long"), F.ceil((F.col("_hi") - F.col("_lo")) / dt) - 1)
    grid = span.select(*keys, F.explode(steps).alias("_i"), "_lo").select(*keys, "_i", (F.col("_lo") + F.col("_i") * dt).alias(t))
    some = interpolate_at(grid, df.select(*keys, t, a), keys, t, a, "_x")
    return interpolate_at(some, df.select(*keys, t, b), keys, t, b, "_y").select(*keys, "_i", "_x", "_y")


def correlogram(grid: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Per key and lag (in steps, positive where _y comes later) the sum of products of the traces less their means; keys whose trace is constant are left out."""
    flat = lambda c: F.max(F.abs(F.col(c))) <= 1e-8
    means = grid.groupBy(*keys).agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    rows = grid.join(means, keys).withColumns({"_x": F.col("_x") - F.col("_mx"), "_y": F.col("_y") - F.col("_my"), "_b": F.floor(F.col("_i") / block).cast("int")}).drop("_mx", "_my")
    still = rows.groupBy(*keys).agg((flat("_x") | flat("_y")).alias("_still")).filter("NOT _still").drop("_still")
    held = rows.join(still, keys).groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct("_i", "_x", "_y"))).alias("_s"))  # at most ``block`` of them
    side = lambda c, n: held.select(*keys, F.col("_b").alias(f"_{n}"), F.transform("_s", lambda s: s[c]).alias(c))
    pairs = side("_x", "p").join(side("_y", "q"), keys).select(F.struct(*keys).alias("_k"), (F.col("_q") - F.col("_p")).alias("_d"), "_x", "_y")
    kind = T.StructType([pairs.schema["_k"], T.StructField("_d", T.IntegerType()), T.StructField("_c", T.ArrayType(T.DoubleType()))])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Arrays of the lags from 1 - block to block - 1 within a pair, summed over pairs of one key and distance as they come."""
        names: list = []
        sums: dict[tuple, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            values = pa.array(list(sums.values()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(names, shape), pa.array([d for _, d in sums], pa.int32()), values], ["_k", "_d", "_c"])

        shape = None
        for batch in batches:
            shape = batch.schema.field(0).type
            for k, d, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                size = 1 << (len(x) + len(y) - 1).bit_length()
                c = np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size)
                out = np.zeros(2 * block - 1)
                out[block - len(x) : block - 1] = c[size - len(x) + 1 :]
                out[block - 1 : block - 1 + len(y)] = c[: len(y)]
                at = (tuple(k.values()), d)
                if at in sums:
                    sums[at] += out
                else:
                    sums[at] = out
                    names.append(k)
                if len(sums) * block > 1 << 22:
                    yield given()
                    names.clear()
                    sums.clear()
        if sums:
            yield given()

    parts = pairs.mapInArrow(products, kind)
    lags = parts.select("_k.*", "_d", F.posexplode("_c").alias("_pos", "_c")).filter("_c <> 0")
    return lags.select(*keys, (F.col("_d") * block + F.col("_pos") - (block - 1)).alias("_lag"), "_c").groupBy(*keys, "_lag").agg(F.sum("_c").alias("_c"))


def traces_by_block(df: DataFrame, keys: list[str], t: str, a: str, b: str, dt: float, block: int) -> DataFrame:
    """What common_grid() interpolates from, per key and block of its steps: _k (the keys), _n (steps in all), _lo, _b and _g.

    _g has the line segments of both traces that reach a step of the block, with the steps that they reach
    (from _i up to _j): at most ``block`` of each trace, and as few as there are samples where those are sparse.
    """
    ends = df.groupBy(*keys).agg(*[f(F.when(F.col(c).isNotNull(), F.col(t))).alias(n) for c, f, n in ((a, F.min, "a0"), (b, F.min, "b0"), (a, F.max, "a1"), (b, F.max, "b1"))])
    span = ends.select(*keys, F.greatest("a0", "b0").alias("_lo"), F.least("a1", "b1").alias("_hi")).filter(F.col("_hi") - F.col("_lo") >= 4 * dt)
    span = span.select(*keys, "_lo", F.ceil((F.col("_hi") - F.col("_lo")) / dt).cast("long").alias("_n"))
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("s"), F.col(c).cast("double").alias("v")) for k, c in enumerate((a, b))]))
    knots = df.filter(F.col(t).isNotNull()).select(*keys, F.col(t).cast("double").alias("_t"), both.alias("_p")).select(*keys, "_t", F.col("_p.s").alias("_s"), F.col("_p.v").alias("_v")).filter("_v IS NOT NULL")
    by = Window.partitionBy(*keys, "_s").orderBy("_t", "_v")
    lines = knots.join(span, keys).withColumns({"_t1": F.lead("_t").over(by), "_v1": F.lead("_v").over(by)})

    def step(at: Column) -> Column:
        """The first step at or after a time, by the same sums that the steps' times are."""
        k = F.ceil((at - F.col("_lo")) / dt).cast("long")
        return k - (F.col("_lo") + (k - 1) * dt >= at).cast("long") + (F.col("_lo") + k * dt < at).cast("long")

    lines = lines.withColumns({"_i": F.greatest(step(F.col("_t")), F.lit(0)), "_j": F.coalesce(F.least(step(F.col("_t1")), "_n"), "_n")}).filter("_i < _j")
    lines = lines.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_i") / block).cast("int"), F.floor((F.col("_j") - 1) / block).cast("int"))))
    start = F.col("_b").cast("long") * block
    piece = F.struct("_s", F.greatest("_i", start).alias("_i"), F.least("_j", start + block).alias("_j"), "_t", "_v", "_t1", "_v1")
    held = lines.groupBy(*keys, "_n", "_lo", "_b").agg(F.collect_list(piece).alias("_g"))
    return held.select(F.struct(*keys).alias("_k"), "_n", "_lo", "_b", "_g")


def _filled(n: np.ndarray, lo: np.ndarray, b: np.ndarray, g: pa.ListArray, dt: float, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row and both traces at its block's steps, for rows of traces_by_block(); some rows at a time."""
    length = np.minimum(n - b * block, block)
    ends, first = np.cumsum(2 * length), 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + POINTS, "right")))
        some, own = g.slice(first, last - first), length[first:last]
        row = np.repeat(np.arange(last - first), some.value_lengths().to_numpy())
        s, i, j, t0, v0, t1, v1 = (c.to_numpy(zero_copy_only=False) for c in some.flatten().flatten())
        base = np.cumsum(2 * own) - 2 * own
        many, at = j - i, base[row] + s * own[row] - b[first:last][row] * block
        k = np.repeat(np.arange(len(s)), many)
        step = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + i[k]
        when = lo[first:last][row][k] + step * dt
        flat = np.empty(int(2 * own.sum()))
        flat[at[k] + step] = np.where(np.isnan(t1[k]), v0[k], v0[k] + (v1[k] - v0[k]) * (when - t0[k]) / (t1[k] - t0[k]))
        for r, (m, z) in enumerate(zip(own.tolist(), base.tolist(), strict=True)):
            yield first + r, flat[z : z + m], flat[z + m : z + 2 * m]
        first = last


def _still(x: np.ndarray) -> bool:
    return bool(np.max(np.abs(x)) <= 1e-8)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of products at lags from 1 - len(x) to len(y) - 1."""
    size = 1 << (len(x) + len(y) - 1).bit_length()
    c = np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size)
    return np.concatenate([c[size - len(x) + 1 :], c[: len(y)]])


def _short_peaks(held: DataFrame, dt: float, block: int) -> DataFrame:
    """_k and the peak (_c, _lag, _l, _r) of keys of one block, each from its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], [[], [], [], []]
            n, lo, b = (batch.column(c).to_numpy() for c in (1, 2, 3))
            for row, x, y in _filled(n, lo, b, batch.column(4), dt, block):
                x, y = x - x.mean(), y - y.mean()
                if _still(x) or _still(y):
                    continue
                c = _products(x, y)
                k = int(np.argmax(c))
                rows.append(row)
                for o, v in zip(out, (c[k], k - (len(x) - 1), c[k - 1] if k else None, c[k + 1] if k + 1 < len(c) else None), strict=True):
                    o.append(v)
            kinds = (pa.float64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], ["_k", "_c", "_lag", "_l", "_r"])

    return held.mapInArrow(run, T.StructType([held.schema["_k"], *_PEAK]))


_PEAK = [T.StructField("_c", T.DoubleType()), T.StructField("_lag", T.LongType()), T.StructField("_l", T.DoubleType()), T.StructField("_r", T.DoubleType())]


def _long_peaks(held: DataFrame, dt: float, block: int) -> DataFrame:
    """_k and the peak of keys of several blocks: pairs of blocks add up to stretches of ``block`` lags, each of which gives its own peak."""
    sums = ["sx", "sy", "x0", "y0", "x1", "y1"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lo, b = (batch.column(c).to_numpy() for c in (1, 2, 3))
            found = np.array([[f(z) for f in (np.sum, np.min, np.max) for z in (x, y)] for _, x, y in _filled(n, lo, b, batch.column(4), dt, block)]).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in found.T)], ["_k", "_n", *sums])

    kind = T.StructType([held.schema["_k"], held.schema["_n"], *(T.StructField(c, T.DoubleType()) for c in sums)])
    per = held.mapInArrow(measured, kind).groupBy("_k", "_n").agg(*[(F.sum if c[0] == "s" else F.min if c[1] == "0" else F.max)(c).alias(c) for c in sums])
    per = per.withColumns({f"_m{c}": F.col(f"s{c}") / F.col("_n") for c in "xy"})
    moves = F.lit(True)
    for c in "xy":
        moves &= F.greatest(F.col(f"{c}1") - F.col(f"_m{c}"), F.col(f"_m{c}") - F.col(f"{c}0")) > 1e-8
    rows = held.join(per.filter(moves).select("_k", "_mx", "_my"), "_k")
    one = lambda k, m, n: rows.select("_k", "_n", "_lo", F.col("_b").alias(f"_b{n}"), F.filter("_g", lambda s: s["_s"] == k).alias(f"_g{n}"), m)
    pairs = one(0, "_mx", "p").join(one(1, "_my", "q").drop("_n", "_lo"), "_k").select("_k", "_n", "_lo", "_bp", "_gp", "_mx", "_bq", "_gq", "_my")
    kind = T.StructType([held.schema["_k"], held.schema["_n"], T.StructField("_s", T.IntegerType()), T.StructField("_a", T.ArrayType(T.DoubleType()))])

    def given(held_: dict, shape: pa.DataType) -> pa.RecordBatch:
        names = list(held_)
        columns = [pa.array([dict(k) for k, _, _ in names], shape), pa.array([n for _, n, _ in names], pa.int64()), pa.array([s for _, _, s in names], pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(held_.values()), pa.list_(pa.float64()))], ["_k", "_n", "_s", "_a"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of blocks _d apart give lags of the stretches _d - 1 and _d, summed by key and stretch as they come."""
        shape, found = None, {}
        for batch in batches:
            shape = batch.schema.field(0).type
            n, lo, p, mx, q, my = (batch.column(c).to_numpy() for c in (1, 2, 3, 5, 6, 8))
            xs = (x for _, x, _ in _filled(n, lo, p, batch.column(4), dt, block))
            ys = (y for _, _, y in _filled(n, lo, q, batch.column(7), dt, block))
            for r, (k, x, y) in enumerate(zip(batch.column(0).to_pylist(), xs, ys, strict=True)):
                out = np.zeros(2 * block)
                c = _products(x - mx[r], y - my[r])
                out[block - len(x) + 1 : block - len(x) + 1 + len(c)] = c
                for s, part in ((int(q[r] - p[r]) - 1, out[:block]), (int(q[r] - p[r]), out[block:])):
                    at = (tuple(k.items()), int(n[r]), s)
                    found[at] = found[at] + part if at in found else part
                if len(found) * block > 1 << 22:
                    yield given(found, shape)
                    found.clear()
        if found:
            yield given(found, shape)

    stretch = T.StructType([held.schema["_k"], T.StructField("_s", T.IntegerType()), *_PEAK, T.StructField("_first", T.DoubleType()), T.StructField("_last", T.DoubleType())])

    def peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and stretch; one is held."""
        names = [f.name for f in stretch]

        def peak(k: dict, n: int, s: int, a: np.ndarray) -> pa.RecordBatch:
            low, high = max(0, 1 - n - s * block), min(block, n - s * block)
            if low >= high:
                return pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)
            at = low + int(np.argmax(a[low:high]))
            values = (k, s, a[at], s * block + at, a[at - 1] if at > low else None, a[at + 1] if at + 1 < high else None, a[0] if low == 0 else None, a[-1] if high == block else None)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        types, last = None, None
        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.int32(), pa.float64(), pa.int64(), *[pa.float64()] * 4]
            for k, n, s, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                a = a.values.to_numpy()
                if last and last[:3] == (k, n, s):
                    last = (k, n, s, last[3] + a)
                    continue
                if last:
                    yield peak(*last)
                last = (k, n, s, a)
        if last:
            yield peak(*last)

    found = pairs.mapInArrow(products, kind).repartition("_k", "_s").sortWithinPartitions("_k", "_s").mapInArrow(peaks, stretch)
    by = Window.partitionBy("_k").orderBy("_s")
    found = found.withColumns({"_p": F.lag("_last").over(by), "_q": F.lead("_first").over(by)})
    start = F.col("_s").cast("long") * block
    left, right = F.when(F.col("_lag") == start, F.col("_p")).otherwise(F.col("_l")), F.when(F.col("_lag") == start + block - 1, F.col("_q")).otherwise(F.col("_r"))
    best = found.groupBy("_k").agg(F.max(F.struct("_c", (-F.col("_lag")).alias("up"), left.alias("_l"), right.alias("_r"))).alias("m"))
    return best.select("_k", "m._c", (-F.col("m.up")).alias("_lag"), "m._l", "m._r")


def cross_lag(df: DataFrame, keys: list[str], t: str, a: str, b: str, dt: float, block: int = BLOCK) -> DataFrame:
    """Lag of trace b after trace a per key; NULL where there is no overlap or a trace is constant.

    The traces are columns of one table; rows where one is NULL belong to the other alone.  The lag is the
    peak of the correlogram, the smallest of equals, moved by a parabola through its neighbours.  Samples are
    all that is shuffled and written; steps of the grid and lags are made where they are summed, and only
    keys of several blocks hand on sums of lags.
    """
    df = stored(df.select(*keys, t, a, b), "traces")
    held = stored(traces_by_block(df, keys, t, a, b, dt, block), "blocks")
    best = _short_peaks(held.filter(F.col("_n") <= block), dt, block)
    if not (long := held.filter(F.col("_n") > block)).isEmpty():
        best = best.unionByName(_long_peaks(long, dt, block))
    bend = F.col("_l") - 2 * F.col("_c") + F.col("_r")
    moved = F.when(bend.isNotNull() & (bend != 0), 0.5 * (F.col("_l") - F.col("_r")) / bend).otherwise(0.0)
    found = best.select("_k.*", ((F.col("_lag") + moved) * dt).alias("lag_sec"))
    return df.select(*keys).distinct().join(found, keys, "left")


def windowed_lag(df: DataFrame, keys: list[str], t: str, a: str, b: str, dt: float, windows: int = 5, share: float = 0.3) -> DataFrame:
    """A line through the lags of overlapping windows of each key."""
    ends = df.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    span, step = F.col("_hi") - F.col("_lo"), (1 - share) / max(1, windows - 1)
    rows = df.join(ends, keys).withColumn("_w", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    start = F.col("_lo") + F.col("_w") * step * span
    rows = rows.filter((F.col(t) >= start) & (F.col(t) <= start + share * span)).withColumn("_mid", start + share * span / 2)
    lags = cross_lag(rows.select(*keys, "_mid", t, a, b), [*keys, "_mid"], t, a, b, dt)
    return affine_lag(stored(lags.filter("lag_sec IS NOT NULL"), "lags"), keys, "_mid", "lag_sec")


def edge_lag(df: DataFrame, bouts: DataFrame, keys: list[str], t: str, a: str, b: str, dt: float, around: float, coarse: float = 0.0) -> DataFrame:
    """A line through the lags around the starts of intervals, b being read ``coarse`` later."""
    edges = stored(bouts.select(*keys, F.col("bout_start_sec").alias("_edge")).distinct(), "edges")
    held = edges.withColumns({"_s": F.col("_edge") - around, "_e": F.col("_edge") + around})
    nothing = F.lit(None).cast("double")
    one = frames_in_bouts(df.select(*keys, t, F.col(a).cast("double").alias(a)), held, keys, t, "_s", "_e").withColumn(b, nothing)
    two = frames_in_bouts(df.select(*keys, (F.col(t) - coarse).alias(t), F.col(b).cast("double").alias(b)), held, keys, t, "_s", "_e").withColumn(a, nothing)
    rows = one.unionByName(two).select(*keys, "_edge", t, a, b)
    lags = cross_lag(rows, [*keys, "_edge"], t, a, b, dt).filter("lag_sec IS NOT NULL").withColumn("lag_sec", F.col("lag_sec") + coarse)
    return affine_lag(stored(lags, "lags"), keys, "_edge", "lag_sec")
