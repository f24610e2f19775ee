"""Frames as arrays: pixel relations in SQL where the operator is a sum or a rank, numpy kernels where it walks a shape.

A frame is a row with its pixels as an array; ``exploded`` turns it into one row per pixel, on which
masks are predicates and statistics are aggregates.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded(frames: DataFrame, keys: list[str], pixels: str, width: int) -> DataFrame:
    """One row per pixel: keys, px, py and value."""
    rows = frames.select(*keys, F.posexplode(pixels).alias("_pos", "value"))
    return rows.select(*keys, (F.col("_pos") % width).alias("px"), F.floor(F.col("_pos") / width).cast("int").alias("py"), "value")


def background_median(frames: DataFrame, video: list[str], pixels: str) -> DataFrame:
    """The median of each pixel over a video's frames: video, pos, background."""
    return frames.select(*video, F.posexplode(pixels).alias("pos", "_v")).groupBy(*video, "pos").agg(F.percentile("_v", 0.5).alias("background"))


def foreground(pixels: Column, background: Column) -> Column:
    return F.zip_with(pixels, background, lambda a, b: F.abs(a - b))


def threshold(score: Column, sigma: float) -> Column:
    """Mean plus sigma population deviations of an array."""
    n = F.size(score)
    mean = F.aggregate(score, F.lit(0.0), lambda a, v: a + v) / n
    spread = F.aggregate(score, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    return mean + sigma * F.sqrt(spread)


def in_circle(cx: Column, cy: Column, radius: Column | float) -> Column:
    """Whether a pixel lies in a disk, its rim included."""
    return (F.col("px") - cx) * (F.col("px") - cx) + (F.col("py") - cy) * (F.col("py") - cy) <= radius * radius


def in_annulus(cx: Column, cy: Column, inner: float, outer: float) -> Column:
    return in_circle(cx, cy, outer) & ~in_circle(cx, cy, inner)


def in_polygon(points: list[tuple[float, float]]) -> Column:
    """Even-odd rule; fewer than three points hold nothing."""
    if len(points) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1], strict=True):
        if y0 != y1:
            at = x0 + (F.col("py") - y0) * ((x1 - x0) / (y1 - y0))
            spans = (F.col("py") >= min(y0, y1)) & (F.col("py") < max(y0, y1))
            crossings = crossings + (spans & (F.col("px") < at)).cast("int")
    return crossings % 2 == 1


def roi_stats(pixels: DataFrame, keys: list[str], inside: Column) -> DataFrame:
    """mean, median, min, max and count of the pixels inside; NULLs and 0 where there are none."""
    v = F.when(inside, F.col("value"))
    return pixels.groupBy(*keys).agg(F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def roi_predicates(pixels: DataFrame, keys: list[str], cx: Column, cy: Column, radius: float, width: int, height: int, mask: Column) -> DataFrame:
    """Whether a disk lies within the frame, wholly inside a mask, and overlaps it."""
    disk = in_circle(cx, cy, radius)
    bounds = (cx - radius >= 0) & (cy - radius >= 0) & (cx + radius < width) & (cy + radius < height)
    return pixels.groupBy(*keys).agg(F.every(bounds).alias("in_bounds"), F.coalesce(F.every(F.when(disk, mask)), F.lit(False)).alias("inside"), F.coalesce(F.some(disk & mask), F.lit(False)).alias("overlaps"))


def mask_summary(pixels: DataFrame, keys: list[str], mask: Column) -> DataFrame:
    """Area, centroid and bounding box of a mask."""
    x, y = (F.when(mask, F.col(c)) for c in ("px", "py"))
    box = pixels.groupBy(*keys).agg(F.count(x).alias("area"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    return box.select(*keys, "area", "cx", "cy", "x0", "y0", (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"))


def posture(area: Column, w: Column, h: Column, least: int, aspect: float) -> Column:
    """extended or curled by the box's aspect; NULL for blobs that are too small."""
    return F.when(area < least, None).when(F.greatest(w, h) / F.least(w, h) >= aspect, "extended").otherwise("curled")


def entry_state(area: Column, changed: Column, least: int, most: int, intrusion: float) -> Column:
    """empty, mouse or intrusion, by the blob's area and the share of changed pixels."""
    return F.when(changed >= intrusion, "intrusion").when(area.between(least, most), "mouse").otherwise("empty")


def split_row(pixels: DataFrame, keys: list[str], height: int) -> DataFrame:
    """The darkest row between the brightest rows of the upper and the lower half."""
    rows = pixels.groupBy(*keys, "py").agg(F.avg("value").alias("_b"))
    top = F.max_by("py", F.when(F.col("py") < height // 2, F.struct("_b", -F.col("py"))))
    low = F.max_by("py", F.when(F.col("py") >= height // 2, F.struct("_b", -F.col("py"))))
    ends = rows.groupBy(*keys).agg(top.alias("_t"), low.alias("_l"))
    between = rows.join(ends, keys).filter(F.col("py").between(F.col("_t"), F.col("_l")))
    return between.groupBy(*keys).agg(F.min_by("py", F.struct("_b", "py")).alias("split"))


def arc_fractions(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Points with the share of the path's length up to each."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    rows = points.withColumn("_d", step).withColumn("_s", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum("_d").over(Window.partitionBy(*keys))
    return rows.withColumn("fraction", F.col("_s") / F.nullif(total, F.lit(0.0))).drop("_d", "_s")


def nearest_path(pixels: DataFrame, path: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The nearest path point of each pixel of the same frame; the first of ties."""
    p = path.groupBy(*keys, F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.min(order).alias("_i"))
    far = (F.col("px") - F.col("_x")) ** 2 + (F.col("py") - F.col("_y")) ** 2
    return pixels.join(p, keys).groupBy(*keys, "px", "py").agg(F.min_by("_i", F.struct(far, F.col("_i"))).alias("nearest"))


def guarded(value: Column, least: int, stat: str = "median") -> Column:
    """A statistic of at least ``least`` values, else NULL."""
    agg = {"median": lambda: F.percentile(value, 0.5), "mean": lambda: F.avg(value), "p95": lambda: F.percentile(value, 0.95)}[stat]
    return F.when(F.count(value) >= least, agg())


def curve_percentile(points: DataFrame, pixels: DataFrame, keys: list[str], radius: float, p: float = 0.9) -> DataFrame:
    """The p-quantile over path points of the hottest pixel near each; points at one place count each."""
    q = points.groupBy(*keys, F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.count("*").alias("_n"))
    hot = pixels.groupBy(*keys, "px", "py").agg(F.max("value").alias("_v"))
    near = hot.join(q, keys).filter((F.col("px") - F.col("_x")) ** 2 + (F.col("py") - F.col("_y")) ** 2 <= radius * radius)
    return near.groupBy(*keys, "_x", "_y", "_n").agg(F.max("_v").alias("_m")).groupBy(*keys).agg(F.percentile("_m", p, F.col("_n")).alias("curve"))


def iou(pixels: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """Intersection over union of two masks; NULL if both are empty."""
    count = lambda c: F.sum(c.cast("int"))
    return pixels.groupBy(*keys).agg((count(a & b) / F.nullif(count(a | b), F.lit(0))).alias("iou"))


def sigma_search(pixels: DataFrame, keys: list[str], score: str, truth: Column, sigmas: list[float]) -> DataFrame:
    """The sigma with the best mean IoU, the smallest of ties (the parameters are a short literal list)."""
    rows = pixels.withColumn("sigma", F.explode(F.array(*[F.lit(s) for s in sigmas])))
    by = Window.partitionBy(*keys, "sigma")
    cut = F.avg(score).over(by) + F.col("sigma") * F.stddev_pop(score).over(by)
    rows = rows.withColumn("_m", F.col(score) > cut)
    mean = iou(rows, [*keys, "sigma"], F.col("_m"), truth).groupBy("sigma").agg(F.avg("iou").alias("mean_iou"))
    return mean.agg(F.max_by("sigma", F.struct("mean_iou", -F.col("sigma"))).alias("sigma"), F.max("mean_iou").alias("mean_iou"))


# --- kernels ---------------------------------------------------------------------------------------


def squared_distances(mask: Column, width: int, pad: bool = False) -> Column:
    """For each pixel of a mask (booleans by rows) the squared distance to the nearest pixel outside, 0 for those; NULLs where there is none.

    Separable and exact: each column's distance to its nearest outside pixel by a running pick downwards and
    one upwards, then for each pixel the least sum of squares along its row.  With ``pad`` the frame's border
    is outside.  An expression on the row's own arrays: nothing is shuffled.
    """
    never = 1 << 14
    rows = F.transform(F.sequence(F.lit(0), (F.size(mask) / width - 1).cast("int")), lambda r: F.slice(mask, r * width + 1, F.lit(width)))

    def run(rows: Column) -> Column:
        none = F.filter(F.array(F.array_repeat(F.lit(0), 0)), lambda v: F.lit(False))
        first = F.struct(F.array_repeat(F.lit(0 if pad else never), width).alias("last"), none.alias("out"))

        def step(acc: Column, row: Column) -> Column:
            now = F.zip_with(row, acc["last"], lambda inside, far: F.when(inside, far + 1).otherwise(0))
            return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(rows, first, step, lambda acc: acc["out"])

    column = F.zip_with(run(rows), F.reverse(run(F.reverse(rows))), lambda a, b: F.zip_with(a, b, lambda c, d: F.least(c, d)))
    places = F.sequence(F.lit(0), F.lit(width - 1))

    def along(row: Column) -> Column:
        def least(x: Column) -> Column:
            found = F.array_min(F.zip_with(places, row, lambda k, far: F.when(far < never, (x - k) * (x - k) + far * far)))
            return F.least(found, (x + 1) * (x + 1), (width - x) * (width - x)) if pad else found

        return F.transform(places, least)

    return F.flatten(F.transform(column, along))


def deepest_pixel(mask: Column, width: int, radius: float, pad: bool = False) -> Column:
    """struct(x, y) of the pixel farthest from the mask's outside, the first of equals, if that is at least ``radius`` away; else NULL."""
    far = squared_distances(mask, width, pad)
    best = F.array_max(F.transform(far, lambda d, at: F.when(d > 0, F.struct(d.alias("d"), (-at).alias("at")))))
    return F.when(best["d"] >= radius * radius, F.struct((-best["at"] % width).cast("long").alias("x"), F.floor(-best["at"] / width).alias("y")))


def _moved(m: np.ndarray, dy: int, dx: int) -> np.ndarray:
    out = np.zeros_like(m)
    h, w = m.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = m[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


#: A 5 x 5 ellipse.
ELLIPSE = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if abs(dy) < 2 or dx == 0]


def dilate(m: np.ndarray, shape=ELLIPSE) -> np.ndarray:
    return np.any([_moved(m, dy, dx) for dy, dx in shape], axis=0)


def erode(m: np.ndarray, shape=ELLIPSE) -> np.ndarray:
    """What lies beyond the frame counts as set."""
    return ~dilate(~m, [(-dy, -dx) for dy, dx in shape])


def components(m: np.ndarray) -> list[np.ndarray]:
    """4-connected regions as arrays of (y, x), in reading order."""
    seen, found = ~m, []
    for y, x in zip(*np.nonzero(m), strict=True):
        if seen[y, x]:
            continue
        seen[y, x] = True
        todo, part = deque([(y, x)]), []
        while todo:
            a, b = todo.popleft()
            part.append((a, b))
            for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if 0 <= c < m.shape[0] and 0 <= d < m.shape[1] and not seen[c, d]:
                    seen[c, d] = True
                    todo.append((c, d))
        found.append(np.array(part))
    return found


def segment(frame: np.ndarray, background: np.ndarray, sigma: float, least: int, most: int, last: tuple[float, float] | None = None, reach: float | None = None, warmest: bool = False) -> dict | None:
    """The animal's blob: threshold, close, open, regions of a fit size, then the largest (near the last place) or the warmest.

    confidence is the blob's share of all foreground of a fit size.
    """
    score = np.abs(frame.astype(float) - background)
    mask = score > score.mean() + sigma * score.std()
    mask = dilate(erode(erode(dilate(mask))))
    fit = [p for p in components(mask) if least <= len(p) <= most]
    if last is not None and reach is not None:
        fit = [p for p in fit if np.hypot(p[:, 1].mean() - last[0], p[:, 0].mean() - last[1]) <= reach]
    if not fit:
        return None
    best = max(fit, key=(lambda p: frame[p[:, 0], p[:, 1]].mean()) if warmest else len)
    return {"pixels": best, "x": float(best[:, 1].mean()), "y": float(best[:, 0].mean()), "area": len(best), "confidence": len(best) / sum(map(len, fit))}


def local_fallback(frame: np.ndarray, last: tuple[float, float], window: int, percentile: float, least: int) -> dict | None:
    """The largest warm region in a window around the last place."""
    x0, y0 = max(0, round(last[0]) - window), max(0, round(last[1]) - window)
    part = frame[y0 : round(last[1]) + window + 1, x0 : round(last[0]) + window + 1]
    fit = [p for p in components(part >= np.percentile(part, percentile)) if len(p) >= least] if part.size else []
    if not fit:
        return None
    best = max(fit, key=len)
    return {"x": float(best[:, 1].mean() + x0), "y": float(best[:, 0].mean() + y0), "area": len(best), "confidence": 0.5}


def deepest(mask: np.ndarray, radius: float, pad: bool = False) -> tuple[int, int] | None:
    """The pixel (x, y) farthest from the mask's outside if that is at least ``radius``; ``pad``: the frame's border is outside."""
    m = np.pad(mask, 1) if pad else mask
    ys, xs = np.nonzero(m)
    oy, ox = np.nonzero(~m)
    if not len(ys) or not len(oy):
        return None
    far = np.full(len(ys), np.inf)
    for k in range(0, len(oy), 512):
        far = np.minimum(far, ((ys[:, None] - oy[k : k + 512]) ** 2 + (xs[:, None] - ox[k : k + 512]) ** 2).min(axis=1))
    k = int(np.argmax(far))
    return (int(xs[k]) - pad, int(ys[k]) - pad) if far[k] >= radius * radius else None


def disk(shape: tuple[int, int], cx: float, cy: float, r: float) -> np.ndarray:
    y, x = np.ogrid[: shape[0], : shape[1]]
    return (x - cx) ** 2 + (y - cy) ** 2 <= r * r


def floor_roi(arena: np.ndarray, blob: np.ndarray, cx: float, cy: float, r: float, farthest: int) -> tuple[str, int] | None:
    """The smallest shift up or down at which a disk lies in the arena and clear of the animal; up wins ties."""
    for d in range(1, farthest + 1):
        for name, sign in (("up", -1), ("down", 1)):
            y = cy + sign * d
            if not (r <= cx < arena.shape[1] - r and r <= y < arena.shape[0] - r):
                continue
            spot = disk(arena.shape, cx, y, r)
            if arena[spot].all() and not blob[spot].any():
                return name, d
    return None


def best_shift(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[int, int]:
    """The integer shift (dy, dx) of b with the smallest mean absolute difference; the first in reading order of ties."""
    best = (np.inf, 0, 0)
    h, w = a.shape
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            p = a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)].astype(float)
            q = b[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
            d = np.abs(p - q).mean()
            if d < best[0]:
                best = (d, dy, dx)
    return best[1], best[2]


def edge_refine(frame: np.ndarray, mask: np.ndarray, reach: int = 20) -> tuple[int, int, float]:
    """The shift (dx, dy) of a mask with the largest contrast between inside and a ring around it."""
    ring = dilate(mask) & ~mask
    best = (-1.0, 0, 0)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            inside, around = _moved(mask, dy, dx), _moved(ring, dy, dx)
            if inside.sum() < mask.sum() or not around.any():
                continue
            gain = abs(frame[inside].mean() - frame[around].mean())
            if gain > best[0]:
                best = (gain, dx, dy)
    return best[1], best[2], best[0]


def skeleton_path(points: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest shortest path through an 8-connected set of skeleton pixels, by two sweeps."""

    def sweep(start):
        before, todo, last = {start: None}, deque([start]), start
        while todo:
            last = todo.popleft()
            for n in sorted((last[0] + dy, last[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx):
                if n in points and n not in before:
                    before[n] = last
                    todo.append(n)
        return last, before

    if not points:
        return []
    end, _ = sweep(min(points))
    other, before = sweep(end)
    path = [other]
    while before[path[-1]] is not None:
        path.append(before[path[-1]])
    return path


def pruned(points: set[tuple[int, int]], least: int) -> set[tuple[int, int]]:
    """Skeleton pixels without side branches shorter than ``least``."""
    near = lambda p, s: [q for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (q := (p[0] + dy, p[1] + dx)) in s]
    for leaf in sorted(p for p in points if len(near(p, points)) == 1):
        branch = [leaf]
        while len(branch) < least:
            nxt = [q for q in near(branch[-1], points) if q not in branch]
            if len(nxt) != 1:
                break
            branch.append(nxt[0])
        if len(branch) < least and len(near(branch[-1], points)) > 2:
            points = points - set(branch[:-1] if len(branch) > 1 else branch)
    return points


def tail_base(path: list[tuple[int, int]], mask: np.ndarray, share: float = 0.5) -> int | None:
    """Where along a path the body's width first falls below a share of its median and stays there."""
    oy, ox = np.nonzero(~mask)
    if not path or not len(oy):
        return None
    width = np.array([np.sqrt(((oy - y) ** 2 + (ox - x) ** 2).min()) for y, x in path])
    thin = width < share * np.median(width)
    wide = np.flatnonzero(~thin)
    return int(wide[-1] + 1) if len(wide) and wide[-1] + 1 < len(path) else None


def track(frames, background: np.ndarray, every: int = 1, sigma: float = 3.0, least: int = 20, most: int = 5000, radius: float = 2.0, farthest: float = 80.0, start: int = 0):
    """Tracking rows of one video's (index, frame) pairs: frame, x, y, area, confidence, method, mean value and flag.

    Blobs are looked for near the last one, then anywhere, then by warmth around the last place; a blob
    farther than ``farthest`` from the last detected one is a jump.
    """
    last = None
    for k, frame in frames:
        if k % every:
            continue
        row = {"frame": int(k), "x": None, "y": None, "area": None, "confidence": 0.0, "method": "none", "value": None, "flag": "pre_entry" if k < start else "no_mouse"}
        found = None
        if k >= start:
            found = segment(frame, background, sigma, least, most, last, farthest) or segment(frame, background, sigma, least, most)
            row["method"] = "global" if found else "none"
            if not found and last:
                found = local_fallback(frame, last, 20, 95, least)
                row["method"] = "local_fallback" if found else "none"
        if found:
            jump = last is not None and np.hypot(found["x"] - last[0], found["y"] - last[1]) > farthest
            last = (found["x"], found["y"])
            spot = disk(frame.shape, *last, radius)
            row.update(x=last[0], y=last[1], area=found["area"], confidence=found["confidence"], value=float(frame[spot].mean()) if spot.any() else None, flag="jump" if jump else "ok")
        yield row
