"""Column factories: parsing, classification, clocks, gates, calibration and geometry.

Each takes and returns ``Column``s, so Catalyst sees plain expressions that it can prune, push and compile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- normalisation and parsing -------------------------------------------------------------------


def normalize(c: Column) -> Column:
    """Trimmed text; NULL becomes empty."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def mapped(c: Column, table: dict[str, str]) -> Column:
    """A lower-case lookup whose misses pass through unchanged."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.trim(c))), c)


def to_number(c: Column) -> Column:
    """A double; what isn't a number, NaN included, becomes NULL."""
    d = c.cast("string").try_cast("double")
    return F.when(~F.isnan(d), d)


def truthy(c: Column) -> Column:
    """A boolean from booleans and their spellings."""
    return F.lower(c.cast("string")).isin("true", "1")


def stem_and_lane(name: Column) -> Column:
    """struct(stem, lane): an exact suffix first, else the first _Front or _Back anywhere, else the name without its extension."""
    at = F.regexp_instr(name, F.lit("(?i)_(front|back)"))
    side = F.lower(F.regexp_extract(name, "(?i)_(front|back)", 1))
    bare = F.regexp_replace(name, r"\.[^.]*$", "")
    stem = F.when(name.endswith("_Front.seq"), F.regexp_replace(name, "_Front[.]seq$", "")).when(name.endswith("_Back.seq"), F.regexp_replace(name, "_Back[.]seq$", "")).when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise(bare)
    lane = F.when(name.endswith("_Front.seq"), "F").when(name.endswith("_Back.seq"), "B").when(side == "front", "F").when(side == "back", "B").otherwise("")
    return F.struct(stem.alias("stem"), lane.alias("lane"))


def lane_tokens(stem: Column, strict: bool = True) -> Column:
    """map(lane -> four-digit id); of repeated lanes the last counts.  Strict tokens end at a word boundary, others at "_" too."""
    end = r"\b" if strict else "(?=_|$)"
    found = F.regexp_extract_all(stem, F.lit(rf"(\d{{4}}_[BF]){end}"), F.lit(1))
    entries = F.array(*[F.struct(F.lit(lane).alias("k"), F.substring(F.try_element_at(F.filter(found, lambda x: x.endswith(lane)), F.lit(-1)), 1, 4).alias("v")) for lane in "BF"])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def lane_id(stem: Column, lane: str) -> Column:
    """The id of a lane; an error when it isn't there exactly once."""
    found = F.regexp_extract_all(stem, F.lit(rf"(\d{{4}})_{lane}(?=_|$)"), F.lit(1))
    return F.when(F.size(found) == 1, F.get(found, 0)).otherwise(F.raise_error(F.concat(F.lit(f"no single {lane} id in "), stem)))


def leading_date(name: Column) -> Column:
    """The MM-DD-YY at the start as a date, NULL if there is none."""
    return F.to_date(F.nullif(F.regexp_extract(name, r"^(\d{2}-\d{2}-\d{2})", 1), F.lit("")), "MM-dd-yy")


def full_name(stem: Column) -> Column:
    """Date, two ids with sexes, experiment and track of a complete name; otherwise only the track, its last part."""
    pattern = r"^(\d{2}-\d{2}-\d{2})_(\d+)_([A-Z])_(\d+)_([A-Z])_([\w-]+)_(\w+)"
    parts = ["date", "animal1_id", "animal1_sex", "animal2_id", "animal2_sex", "experiment"]
    hit = stem.rlike(pattern)
    track = F.when(hit, F.regexp_extract(stem, pattern, 7)).otherwise(F.element_at(F.split(stem, "_"), -1))
    return F.struct(*[F.when(hit, F.regexp_extract(stem, pattern, k + 1)).alias(p) for k, p in enumerate(parts)], track.alias("track"))


def unit_and_trial(stem: Column) -> Column:
    """struct(unit, trial): a tracking suffix goes, the side picks the id, the name stands in for a missing one."""
    bare = F.regexp_replace(stem, "(_tracked_edge20|_tracked_antidrift|_tracked)$", "")
    side = F.upper(F.substring(F.regexp_extract(bare, "(?i)_(front|back)$", 1), 1, 1))
    own = F.when(side == "F", F.regexp_extract(bare, r"(\d{4}_F)", 1)).when(side == "B", F.regexp_extract(bare, r"(\d{4}_B)", 1)).otherwise("")
    any_ = F.regexp_extract(bare, r"(\d{4}_[FB])", 1)
    unit = F.when(own != "", own).when(any_ != "", any_).otherwise(bare)
    return F.struct(unit.alias("unit"), F.regexp_replace(bare, "(?i)_(front|back)$", "").alias("trial"))


def reroot(path: Column, marker: str, root: str) -> Column:
    """What follows the last marker, below another root."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.ltrim(F.substring_index(path, marker, -1), F.lit("/")))


def strip_suffix(name: Column, suffixes: Iterable[str]) -> Column:
    """The name without its suffix; an error if it has none of them."""
    pattern = "(" + "|".join(s.replace(".", "[.]") for s in suffixes) + ")$"
    return F.when(name.rlike(pattern), F.regexp_replace(name, pattern, "")).otherwise(F.raise_error(F.concat(F.lit("no known suffix: "), name)))


# --- classification ------------------------------------------------------------------------------


def cases(*pairs: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The first label whose condition holds."""
    out = None
    for c, label in pairs:
        out = F.when(c, label) if out is None else out.when(c, label)
    return out.otherwise(otherwise)


def condition(surgery: Column, injection: Column, nest: Column) -> Column:
    kind = F.when(nest == "Y", "nestlet").otherwise("no_nestlet")
    return F.when(surgery == "Pre-craniotomy", "pre_cranio").when(injection == "Saline", "post_saline").otherwise(F.concat(F.lit("post_"), F.lower(injection), F.lit("_"), kind))


def regime(override: Column, date: Column, cutoff: str) -> Column:
    """struct(flip, confidence): an override's word, else by date."""
    flip = F.coalesce(override, F.when(date < F.lit(cutoff).cast("date"), "vertical").otherwise("horizontal+vertical"))
    return F.struct(flip.alias("flip"), F.when(override.isNull(), "date-inferred").otherwise("verified").alias("confidence"))


def side(fraction: Column, tolerance: float = 0.15) -> Column:
    return F.when(F.abs(fraction - 0.5) < tolerance, "center").when(fraction < 0.5, "low").otherwise("high")


def flip_label(ax: Column, ay: Column, bx: Column, by: Column, tolerance: float = 0.15) -> Column:
    """How one view is flipped against another, from where both see the same thing (fractions of the frame)."""
    axes = [(side(a, tolerance), side(b, tolerance), n) for a, b, n in ((ax, bx, "horizontal"), (ay, by, "vertical"))]
    unclear = [(a == "center") | (b == "center") for a, b, _ in axes]
    flipped = F.filter(F.array(*[F.when(~u & (a != b), n) for (a, b, n), u in zip(axes, unclear, strict=True)]), lambda x: x.isNotNull())
    guess = F.concat(F.lit("AMBIGUOUS ("), F.array_join(F.concat(flipped, F.array(F.lit("?"))), ","), F.lit(")"))
    return F.when(unclear[0] | unclear[1], guess).when(F.size(flipped) == 0, "none").otherwise(F.array_join(flipped, "+"))


def zone(value: Column, cool: float = 21.0, hot: float = 33.0) -> Column:
    """cool and hot include their bounds; NULL stays NULL."""
    return F.when(value.isNull() | F.isnan(value), None).when(value <= cool, "cool").when(value >= hot, "hot").otherwise("mid")


def stationary(ok: Column, dispersion: Column, threshold: float, speed: Column | None = None, fastest: float | None = None) -> Column:
    """Valid, steady and, where a speed is known, slow."""
    calm = F.coalesce(dispersion < threshold, F.lit(False)) & ok
    return calm if speed is None or fastest is None else calm & F.coalesce(speed < fastest, F.lit(True))


def frame_state(ok: Column, dispersion: Column, still: Column) -> Column:
    """stationary, moving, or unknown for rows that can't be judged."""
    return F.when(still, "stationary").when(~ok | dispersion.isNull(), "unknown").otherwise("moving")


def threshold(value: float | None, default: float = 5.0) -> float:
    return default if value is None else value


# --- clocks and bins -----------------------------------------------------------------------------


def to_other_clock(t: Column, offset: Column | float, slope: Column | float) -> Column:
    return t + offset + slope * t


def from_other_clock(t: Column, offset: Column, slope: Column) -> Column:
    """The inverse of to_other_clock(); the time itself where that has none."""
    return F.when(1 + slope == 0, t).otherwise((t - offset) / F.nullif(1 + slope, F.lit(0.0)))


def start_frame(t: Column, rate: float) -> Column:
    return F.greatest(F.lit(0), F.ceil(t * rate)).cast("long")


def floor_bin(t: Column, width: float, centre: bool = False) -> Column:
    return F.floor(t / width) * width + (width / 2 if centre else 0.0)


def minute_bin(t: Column, minutes: float) -> Column:
    """The middle, in minutes, of a bin of ``minutes``."""
    return (F.floor(t / 60 / minutes) + 0.5) * minutes


def end_bin(t: Column, width: float) -> Column:
    """The end of the bin; time 0 is in the first."""
    return F.greatest(F.ceil(t / width), F.lit(1)) * width


def confidence_alpha(t: Column, anchor: Column, decay: float, least: float) -> Column:
    """Fades from 1 at the anchor to ``least``; 0.5 without an anchor."""
    return F.when(anchor.isNull(), 0.5).otherwise(least + (1 - least) * F.exp(-F.abs(t - anchor) / decay))


# --- gates and reasons ---------------------------------------------------------------------------


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts of the conditions that hold, in order."""
    every = [F.when(F.coalesce(c, F.lit(False)), F.lit(x) if isinstance(x, str) else x) for c, x in pairs]
    return F.filter(F.array(*every), lambda x: x.isNotNull())


def gate(delta: Column, confidence: Column, sync: Column, homography: Column, posture: Column | None = None, least_delta: float = 0.3, least_confidence: float = 0.5) -> Column:
    """Why a measurement doesn't count; an empty array if it does.  An unknown posture is no reason."""
    return reasons(
        (delta.isNull(), "no delta_t (upstream measurement invalid)"),
        (F.abs(delta) < least_delta, F.format_string(f"|delta_t|=%.2f below threshold {least_delta}", F.abs(delta))),
        (confidence < least_confidence, F.format_string("landmark_confidence=%.2f below threshold", confidence)),
        (~F.coalesce(sync, F.lit(False)), "sync QC failed"),
        (~F.coalesce(homography, F.lit(False)), "homography QC failed"),
        *([] if posture is None else [(~posture, "posture is curled/rearing")]),
    )


def sync_flags(ratio: Column, loss: Column, slope: Column, other_loss: Column) -> Column:
    """Quality flags of a clock estimate joined by ";"; an unknown ratio counts as flat."""
    flat = ~F.coalesce(ratio <= 0.3, F.lit(False)) | F.isnan(ratio)
    return F.array_join(reasons((flat, "flat_minimum"), (loss > 0.25, "poor_fit"), (F.abs(slope) > 0.002, "timing_anomaly"), (other_loss < 2 * loss, "fps_ambiguous")), ";")


def accepted(residual: Column, most: float, r2: Column, least_r2: float, slope: Column, flat: float) -> Column:
    """A small residual, and either a good fit or hardly any drift; unknown values fail."""
    known = lambda c: F.when(F.isnan(c), None).otherwise(c)
    fits = F.coalesce(known(r2) > least_r2, F.lit(False)) | F.coalesce(F.abs(known(slope)) < flat, F.lit(False))
    return F.coalesce(known(residual) < most, F.lit(False)) & fits


def blanked(columns: list[str], before: Column) -> dict[str, Column]:
    """Measurements as NULL for rows before the start."""
    return {c: F.when(~before, F.col(c)) for c in columns}


# --- calibration and geometry --------------------------------------------------------------------


def planck_celsius(raw: Column, r1: Column, r2: Column, b: Column, f: Column, o: Column) -> Column:
    """Temperature of a raw sensor value; without constants the linear rule of 0.04 K per count."""
    exact = b / F.ln(r1 / (r2 * (raw + o)) + f) - 273.15
    return F.when(r1.isNull(), raw * 0.04 - 273.15).otherwise(exact)


def quadratic_celsius(raw: Column, a: float, b: float, c: float) -> Column:
    return a * raw * raw + b * raw + c


def stretch(pixels: Column) -> Column:
    """Pixels stretched to 0..255; a constant frame is all 0."""
    lo, hi = F.array_min(pixels), F.array_max(pixels)
    return F.transform(pixels, lambda p: F.when(hi > lo, F.floor((p - lo) * 255.0 / (hi - lo))).otherwise(0).cast("int"))


def homography(h: list[Column], x: Column, y: Column) -> Column:
    """struct(x, y) of a point under a projective map given as nine columns, by rows."""
    w = h[6] * x + h[7] * y + h[8]
    return F.struct(((h[0] * x + h[1] * y + h[2]) / w).alias("x"), ((h[3] * x + h[4] * y + h[5]) / w).alias("y"))


def translated(h: list[Column], dx: Column, dy: Column) -> list[Column]:
    """The map followed by a shift."""
    return [*(h[k] + dx * h[6 + k] for k in range(3)), *(h[3 + k] + dy * h[6 + k] for k in range(3)), *h[6:]]


def deviation(a: list[Column], b: list[Column], probes: list[tuple[float, float]]) -> Column:
    """The farthest that two maps put a probe point apart."""
    far = []
    for x, y in probes:
        p, q = homography(a, F.lit(x), F.lit(y)), homography(b, F.lit(x), F.lit(y))
        far.append(F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
    return far[0] if len(far) == 1 else F.greatest(*far)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Euclidean distance; NULL if any coordinate is."""
    return F.hypot(ax - bx, ay - by)


def in_any(t: Column, intervals: Column, start: str = "s", end: str = "e") -> Column:
    """Whether any interval of an array of structs holds t."""
    return F.exists(intervals, lambda i: t.between(i[start], i[end]))


def corrected(point: Column, fix: Callable[[Column], Column] | None = None) -> Column:
    """A point after a correction; the point itself without one."""
    return point if fix is None else fix(point)


# --- filters -------------------------------------------------------------------------------------


def valid_row(flag: str = "qc_flag", roi: str = "mouse_roi_valid") -> Column:
    return (F.col(flag) == "ok") & F.coalesce(truthy(F.col(roi)), F.lit(False))


def applicable(df: DataFrame, outcome: str, needs_qc: bool) -> DataFrame:
    """Rows that an outcome is defined for; some also need the quality flag, under whichever name it has."""
    rows = df.filter(F.col(outcome).isNotNull())
    if needs_qc:
        rows = rows.filter(F.col("qc_valid") if "qc_valid" in df.columns else F.col("qc_flag") == "ok")
    return rows


def split_excluded(df: DataFrame, *rules: tuple[Column, str]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with a reason), by the first rule that applies."""
    marked = df.withColumn("reason", cases(*rules))
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def tiers(df: DataFrame, name: str, **conditions: Column) -> DataFrame:
    """Rows repeated for every named subset that they belong to, in one pass."""
    member = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]), lambda x: x.isNotNull())
    return df.withColumn(name, F.explode(member))


def scope_or_all(df: DataFrame, scope: Column, least: int) -> DataFrame:
    """The rows in scope, or all rows if fewer than ``least`` are in it."""
    n = df.agg(F.count_if(scope).alias("_in"))
    return df.crossJoin(F.broadcast(n)).filter(scope | (F.col("_in") < least)).drop("_in")  # one row
