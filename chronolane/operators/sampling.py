"""Deterministic sampling, top-k and selection."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.sources.scratch import scratch


def global_row_number(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``, the row's number from 1 in the order of the whole table; rows that tie are numbered in any order.

    Rows are dealt to ranges of the order and written, numbered within their range by a window, and the
    ranges before add their counts: one count a range is all that the driver sees, and no task has all rows.
    """
    spark = df.sparkSession
    path = scratch(spark, "ranges")
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(path)
    counts = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())
    before = dict(zip([k for k, _ in counts], accumulate([0, *(n for _, n in counts)])))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long")
    if not before:
        return ranged.withColumn(out, place).drop("_range")
    held = F.create_map(*[F.lit(v) for k, n in before.items() for v in (k, int(n))])
    return ranged.withColumn(out, place + F.element_at(held, F.col("_range"))).drop("_range")


def top_by(df: DataFrame, keys: list[str], score: Column, order: list[str]) -> DataFrame:
    """The row with the largest score per key; the first in order of ties."""
    w = Window.partitionBy(*keys).orderBy(score.desc(), *order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def pick_diverse(df: DataFrame, key: str, valid: str, order: list[str], n: int) -> DataFrame:
    """n rows: valid ones if there are enough, the first of each key before any second."""
    count = df.agg(F.count_if(valid).alias("_valid"))
    rows = df.crossJoin(F.broadcast(count)).filter((F.col("_valid") < n) | F.col(valid)).drop("_valid")  # one row
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = rows.withColumn("_again", (turn > 1).cast("int"))
    return rows.orderBy("_again", *order).limit(n).drop("_again")


def spread_positions(count: int, n: int) -> list[int]:
    """n positions evenly spread over count, halves rounding to even, without repeats."""
    if count <= n:
        return list(range(count))
    return sorted({round(k * (count - 1) / (n - 1)) if n > 1 else 0 for k in range(n)})


def pick_spread(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """n rows of each key, evenly spread by order."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    k = F.sequence(F.lit(0), F.lit(n - 1))
    at = F.transform(k, lambda j: F.bround(j * (F.col("_n") - 1) / F.lit(max(1, n - 1))).cast("long"))
    return rows.filter((F.col("_n") <= n) | F.array_contains(at, F.col("_i").cast("long"))).drop("_i", "_n")


def every_nth(df: DataFrame, position: str, n: int) -> DataFrame:
    return df.filter(F.pmod(F.col(position), F.lit(n)) == 0)


def fraction_positions(bouts: DataFrame, fractions: list[float], start: str = "bout_start_sec", end: str = "bout_end_sec") -> DataFrame:
    """A row per interval and fraction of it, with sample_t."""
    rows = bouts.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
    return rows.withColumn("sample_t", F.col(start) + F.col("fraction") * (F.col(end) - F.col(start)))


def sample_plan(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """Both plans in one, flagged."""
    return inside.withColumn("stationary", F.lit(True)).unionByName(outside.withColumn("stationary", F.lit(False)), allowMissingColumns=True)


def jittered_positions(count: int, n: int, jitter: int, seed: int) -> list[int]:
    """Evenly spaced positions moved by up to ``jitter``, clipped, without repeats; the same for a seed."""
    import numpy as np

    rng = np.random.default_rng(seed)
    at = np.linspace(0, count - 1, min(n, count)).astype(int)
    return sorted({int(x) for x in np.clip(at + rng.integers(-jitter, jitter + 1, len(at)), 0, count - 1)})


def random_rows(df: DataFrame, id: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, by a seeded hash of the id."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(id)), id).limit(n)


def stratified(df: DataFrame, session: str, zone: str, first: str, id: str, quota: int, fractions: dict[str, float], seed: int = 0) -> DataFrame:
    """``quota`` rows per session: a third for rows flagged ``first`` where there are any, the rest by zone, the shortfall from what is left.

    Rounding goes to the zone with the largest fraction.  Rows are ranked by a seeded hash, so the
    choice is the same for any partitioning.
    """
    lot = F.xxhash64(F.lit(seed), F.col(id))
    by = Window.partitionBy(session, first).orderBy(lot, id)
    rows = df.withColumn("_lot", lot).withColumn("_k", F.row_number().over(by))
    own = F.sum(F.when(F.col(first), 1).otherwise(0)).over(Window.partitionBy(session))
    rows = rows.withColumn("_first", F.least(own, F.lit(max(1, quota // 3))))
    rows = rows.withColumn("_take", F.col(first) & (F.col("_k") <= F.col("_first"))).withColumn("_left", F.lit(quota) - F.col("_first"))
    biggest = max(fractions, key=fractions.get)
    even = {z: F.bround(F.col("_left") * f) for z, f in fractions.items()}
    even[biggest] = even[biggest] + F.col("_left") - sum(even.values())
    goal = F.lit(0)
    for z, n in even.items():
        goal = F.when(F.col(zone) == z, n).otherwise(goal)
    z = F.row_number().over(Window.partitionBy(session, zone, "_take").orderBy("_lot", id))
    rows = rows.withColumn("_rank", F.when(F.col("_take"), 0).when(z <= goal, 1).otherwise(2))
    last = F.row_number().over(Window.partitionBy(session).orderBy("_rank", "_lot", id))
    return rows.withColumn("_place", last).filter(F.col("_place") <= quota).drop("_lot", "_k", "_first", "_take", "_left", "_rank", "_place")


def first_path(df: DataFrame, name: str, path: str) -> DataFrame:
    """Of files with one name, the first by path."""
    return top_by(df, [name], F.lit(0), [path])
