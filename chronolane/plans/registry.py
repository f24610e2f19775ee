"""Where queries are registered, and how the stored tables play the roles of the domain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def seconds(ts: str = "ts"):
    """Seconds since the epoch of a timestamp without zone."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tracking rows: lane, frame, t, x, y, state and ok (errors are invalid rows)."""
    e = load(spark, sf_dir, "events")
    y = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("user_id").alias("lane"), F.col("event_id").alias("frame"), seconds().alias("t"), F.col("value").alias("x"), y.alias("y"), F.col("event_type").alias("state"), (F.col("event_type") != "error").alias("ok"))


#: Rows of a large table that a task joins at a time.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A stored table dealt by ``key`` into tasks of some TASK_ROWS rows, so that a task's sorts and hash maps don't grow with the table; one that the cores share out anyhow stays as it is."""
    tasks = df.count() // TASK_ROWS + 1
    return df.repartition(tasks, key) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


#: The same rows in SQL.
SAMPLES = "s AS (SELECT user_id AS lane, event_id AS frame, epoch_us(ts) / 1e6 AS t, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y, event_type AS state, event_type <> 'error' AS ok FROM events)"

LANE, ORDER = ["lane"], ["t", "frame"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the last bits of sums don't count."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
