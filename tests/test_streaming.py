"""Streaming operators give what their batch forms give, whatever the micro-batches are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolane.operators import greedy as G
from chronolane.operators import windows as W
from chronolane.streaming import stateful

SCHEMA = "lane long, id long, t double, v double, s string, e string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    return [(int(k % 3), int(k), 1000.0 + k, float(rng.normal(30, 6)), str(rng.choice(["stationary", "stationary", "stationary", "unknown", "moving"])), str(rng.choice(["mouse", "mouse", "intrusion", "empty"]))) for k in range(240)]


def late(rows, by=12):
    """The rows as they might come: each up to ``by`` seconds behind its turn."""
    rng = np.random.default_rng(5)
    return [r for _, r in sorted((r[2] + rng.uniform(0, by), r) for r in rows)]


def written(spark, path, rows, parts, start=0):
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{start + k:03}")


def fed(spark, tmp_path, rows, parts, build):
    """What a query finds that is stopped and started again for each part of the rows."""
    source = str(tmp_path / "source")
    for k in range(parts):  # a folder a run: each run goes on from the checkpoint of the one before
        written(spark, source, rows[k * -(-len(rows) // parts) : (k + 1) * -(-len(rows) // parts)], 1, k)
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(source)
        stateful.start(build(stream), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


RULE = G.GateRule(2.0, 9, 5, 4)
CASES = {
    "gate": (stateful.GateMachine(RULE), ["v", "body"], lambda df: G.temperature_gate(df, {"lane": "long"}, "id", "v", "body", ["t", "id"], RULE)),
    "entries": (stateful.EntryMachine(2, 2), ["e"], lambda df: W.entry_index(df, "e", ["lane"], ["t", "id"], 2, 2).filter("entry IS NOT NULL").select("lane", "entry")),
    "bouts": (stateful.BoutMachine(9.0, 4.0, 7.0), ["s"], lambda df: W.islands(df, "t", "s", ["lane"], ["t", "id"], 9.0, 4.0, 7.0).select("lane", "bout_start_sec", "bout_end_sec")),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("parts", [1, 5])
def test_stream_equals_batch_with_late_rows_and_restarts(spark, tmp_path, rows, name, parts):
    machine, columns, batch = CASES[name]
    body = lambda df: df.withColumn("body", F.when(F.col("id") % 7 != 0, F.col("v") - 1))  # noqa: E731  some readings have no body
    early = fed(spark, tmp_path, late(rows), parts, lambda s: stateful.run(body(s), "lane", "t", "id", columns, machine, late="15 seconds"))
    key = lambda found: sorted(tuple(-1.0 if v is None or v != v else float(v) for v in r) for r in found.collect())
    rest = stateful.finish(spark, str(tmp_path / "log"), machine)
    assert key(early.unionByName(rest)) == key(batch(body(spark.createDataFrame(rows, SCHEMA))))
    assert early.count() > 0  # what the watermark has passed doesn't wait for the end


def test_a_timer_closes_a_bout_and_forgets_a_lane(spark, tmp_path):
    still = lambda lane, a, b: [(lane, k, 1000.0 + k, 0.0, "stationary", "empty") for k in range(a, b)]
    machine = stateful.BoutMachine(9.0, 4.0, 7.0)
    build = lambda s: stateful.run(s, "lane", "t", "id", ["s"], machine, late="1 second", keep=50.0)
    source, out, log = str(tmp_path / "source"), str(tmp_path / "out"), str(tmp_path / "log")
    for k, some in enumerate((still(1, 0, 20), still(2, 22, 30), still(2, 30, 90), still(1, 95, 120))):
        written(spark, source, some, 1, k)
        stateful.start(build(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(source)), out, log).awaitTermination()
        got = sorted(tuple(r) for r in spark.read.schema("lane long, start double, end double").parquet(out).collect())
        # lane 1 has no row of its own that closes it: the watermark moves on with lane 2
        assert got == [[], [(1, 1000.0, 1019.0)], [(1, 1000.0, 1019.0)], [(1, 1000.0, 1019.0), (2, 1022.0, 1089.0)]][k]
        if k == 2:
            left = spark.read.format("statestore").option("stateVarName", "memory").load(log).select("key.lane").collect()
            assert [r.lane for r in left] == [2]  # lane 1 was silent for longer than it is remembered
    assert sorted(tuple(r) for r in stateful.finish(spark, log, machine).collect()) == [(1, 1095.0, 1119.0)]


def test_activity(spark, tmp_path):
    rows = [(k % 2, k, float(k), 1.0, "", "") for k in range(0, 7200, 60)]
    source = str(tmp_path / "source")
    written(spark, source, rows, 3)
    build = lambda: stateful.activity(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(source).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))), "ts", "v", ["lane"], "1 hour", "10 minutes")
    got = stateful.latest(build(), ["start", "lane"], str(tmp_path / "out"), str(tmp_path / "log")).collect()
    assert sorted((r.n, r.total) for r in got) == [(60, 60.0), (60, 60.0)]


def test_a_run_that_goes_on_after_a_long_silence_is_one_bout(spark, tmp_path):
    """lane 1's last row is within the delay, long after the one before it, and both are of one run; lane 2 moves the watermark."""
    still = [(1, k, 1000.0 + k, 0.0, "stationary", "empty") for k in range(20)]
    rows = [*still, (1, 100, 1099.5, 0.0, "stationary", "empty"), *[(2, 200 + k, 1000.0 + k, 0.0, "moving", "empty") for k in range(101)]]
    machine = stateful.BoutMachine(9.0, 4.0, 7.0, silence=False)
    early = fed(spark, tmp_path, rows, 1, lambda s: stateful.run(s, "lane", "t", "id", ["s"], machine, late="1 second"))
    got = early.unionByName(stateful.finish(spark, str(tmp_path / "log"), machine))
    want = W.islands(spark.createDataFrame(rows, SCHEMA), "t", "s", ["lane"], ["t", "id"], 9.0, 4.0, 7.0).select("lane", "bout_start_sec", "bout_end_sec")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()] == [(1, 1000.0, 1099.5)]


def test_what_waits_is_one_element_of_state_a_lane(spark, tmp_path, rows):
    """the rows of a micro-batch are not an element each."""
    machine = stateful.EntryMachine(2, 2)
    fed(spark, tmp_path, rows, 1, lambda s: stateful.run(s, "lane", "t", "id", ["e"], machine, late="1 hour"))
    held = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "log"))
    assert held.count() == 3
    assert held.selectExpr("sum(size(list_element.id))").first()[0] == len(rows)
