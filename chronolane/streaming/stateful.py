"""Streaming forms of the operators that are stateful by nature; each equals its batch form.

Rows of a lane wait in a list until the watermark has passed them, so rows that come late (within the delay)
or in any order are taken in order of time, whatever the micro-batches are.  Event-time timers wake a lane: for the
first row that waits, for the moment after which nothing can join an open interval, and for the end of its
memory.  When a bounded run is over, finish() reads what is still open from the query's checkpoint.

What waits is stored by column, one element a lane and micro-batch, and a lane is woken by no timer that it
doesn't need: a call of the state store costs more than a row does.

The queries need RocksDB as state store; start() asks for it where the session doesn't say otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from chronolane.operators.greedy import GateRule, gate_reading

FOREVER = 1e11  # seconds; timers are milliseconds in 64 bits
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class GateMachine:
    """The temperature gate: id and reference (NULL if it passed) of each reading."""

    rule: GateRule
    state: str = "memory array<double>, short long"
    row: str = "core double, body double"
    out: str = "id long, reference double"

    def fresh(self) -> tuple:
        return [], 0

    def step(self, state: tuple, t: float, id: int, core: float, body: float | None) -> tuple[tuple, list[tuple]]:
        reference, memory, short = gate_reading(self.rule, list(state[0]), state[1], core, None if pd.isna(body) else body)
        return (memory, short), [(id, reference)]

    def deadline(self, state: tuple) -> float | None:
        return None

    def close(self, state: tuple) -> tuple[tuple, list[tuple]]:
        return state, []


@dataclass(frozen=True)
class EntryMachine:
    """The entry: its row's position in the lane, once when it is complete."""

    sustained: int
    intrusion: int
    inside: str = "mouse"
    handling: str = "intrusion"
    state: str = "at long, run long, streak long, seen boolean, done boolean"
    row: str = "seen_as string"
    out: str = "entry long"

    def fresh(self) -> tuple:
        return 0, 0, 0, False, False

    def step(self, state: tuple, t: float, id: int, seen_as: str) -> tuple[tuple, list[tuple]]:
        at, run, streak, seen, done = state
        run = run + 1 if seen_as == self.handling else 0
        seen = seen or run >= self.intrusion
        streak = streak + 1 if seen_as == self.inside and seen else 0
        found = [(at - self.sustained + 1,)] if streak >= self.sustained and not done else []
        return (at + 1, run, streak, seen, done or bool(found)), found

    def deadline(self, state: tuple) -> float | None:
        return None

    def close(self, state: tuple) -> tuple[tuple, list[tuple]]:
        return state, []


@dataclass(frozen=True)
class BoutMachine:
    """Closed intervals of stationary rows, as soon as nothing can join them."""

    least: float
    gap: float
    unknown_gap: float
    #: Whether silence alone ends an interval whose last row was stationary; islands() lets the next row go on with it after any time.
    silence: bool = True
    state: str = "start double, end double, moved boolean, apart boolean"
    row: str = "state string"
    out: str = "start double, end double"

    def fresh(self) -> tuple:
        return None, None, False, False

    def step(self, state: tuple, t: float, id: int, seen_as: str) -> tuple[tuple, list[tuple]]:
        start, end, moved, apart = state
        out = []
        wide = max(self.gap, self.unknown_gap)
        if start is not None and (t - end > wide if seen_as != "stationary" else apart and t - end > (self.gap if moved else wide)):
            (start, end, moved, apart), out = self.close(state)
        if seen_as == "stationary":
            return (t if start is None else start, t, False, False), out
        return (start, end, moved or seen_as == "moving", True), out

    def deadline(self, state: tuple) -> float | None:
        return None if state[0] is None or not (self.silence or state[3]) else state[1] + max(self.gap, self.unknown_gap)

    def close(self, state: tuple) -> tuple[tuple, list[tuple]]:
        start, end = state[:2]
        return self.fresh(), [(start, end)] if start is not None and end - start >= self.least else []


def waiting_schema(machine) -> str:
    """A lane's rows of one micro-batch as an array a column: an element of state for many rows, not for each."""
    return "t array<double>, id array<long>, " + ", ".join(f"{n} array<{k}>" for n, k in (c.split() for c in machine.row.split(", ")))


class InOrder(StatefulProcessor):
    """Takes each lane's rows in order of time and gives them to a machine."""

    def __init__(self, machine, keep: float):
        self.machine, self.keep = machine, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", waiting_schema(self.machine))
        self.memory = handle.getValueState("memory", f"last double, {self.machine.state}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        _, _, *columns = map(list, zip(*rows, strict=True))  # without the lane and the timestamp
        self.waiting.appendValue(tuple(columns))
        first = min(columns[0])
        self.handle.registerTimer(math.ceil(first * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((r for held in self.waiting.get() for r in zip(*held, strict=True)), key=lambda r: r[:2])
        passed = sum(r[0] * 1000 <= now for r in rows)
        held = self.memory.get()
        if not passed and held is None:  # a timer of a memory that is gone
            return
        held = held or (-math.inf, *self.machine.fresh())
        last, state, out = held[0], tuple(held[1:]), []
        for r in rows[:passed]:
            state, found = self.machine.step(state, *r)
            out += found
            last = r[0]
        until = self.machine.deadline(state)
        if until is not None and now > until * 1000:
            state, found = self.machine.close(state)
            out, until = out + found, None
        if rows[passed:]:
            self.waiting.put([tuple(map(list, zip(*rows[passed:], strict=True)))])
            self.handle.registerTimer(math.ceil(rows[passed][0] * 1000))
        elif rows:
            self.waiting.clear()
        if until is not None:
            self.handle.registerTimer(math.floor(until * 1000) + 1)
        end = math.floor((last + self.keep) * 1000) + 1
        if now >= end and not rows[passed:] and until is None:
            self.memory.clear()
        else:
            self.memory.update((last, *state))
            if now < end and self.keep < FOREVER:
                self.handle.registerTimer(end)
        found = Row("lane", *[c.split()[0] for c in self.machine.out.split(", ")])
        yield from (found(key[0], *r) for r in out)

    def close(self) -> None:
        pass


def run(stream: DataFrame, lane: str, t: str, id: str, columns: list[str], machine, late: str = "1 hour", keep: float = math.inf) -> DataFrame:
    """What a machine finds in a stream of rows with a time in seconds: lane and the machine's columns.

    Rows later than ``late`` behind the newest are dropped, as they are by any watermark.  A lane that is
    silent for ``keep`` seconds of event time is forgotten; if it goes on, it begins anew.
    """
    names = [c.split()[0] for c in machine.row.split(", ")]
    ts = F.timestamp_micros(F.round(F.col(t) * 1e6).cast("long"))
    rows = stream.select(F.col(lane).cast("long").alias("lane"), ts.alias("ts"), F.col(t).alias("t"), F.col(id).cast("long").alias("id"), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    keep = min(keep, FOREVER)
    return rows.withWatermark("ts", late).groupBy("lane").transformWithState(InOrder(machine, keep), f"lane long, {machine.out}", "append", "EventTime")


def gate(stream: DataFrame, lane: str, t: str, id: str, core: str, body: str, rule: GateRule, **options) -> DataFrame:
    """The temperature gate per lane: id and reference (NULL if it passed); rows without a core are left out."""
    return run(stream.filter(F.col(core).isNotNull()), lane, t, id, [core, body], GateMachine(rule), **options)


def entries(stream: DataFrame, lane: str, t: str, id: str, state_column: str, sustained: int, intrusion: int, **options) -> DataFrame:
    """One row per lane when its entry is complete: lane and entry (row position)."""
    return run(stream, lane, t, id, [state_column], EntryMachine(sustained, intrusion), **options)


def bouts(stream: DataFrame, lane: str, t: str, id: str, state_column: str, least: float, gap: float, unknown_gap: float, silence: bool = True, **options) -> DataFrame:
    """Closed intervals (lane, start, end): when a later run doesn't merge, or when the watermark is the larger tolerance past the end (not ``silence``: and a row of another state came after it)."""
    return run(stream, lane, t, id, [state_column], BoutMachine(least, gap, unknown_gap, silence), **options)


def finish(spark: SparkSession, checkpoint: str, machine) -> DataFrame:
    """What a run that is over would have found next: the rows that still wait are taken and what is open is closed.

    Reads the state of the run's checkpoint and changes nothing there.
    """
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    memory = read("memory").select(F.col("key.lane").alias("lane"), F.col("value").alias("held"))
    columns = [f"list_element.{c.split()[0]}" for c in waiting_schema(machine).split(", ")]
    waiting = read("waiting").select(F.col("key.lane").alias("lane"), F.arrays_zip(*columns).alias("rows"))
    waiting = waiting.groupBy("lane").agg(F.sort_array(F.flatten(F.collect_list("rows"))).alias("rows"))
    names = ["lane", *[c.split()[0] for c in machine.out.split(", ")]]

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lane, held, rows in zip(pdf["lane"], pdf["held"], pdf["rows"], strict=True):
                state = machine.fresh() if held is None else tuple(held.values())[1:]
                for r in [] if rows is None else rows:
                    state, found = machine.step(state, *r.values())
                    out += [(lane, *f) for f in found]
                out += [(lane, *f) for f in machine.close(state)[1]]
            yield pd.DataFrame(out, columns=names)

    both = memory.join(waiting, "lane", "full").select("lane", "held", "rows")
    return both.mapInPandas(end, f"lane long, {machine.out}")


def activity(stream: DataFrame, ts: str, value: str, keys: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums in tumbling windows; in append mode when the watermark passes a window's end, in update mode whenever they change."""
    timed = stream.withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def start(made: DataFrame, out: str, checkpoint: str):
    """Runs a query over all that is there and appends what it finds to Parquet."""
    spark = made.sparkSession
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return made.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def latest(made: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Runs an updating query over all that is there; the last state of each key, from what each micro-batch wrote."""
    spark = made.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    made.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(made.schema.simpleString()[7:-1].replace(":", " ") + ", _batch int").option("recursiveFileLookup", True).parquet(out)
    values = [c for c in made.columns if c not in keys]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*").select(*made.columns)
