"""Fill-in-the-middle: a text is cut at two of its code points and its parts are put in another order.

Method: a parallel automaton scan.  A byte automaton counts code points and looks for the control
strings; chunks of a text give their transition functions and counts for every state they may be entered
in, composition gives each chunk's entry state and the units before it, and a selection goes down the one
chunk that holds a cut.

A text of one chunk is scanned, composed and cut in the task that reads it, and never moves.  Chunks of
giant texts are dealt out over all tasks, their functions (some dozen numbers each) meet by document, and
the chunks that hold a cut are dealt out again; only then are the cuts joined to the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.llm.automaton import Automaton, matcher, running, utf8_units, value_of
from chronolane.llm.base import Workspace, fresh, or_empty

CHUNK_BYTES = 1 << 16
RESULT = ["n", "form", "prefix_chars", "middle_chars", "output"]


@lru_cache(maxsize=8)
def _automaton(*marks: str) -> Automaton:
    return Automaton.make(utf8_units(), matcher([m.encode() for m in marks]))


@dataclass(frozen=True)
class Rule:
    """Control strings, the shares (percent) of texts that are cut and of those that begin with the suffix, and the seed."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut: int = 90
    spm: int = 20
    seed: int = 1

    def __post_init__(self):
        marks = self.marks()
        overlap = any(a.endswith(b[:k]) for a, b in product(marks, marks) for k in range(1, len(b)))
        if not all(marks) or overlap or any(a in b for k, a in enumerate(marks) for b in marks[:k] + marks[k + 1 :]):
            raise ValueError("control strings must not be empty, equal or overlap, or texts could not be restored")

    def marks(self) -> list[str]:
        return [self.prefix, self.suffix, self.middle]

    def automaton(self) -> Automaton:
        return _automaton(*self.marks())

    def form(self, n: int, marks: int, h3: int, h4: int) -> str:
        return "plain" if not n or marks or h3 % 100 >= self.cut else "spm" if h4 % 100 < self.spm else "psm"

    def numbers(self, id: str) -> list[Column]:
        """The four numbers of a document that decide its cuts and its form."""
        digest = F.sha2(F.concat(F.lit(f"{self.seed}:"), or_empty(F.col(id).cast("string"))), 256)
        return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _cuts(n: int, h1: int, h2: int) -> tuple[int, int]:
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b)


_FOUND = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]


def _whole(small: DataFrame, text: str, numbers: list[str], rule: Rule) -> DataFrame:
    """Texts of one chunk with n, form, prefix_chars, middle_chars and the bytes lo and hi of the cuts."""
    kept = T.StructType([f for f in small.schema if f.name not in numbers])
    names = fresh(small, *[f.name for f in _FOUND])
    schema = T.StructType([*kept, *(T.StructField(name, f.dataType) for name, f in zip(names, _FOUND, strict=True))])
    types = [pa.int64(), pa.string(), *[pa.int64()] * 4]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = rule.automaton().scan
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
            hs = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in numbers), strict=True)
            out = []
            for raw, (h1, h2, h3, h4) in zip(texts, hs, strict=True):
                found = scan(raw.as_buffer() or b"")
                _, n, marks = value_of(int(found.function()[0]))
                form = rule.form(n, marks, h3, h4)
                if form == "plain":
                    out.append((n, form, None, None, None, None))
                    continue
                a, b = _cuts(n, h1, h2)
                out.append((n, form, a, b - a, *(found.select(0, c) if c else 0 for c in (a, b))))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), *columns], schema.names)

    return small.mapInArrow(cut, schema)


def _giant(giants: DataFrame, text: str, numbers: list[str], rule: Rule, size: int, key: str) -> DataFrame:
    """What _whole() gives, for texts of many chunks."""
    numbered = giants.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("raw"), *[F.col(c).alias(f"h{k}") for k, c in enumerate(numbers)])
    piece = F.substring("raw", F.col("no") * size + 1, F.lit(size))
    last = ((F.octet_length("raw") - 1) / size).cast("int")
    chunks = numbered.withColumn("no", F.explode(F.sequence(F.lit(0), last))).select("key", "no", piece.alias("chunk")).repartition("key", "no")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [rule.automaton().scan(c.as_buffer()).function().tolist() for c in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.int64()))], ["key", "no", "value"])

    def resolve(key: tuple, table: pa.Table) -> pa.Table:
        """One document's functions in order: what becomes of it, and where its cuts are looked for."""
        table = table.sort_by("no")
        states, before, marks = running([np.array(v) for v in table["value"].to_pylist()])
        h1, h2, h3, h4 = (table[f"h{k}"][0].as_py() for k in range(4))
        n = before[-1]
        form = rule.form(n, marks, h3, h4)
        if form == "plain":
            return pa.Table.from_pylist([{"key": key[0].as_py(), "n": n, "form": form}], resolved)
        a, b = _cuts(n, h1, h2)
        base = {"key": key[0].as_py(), "n": n, "form": form, "prefix_chars": a, "middle_chars": b - a}
        rows = []
        for side, c in enumerate((a, b)):
            no = max(0, int(np.searchsorted(before, c, "left")) - 1)  # units before no < c <= units after it
            rows.append(base | {"side": side, "no": no, "state": states[no], "unit": c - before[no]})
        return pa.Table.from_pylist(rows, resolved)

    fields = [("key", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("side", pa.int32()), ("no", pa.int32()), ("state", pa.int32()), ("unit", pa.int64())]
    resolved = pa.schema(fields)
    functions = chunks.mapInArrow(scan, "key long, no int, value array<long>")
    known = functions.join(numbered.drop("raw"), "key").groupBy("key").applyInArrow(
        resolve, "key long, n long, form string, prefix_chars long, middle_chars long, side int, no int, state int, unit long"
    )
    asked = known.join(numbered.select("key", "raw"), "key").withColumn("chunk", F.when(F.col("form") != "plain", piece)).drop("raw").repartition("key", "no")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("chunk", "no", "state", "unit")), strict=True)
            at = [None if c is None else no * size + (rule.automaton().scan(c).select(state, unit) if unit else 0) for c, no, state, unit in rows]
            yield pa.RecordBatch.from_arrays([*batch.select(["key", "n", "form", "prefix_chars", "middle_chars", "side"]).columns, pa.array(at, pa.int64())], ["key", "n", "form", "prefix_chars", "middle_chars", "side", "at"])

    found = asked.mapInArrow(select, "key long, n long, form string, prefix_chars long, middle_chars long, side int, at long")
    where = lambda side: F.max(F.when(F.col("side") == side, F.col("at")))
    cuts = found.groupBy(F.col("key").alias(key)).agg(*[F.first(c).alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")], where(0).alias("lo"), where(1).alias("hi"))
    names = fresh(giants, *[f.name for f in _FOUND])
    cuts = cuts.select(key, *[F.col(f.name).alias(name) for f, name in zip(_FOUND, names, strict=True)])
    return giants.join(cuts, key).drop(key, *numbers)


def fill_in_middle(docs: DataFrame, text: str = "text", id: str = "doc_id", rule: Rule | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every row of ``docs`` with n (code points), form, prefix_chars, middle_chars and output (the text in its new order).

    The numbers that decide come from a hash of the seed and the id, so reruns agree and rows of one id
    and text are treated alike; a null id counts as an empty one.  Null and empty texts and texts that
    hold a control string stay as they are (form plain, no cuts, a null text's output is empty).
    Cuts may fall on each other or on either end.  Rows stay as they are, one by one; an empty table
    gives an empty table.  Texts may be as long as a row can be: those of more than ``chunk_bytes`` are
    scanned by many tasks.  Input columns called like a result column are replaced; others may have any name.
    """
    rule = rule or Rule()
    docs = docs.drop(*RESULT)
    numbers, key = fresh(docs, "_h1", "_h2", "_h3", "_h4"), fresh(docs, "_row")[0]
    rows = docs.withColumns(dict(zip(numbers, rule.numbers(id), strict=True)))
    long = F.octet_length(text) > chunk_bytes
    ws = Workspace(docs.sparkSession, "middle")
    giants = ws.table(rows.filter(long).withColumn(key, F.monotonically_increasing_id()), "giants")
    found = _whole(rows.filter(~F.coalesce(long, F.lit(False))), text, numbers, rule).unionByName(_giant(giants, text, numbers, rule, chunk_bytes, key))
    n, form, a, m, lo, hi = fresh(docs, *[f.name for f in _FOUND])
    raw = or_empty(text).cast("binary")
    part = lambda b, e: F.substring(raw, b + 1, e - b).cast("string")
    none, end = F.lit(0).cast("long"), F.octet_length(raw).cast("long")
    pieces = {rule.prefix: part(none, F.col(lo)), rule.suffix: part(F.col(hi), end), rule.middle: part(F.col(lo), F.col(hi))}
    ordered = lambda *marks: F.concat(*[c for m in marks for c in (F.lit(m), pieces[m])])
    output = (
        F.when(F.col(form) == "psm", ordered(rule.prefix, rule.suffix, rule.middle))
        .when(F.col(form) == "spm", ordered(rule.suffix, rule.prefix, rule.middle))
        .otherwise(or_empty(text))
    )
    return found.withColumn("output", output).select(*docs.columns, *[F.col(c).alias(name) for c, name in zip((n, form, a, m), RESULT, strict=False)], "output")


def restored(output: Column, form: Column, rule: Rule | None = None) -> Column:
    """The text again, from the output and the form alone."""
    rule = rule or Rule()
    first, second = F.when(form == "psm", rule.prefix).otherwise(rule.suffix), F.when(form == "psm", rule.suffix).otherwise(rule.prefix)
    one = F.substring(output, F.length(first) + 1, F.length(output))
    at = F.position(second, one)
    head, rest = F.substring(one, F.lit(1), at - 1), F.substring(one, at + F.length(second), F.length(one))
    at = F.position(F.lit(rule.middle), rest)
    tail, middle = F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + len(rule.middle), F.length(rest))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))
