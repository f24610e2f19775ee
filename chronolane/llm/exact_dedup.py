"""Exact dedup by distributed MSD radix partitioning.

Texts are split by their length, then by successive bytes: each level splits every open group by the
next bytes of its texts, and each part that holds more than one document gets a number of its own, which
the next level splits in turn.  A group is done when it holds one document, or when its texts have ended;
texts that stayed together until then are equal, so no digest is compared anywhere.  The step grows by a
factor per level, so the number of levels is the logarithm of the longest text that has a partner.

Scale: a level counts its groups with map-side partial aggregation, so a group with a third of all
rows costs one row per map task there; groups of two or more are written and go back by an ordinary
equi-join whose hot partitions adaptive execution can split.  A level looks at its own bytes alone, and only
the bytes after them, of documents whose groups are still open, go on to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.base import Workspace, aside, back, fresh, or_empty


def exact_groups(
    docs: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "max", first_bytes: int = 64, growth: int = 16, with_text: bool = False
) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size`` and ``kept``; texts are equal if their bytes are.

    keep: which id of equal texts stays, "max" or "min".  with_text: the result carries the text, else
    it has all other columns.  Null texts count as empty, and all empty texts are equal.  Rows that tie
    (same text and same id) are all in the group and all kept.  A null id is never preferred to
    another; a group with null ids only keeps its rows, with a null ``keep_id``.  A very long text is one
    value of its row, cut level by level.  An empty input gives an empty result.  Input columns called like a result column are replaced.
    """
    if first_bytes < 1 or growth < 2:
        raise ValueError("first_bytes must be positive and growth at least 2")
    pick = {"max": F.max, "min": F.min}[keep]
    docs = docs.drop("keep_id", "group_size", "kept")
    rest, size, group, cut, n, top, done, number = fresh(docs, "rest", "size", "group", "cut", "n", "top", "done", "number")
    state = docs.withColumn(rest, or_empty(text).cast("binary")).withColumn(size, F.length(rest)).withColumn(group, F.col(size).cast("long"))
    if not with_text:
        state = state.drop(text)
    ws = Workspace(docs.sparkSession, "exact")
    width, seen, level, decided = first_bytes, 0, 0, None
    while True:
        seen += width
        split = state.withColumn(cut, F.substring(rest, 1, width)).withColumn(rest, F.substring(rest, width + 1, 2**31 - 1))
        parts = split.groupBy(group, cut).agg(F.count("*").alias(n), pick(id).alias(top)).filter(F.col(n) > 1)
        parts = ws.table(parts.withColumn(number, F.monotonically_increasing_id()), f"parts{level}")  # numbers stand once written
        joined = split.join(parts.hint("merge"), [group, cut], "left").withColumn(done, F.col(n).isNull() | (F.col(size) <= seen))
        rows = ws.table(joined.withColumn(rest, F.when(~F.col(done), F.col(rest))).drop(cut, group), f"level{level}")
        found = rows.filter(done).withColumn("keep_id", F.when(F.col(n).isNull(), F.col(id)).otherwise(F.col(top)))
        found = found.withColumn("group_size", F.coalesce(n, F.lit(1)).cast("long")).withColumn("kept", F.col("keep_id").eqNullSafe(F.col(id)))
        found = found.drop(rest, size, n, top, done, number)
        decided = found if decided is None else decided.unionByName(found)
        state = rows.filter(~F.col(done)).drop(n, top, done).withColumnRenamed(number, group)
        if state.isEmpty():
            return decided
        width, level = min(width * growth, 1 << 30), level + 1


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns, whatever their names."""
    rows, renamed = aside(docs, "keep_id", "group_size", "kept")
    found = exact_groups(rows, renamed.get(text, text), renamed.get(id, id), keep, with_text=True).filter("kept")
    return back(found, docs.columns, renamed)
