"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Every document's lines are hashed three at a time; a window that occurs again anywhere (in a later
document, or later in the same one) marks its lines there for removal.  Covered positions are merged
into spans and the lines outside them are joined again.

Scale: windows travel as 16-byte digests with a document key.  Counts and first occurrences are
partially aggregated before the shuffle; only windows that occur twice or more go through the join
that finds later occurrences, which adaptive execution can split where one window is hot.  Spans are
collected per document as a set, bounded by the document's own lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.base import fresh, or_empty

WINDOW = 3


def line_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` less its repeated windows of lines, plus ``n_lines`` and ``n_removed``.

    Lines end at "\\n" and are compared as they are.  The first occurrence of a window, by (id, line
    position), stays; all lines of later occurrences go.  Texts of fewer lines than a window, empty and
    null texts are untouched (null stays null, with no lines).  No row is dropped: a text may become
    empty.  Rows with the same id and text are one document here, so they all keep what the first keeps;
    rows with the same id and different texts are told apart by their texts.  A null id comes before
    all others.  Input columns called n_lines or n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    lines, key, pos, digest, at, n, spans = fresh(docs, "lines", "text_key", "pos", "digest", "at", "n", "spans")
    body = or_empty(text)
    keyed = docs.withColumn(key, F.xxhash64(body))
    split = F.split(body, "\n", -1)
    windows = (
        keyed.select(F.col(id), F.col(key), split.alias(lines))
        .filter(F.size(lines) >= window)
        .select(
            id,
            key,
            F.posexplode(F.transform(F.sequence(F.lit(1), F.size(lines) - (window - 1)), lambda i: F.unhex(F.md5(F.array_join(F.slice(lines, i, window), "\n"))))).alias(pos, digest),
        )
    )
    place = F.struct(F.col(id), F.col(pos), F.col(key))
    again = windows.groupBy(digest).agg(F.count("*").alias(n), F.min(place).alias(at)).filter(F.col(n) > 1).drop(n)
    later = windows.join(again, digest).filter(~place.eqNullSafe(F.col(at)))
    starts = later.groupBy(id, key).agg(F.sort_array(F.collect_set(pos)).alias(at))
    first = F.filter(at, lambda p, i: (i == 0) | (p > F.get(at, i - 1) + window))
    last = F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > p + window))
    merged = starts.select(F.col(id).alias(pos), F.col(key).alias(digest), F.arrays_zip(first.alias("a"), F.transform(last, lambda p: p + window).alias("b")).alias(spans))
    both = keyed.join(merged, keyed[id].eqNullSafe(merged[pos]) & (keyed[key] == merged[digest]), "left").withColumn(lines, split)
    # kept run i lies between span i-1 and span i; positions count from 0, slices from 1
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["b"])
    finish = lambda i: F.when(i == F.size(spans), F.size(lines)).otherwise(F.get(spans, i)["a"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.slice(lines, begin(i) + 1, finish(i) - begin(i))))
    removed = F.aggregate(spans, F.lit(0), lambda acc, s: acc + (s["b"] - s["a"]))
    out = {c: F.col(c) for c in docs.columns} | {text: F.when(F.col(spans).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))}
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    return both.select(*[v.alias(c) for c, v in out.items()], n_lines.alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"))
