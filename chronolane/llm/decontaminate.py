"""Benchmark decontamination with an FM-index per training shard.

A shard is a few megabytes of whole documents.  Phrases (13-word windows of benchmark items) that may
occur in it are searched backward through the wavelet-matrix ranks of the shard's FM-index, occurrences
are located from sampled suffix positions, and overlapping ones are merged into removal spans.  Words are
coded by the phrases' vocabulary; runs of such words that are long enough for the shortest phrase are
indexed, everything else separates them (no phrase can lie across).

Scale: the benchmark is a table of windows, never collected or broadcast.  A filter of fixed size
(``FILTER_WORDS`` numbers, 8 MB) over the windows' hashes is; the rolling hashes of a shard's words that
pass it are joined with the windows, so a shard gets the phrases whose hash it holds and no others.  A
fuller filter lets more hashes through to the join and changes nothing else.  Documents are written once
as shards, one compressed row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from chronolane.llm.base import Workspace, aside, back, fresh, packed, unpacked
from chronolane.llm.fm_index import FMIndex
from chronolane.llm.textscan import ALNUM, chunks, mix, scan

WINDOW = 13
SHARD_BYTES = 4 << 20
FILTER_WORDS = 1 << 20
_SPANS = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())]))


def _factors(n: int) -> np.ndarray:
    """Odd factors of a window's words by their place."""
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def _windows(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(h, size, words, item) of each item's windows; words are their 64-bit hashes."""
        factors = _factors(window)
        for batch in batches:
            words = scan(batch.column(1), ALNUM)
            hashes, first = words.hashes(), words.first.tolist()
            for i, (s, e) in enumerate(zip(first[:-1], first[1:], strict=True)):
                if s == e:
                    continue
                n = min(window, e - s)
                own = np.lib.stride_tricks.sliding_window_view(hashes[s:e], n)
                h = mix((own * factors[:n]).sum(axis=1) ^ np.uint64(n))
                item = batch.column(0).take(pa.array(np.full(len(own), i)))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(own), n, np.int32)), pa.array([w.tobytes() for w in own], pa.binary()), item], ["h", "size", "words", "item"])

    return cut


def _bits(h: Column) -> tuple[Column, Column]:
    """The two places of a hash in the filter, as in _passing()."""
    return F.pmod(h, F.lit(64 * FILTER_WORDS)), F.pmod(F.shiftright(h, 32), F.lit(64 * FILTER_WORDS))


def _filter(windows: DataFrame) -> np.ndarray:
    """A Bloom filter over the windows' hashes: at most FILTER_WORDS rows reach the driver."""
    places = windows.select("h").distinct().select(F.explode(F.array(*_bits(F.col("h")))).alias("p"))
    words = places.groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("bits"))
    held = np.zeros(FILTER_WORDS, np.uint64)
    for at, bits in words.collect():
        held[at] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return held


def _passing(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    size, on = 64 * len(held), np.ones(len(h), bool)
    for place in (h.view(np.int64) % size, (h.view(np.int64) >> 32) % size):
        on &= (held[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0
    return on


def _shards(shard_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in chunks(batch.column(0), shard_bytes):
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + k]), pa.array([packed(part)], pa.binary())], ["shard", "docs"])
                k += 1

    return pack


def _asking(held, sizes: list[int]):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, h): hashes of a shard's word windows that pass the filter."""
        factors = _factors(max(sizes, default=1))
        for batch in batches:
            for shard, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = scan(unpacked(raw).column(0).combine_chunks(), ALNUM)
                hashes, row = words.hashes(), words.row()
                rolled, found = np.zeros(len(hashes), np.uint64), []
                for n in range(1, max(sizes, default=0) + 1):
                    if n > len(hashes):
                        break
                    rolled = rolled[: len(hashes) - n + 1] + hashes[n - 1 :] * factors[n - 1]
                    if n in sizes:
                        h = mix(rolled[row[: len(rolled)] == row[n - 1 :]] ^ np.uint64(n))
                        found.append(np.unique(h[_passing(held.value, h)]))
                got = np.concatenate(found) if found else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), shard)), pa.array(got.view(np.int64))], ["shard", "h"])

    return ask


class Phrases:
    """Phrases as rows of word hashes, by length."""

    def __init__(self, words: list[bytes], sizes: np.ndarray):
        self.lengths = sizes.astype(np.int64)
        flat = np.frombuffer(b"".join(words), np.uint64)
        self.vocabulary = np.unique(flat)
        codes, at = np.searchsorted(self.vocabulary, flat) + 1, np.cumsum(self.lengths) - self.lengths
        self.shortest = int(self.lengths.min()) if len(words) else 0
        self.by_length = {}
        for n in np.unique(self.lengths).tolist():
            which = np.flatnonzero(self.lengths == n)
            self.by_length[n] = which, codes[at[which, None] + np.arange(n)]

    def occurrences(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of every occurrence in words that belong to rows."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.lengths) or not len(hashes):
            return none
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        code = np.where(self.vocabulary[at] == hashes, at + 1, 0)
        # maximal runs of vocabulary words within a row
        cut = np.ones(len(code), bool)
        cut[1:] = (code[1:] == 0) | (code[:-1] == 0) | (row[1:] != row[:-1])
        begin = np.flatnonzero(cut)
        size = np.diff(np.append(begin, len(code)))
        use = (size >= self.shortest) & (code[begin] > 0)
        begin, size = begin[use], size[use]
        if not len(begin):
            return none
        total = int(size.sum())
        run = np.repeat(np.arange(len(begin)), size)
        word = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + begin[run]
        seq, origin = np.zeros(total + len(begin), np.int64), np.zeros(total + len(begin), np.int64)
        place = np.arange(total) + run
        seq[place], origin[place] = code[word], word
        index = FMIndex(seq, len(self.vocabulary))
        starts, phrases = [], []
        for which, patterns in self.by_length.values():
            lo, hi = index.search(patterns)
            count = hi - lo
            got = np.flatnonzero(count)
            rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count[got]) - count[got], count[got]) + np.repeat(lo[got], count[got])
            starts.append(origin[index.locate(rows)])
            phrases.append(np.repeat(which[got], count[got]))
        return np.concatenate(starts), np.concatenate(phrases)


def _marker(schema: pa.Schema):
    def mark(home: pa.Table, asked: pa.Table) -> pa.Table:
        """The documents of one shard with what its phrases hit."""
        docs = unpacked(home.column("docs")[0].as_py())
        words = scan(docs.column(0).combine_chunks(), ALNUM)
        hashes, row, rows = words.hashes(), words.row(), docs.num_rows
        n = len(hashes)
        phrases = Phrases(asked.column("words").to_pylist(), asked.column("size").to_numpy())
        start, which = phrases.occurrences(hashes, row)
        delta = np.zeros(n + 1, np.int64)
        np.add.at(delta, start, 1)
        np.add.at(delta, start + phrases.lengths[which], -1)
        named, items = asked.column("items").to_pylist(), [set() for _ in range(rows)]
        for r, p in np.unique(np.stack([row[start], which], axis=1), axis=0).tolist():
            items[r].update(named[p])
        hit = np.cumsum(delta[:-1]) > 0
        edge = np.ones(n, bool)
        edge[1:] = (hit[1:] != hit[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], n)[hit[begin]] if n else begin
        begin = begin[hit[begin]] if n else begin
        spans: list[list] = [[] for _ in range(rows)]
        for s, e, r in zip(begin.tolist(), end.tolist(), row[begin].tolist(), strict=True):
            spans[r].append({"first_word": s - int(words.first[r]), "end_word": e - int(words.first[r])})
        n_words = np.diff(words.first)
        n_hit = np.bincount(row[hit], minlength=rows) if n else np.zeros(rows, np.int64)
        found = [n_words, n_hit, [sorted(x, key=str) for x in items], spans, (n_hit > 0) & (20 * n_hit >= n_words)]
        kinds = [f.type for f in schema][-5:]
        return pa.Table.from_arrays([*docs.columns[1:], *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], schema.names)

    return mark


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, with_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit, items (sorted as strings), spans and contaminated.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.  A window is
    ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.  A
    document word inside any occurrence of a window is hit; spans are the maximal runs of hit words.
    contaminated: at least one word in twenty is hit.  Null and empty texts have no words and are clean;
    items without words, or with a null id, count for nothing; ids are of any type.  Repeated rows are
    judged one by one; items with the same windows are all named.  Input columns called like a result
    column are replaced.  A very long text is a shard of its own, indexed whole.  Without documents the
    result is empty, without a benchmark every document is clean.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    ws = Workspace(spark, "phrases")
    docs = docs.drop("n_words", "n_hit", "items", "spans", "contaminated")
    kind = benchmark.schema[item_id].dataType
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("body")).filter("item IS NOT NULL AND body IS NOT NULL")
    cut = items.select("item", "body").mapInArrow(_windows(window), f"h long, size int, words binary, item {kind.simpleString()}")
    windows = ws.table(cut.groupBy("h", "size", "words").agg(F.collect_set("item").alias("items")), "windows")
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # at most ``window`` of them
    held = spark.sparkContext.broadcast(_filter(windows))

    scanned = fresh(docs, "scanned")[0]
    rest = [c for c in docs.columns if with_text or c != text]
    found = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(kind)), ("spans", _SPANS), ("contaminated", T.BooleanType())]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(*f) for f in found])
    home = docs.select(F.col(text).alias(scanned), *rest).mapInArrow(_shards(shard_bytes), "shard long, docs binary")
    home.write.option("compression", "none").parquet(ws.path("home"))
    home = ws.read("home", home)
    asked = home.mapInArrow(_asking(held, sizes), "shard long, h long").join(windows, "h").select("shard", "size", "words", "items")
    return home.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_marker(to_arrow_schema(schema)), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged, with columns of any names."""
    rows, renamed = aside(docs, "n_words", "n_hit", "items", "spans", "contaminated")
    found = contamination(rows, benchmark, renamed.get(text, text), with_text=True, **options).filter(~F.col("contaminated"))
    return back(found, docs.columns, renamed)
