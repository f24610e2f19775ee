"""Packing documents into as few sequences of a fixed number of tokens as can be found, by bin completion.

Method: documents become pieces of at most ``capacity`` tokens (only longer ones are cut).  Piece sizes are
whole numbers up to the capacity, so all pieces together are a histogram of at most ``capacity`` counts;
bin completion (bin_completion.py) turns it into patterns, each used for a number of sequences.  A pattern
gives slots: so many pieces of one size, from this sequence on, at this offset.  Pieces of a size are ranked
and the k-th piece takes the k-th slot.

Scale: one search serves any number of documents, as the histogram and the slots are bounded by the
capacity; copies only raise a count.  Pieces are ranked in square-root groups (numbers within a group after
sums of the groups before it), so a size that a third of the pieces have is spread like any other.  Texts
are read once and never shuffled.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.llm.base import Workspace, fresh
from chronolane.llm.bin_completion import NODES, complete
from chronolane.llm.token_counts import byte_alphabet

CAPACITY = 1024
END = 2
CACHE = 300_000
#: How byte-level vocabularies cut a text into words (contractions, letters, digits, other, white space).
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RESULT = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


class _Unlike(Exception):
    """A word has a character that the library classes in another way than the pattern."""


class TokenIds(dict):
    """word -> its ids as 32-bit numbers (little-endian, as on every machine that Spark runs on), as the ``tokenizers`` library gives them.

    Files with plain byte-level words are cut by a pattern and the words looked up, since most repeat; the
    library's model merges the bytes of missing words.  A text with a character that pattern and library don't class alike, and
    any text of another kind of file, is encoded whole by the library.  ``room`` words are kept, and as many
    that were kept before them; those that come again stay.
    """

    def __init__(self, path: str, room: int = CACHE):
        from tokenizers import Tokenizer

        super().__init__()
        self.room, self.whole = room, Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not spec["normalizer"]
        plain = plain and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.pattern = regex.compile(BYTE_LEVEL) if plain else None
        self.special = {t["content"]: t["id"] for t in added}
        found = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None
        self.alike: dict[str, bool] = {}
        self.known: set[str] = set()  # characters that are alike
        self.older: dict[str, bytes] = {}
        self.model, self.letters = self.whole.model, dict(enumerate(byte_alphabet()))

    def __missing__(self, word: str) -> bytes:
        ids = self.older.pop(word, None)
        if ids is None:
            if not self.known.issuperset(word):
                if not all(map(self._same, word)):
                    raise _Unlike
                self.known.update(word)
            ids = self._word(word)
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _ids(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of one word: the library's merges alone, without the steps around them that only find words."""
        letters = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _same(self, char: str) -> bool:
        """Whether the library and the pattern cut around this character alike."""
        if char not in self.alike:
            probe = f"a{char}1{char}!{char} {char}{char}"
            own = [m.span() for m in self.pattern.finditer(probe)]
            self.alike[char] = own == [span for _, span in self.whole.pre_tokenizer.pre_tokenize_str(probe)]
        return self.alike[char]

    def _words(self, text: str) -> bytes:
        return b"".join([self[w] for w in self.pattern.findall(text)])

    def ids(self, text: str) -> bytes:
        if not self.pattern:
            return self._ids(text)
        try:
            if not any(map(text.__contains__, self.special)):
                return self._words(text)
            return b"".join(array("I", [self.special[p]]).tobytes() if k % 2 else self._words(p) for k, p in enumerate(self.split.split(text)))
        except _Unlike:
            return self._ids(text)


_READERS: dict[str, TokenIds] = {}


def _reader(path: str) -> TokenIds:
    if path not in _READERS:
        _READERS[path] = TokenIds(path)
    return _READERS[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of n tokens: whole sequences, the first piece holds what is over."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row per piece: the document's other columns, piece, start, length, ids_crc32 and, if asked for, the ids."""
    docs = docs.drop("piece", "start", "length", "ids_crc32", "ids")
    rest = [c for c in docs.columns if c != text]
    own = [("piece", T.IntegerType(), pa.int32()), ("start", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64())]
    if with_ids:
        own.append(("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())))
    schema = T.StructType([*(docs.schema[c] for c in rest), *(T.StructField(n, t) for n, t, _ in own)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, close = _reader(path), array("I", [end]).tobytes()
        for batch in batches:
            out, rows = [[] for _ in own], []
            for row, t in enumerate(batch.column(0)):
                ids = memoryview(reader.ids(t.as_py() or "") + close)
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    raw = ids[4 * start : 4 * (start + length)]
                    rows.append(row)
                    values = (piece, start, length, zlib.crc32(raw), *([np.frombuffer(raw, "<i4")] if with_ids else []))
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            taken = pa.RecordBatch.from_arrays(batch.columns[1:], rest).take(pa.array(rows, pa.int32())).columns if rest else []
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, t) for c, (_, _, t) in zip(out, own, strict=True))], schema.names)

    return docs.select(F.col(text).alias(fresh(docs, "scanned")[0]), *rest).mapInArrow(cut, schema)


_SLOTS = "length int, first_rank long, first_sequence long, each int, offset long"


def _slots(sizes: DataFrame, capacity: int, nodes: int) -> DataFrame:
    """One row per pattern and size: pieces of that size from a rank on, ``each`` to a sequence, side by side at an offset."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            counts[batch.column(0).to_numpy()] += batch.column(1).to_numpy()
        patterns, _ = complete(counts, nodes)
        rank, sequence, out = np.zeros(capacity + 1, np.int64), 0, []
        for bin_, times in patterns:
            offset = 0
            for size in sorted(set(bin_), reverse=True):
                each = bin_.count(size)
                out.append((size, int(rank[size]), sequence, each, offset))
                rank[size] += each * times
                offset += each * size
            sequence += times
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _SLOTS.split(", ")])

    return sizes.select(F.col("length").cast("int"), "count").coalesce(1).mapInArrow(search, _SLOTS)


def pack(docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY, end: int = END, nodes: int = NODES, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with piece, start, length, ids_crc32, sequence_id, offset and the document's other columns.

    A document is its ids by the vocabulary file at ``path`` (which every executor has), then ``end``; null
    and empty texts are that one id.  Documents of more than ``capacity`` ids are cut: the first piece holds
    what is over, the others are full.  Sequences are numbered from 0, offsets in one are gapless from 0.
    ``nodes`` bounds the search for fewer sequences (20,000 nodes; a best-fit packing stands where the search
    finds none better).  Rows are documents each, repeated ones too; an empty table gives an empty table.
    Pieces of one size are interchangeable: which of them takes which place depends on how the input is
    partitioned, the number of sequences doesn't.  Input columns called like a result column are replaced,
    others may have any name.  A document's ids are held in memory by the task that reads it.
    """
    spark = docs.sparkSession
    docs = docs.drop(*RESULT, "ids")
    ws = Workspace(spark, "packing")
    spot, group, inside, below = fresh(docs, "_spot", "_group", "_inside", "_below")
    pieces = ws.table(token_pieces(docs, path, text, capacity, end, with_ids).withColumn(spot, F.monotonically_increasing_id()), "pieces")
    sizes = ws.table(pieces.groupBy("length").count(), "sizes")  # at most ``capacity`` rows
    slots = ws.table(_slots(sizes, capacity, nodes), "slots").orderBy("length", "first_rank").collect()  # bounded by the capacity, as sizes is
    table = spark.sparkContext.broadcast(np.array([tuple(r) for r in slots], np.int64).reshape(-1, 5))

    size, many = fresh(pieces, "_size", "_many")
    groups = F.ceil(F.sqrt(many)).cast("int")
    placed = pieces.join(F.broadcast(sizes.select(F.col("length").alias(size), F.col("count").alias(many))), F.col("length") == F.col(size))
    placed = placed.withColumn(group, F.pmod(F.xxhash64(spot), groups).cast("int")).drop(size, many)
    rank = F.row_number().over(Window.partitionBy("length", group).orderBy(spot)) - 1
    held = placed.groupBy("length", group).count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(F.col("length").alias(size), F.col(group).alias(many), before.alias(below))
    ranked = placed.withColumn(inside, rank).join(held, (F.col("length") == F.col(size)) & (F.col(group) == F.col(many))).drop(size, many)
    rest = [c for c in pieces.columns if c != spot]
    schema = T.StructType([*(pieces.schema[c] for c in rest), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = table.value
        starts = (of[:, 0] << 48) + of[:, 1]
        for batch in batches:
            rank, length = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.searchsorted(starts, (length << 48) + rank, "right") - 1
            _, first, sequence, each, offset = of[at].T
            nth = rank - first
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sequence + nth // each), pa.array(offset + nth % each * length)], schema.names)

    return ranked.select((F.col(inside) + F.col(below)).alias(inside), F.col("length").alias(size), *rest).mapInArrow(place, schema)


def packed_sequences(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """The sequences themselves: sequence_id, ids (at most ``capacity`` of them), and the documents in it with their pieces and offsets."""
    found = pack(docs, path, text, with_ids=True, **options)
    held = F.array_sort(F.collect_list(F.struct("offset", F.col(id).alias("id"), "piece", "length", "ids")))
    grouped = found.groupBy("sequence_id").agg(held.alias("held"))
    parts = F.transform("held", lambda h: F.struct(h["id"].alias("id"), h["piece"].alias("piece"), h["offset"].alias("offset"), h["length"].alias("length")))
    return grouped.select("sequence_id", F.flatten(F.transform("held", lambda h: h["ids"])).alias("ids"), parts.alias("pieces"))
