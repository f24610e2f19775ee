"""Token counts by byte-pair merging on a heap and a linked list, with no identifiers emitted.

A text is normalised and cut into pieces as the vocabulary file says; for each piece the lowest-rank
adjacent pair is popped from a heap and merged in a linked list until no pair has a rank.  The piece
counts its initial symbols less its merges.  Counts of pieces are kept in a table of bounded size per
task, as most pieces repeat.

Supported files are ``tokenizers`` JSON files with a BPE model, an NFC / white space / lower-case
normaliser and a pattern followed by the byte-level alphabet.  Their ``path`` is a parameter.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.llm.base import fresh

LIMIT = 2048
CACHE = 300_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    keep = set(plain)
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class PairCounter(dict):
    """piece -> number of tokens; missing pieces are merged and kept while there is room."""

    def __init__(self, path: str, room: int = CACHE):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: only plain BPE models are supported")
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError(f"{path}: this normaliser or pre-tokeniser isn't supported")
        self.room = room
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.alphabet = byte_alphabet()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece)
        if len(self) >= self.room:
            self.clear()
        self[piece] = n
        return n

    def merged(self, piece: str) -> int:
        """Tokens of one piece: initial symbols minus merges."""
        ranks = self.ranks
        sym: list[str | None] = [self.alphabet[b] for b in piece.encode()]
        sym[-1] += self.suffix
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, sym[k], sym[k + 1]) for k in range(n - 1) if (r := ranks.get((sym[k], sym[k + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, a, b = heapq.heappop(heap)
            right = after[left]
            if sym[left] != a or right >= n or sym[right] != b:
                continue  # one of the two was merged meanwhile
            sym[left], sym[right] = a + b, None
            merges += 1
            then = after[left] = after[right]
            if then < n:
                before[then] = left
                if (r := ranks.get((a + b, sym[then]))) is not None:
                    heapq.heappush(heap, (r, left, a + b, sym[then]))
            prior = before[left]
            if prior >= 0 and (r := ranks.get((sym[prior], a + b))) is not None:
                heapq.heappush(heap, (r, prior, sym[prior], a + b))
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of a text; special strings in it are one token each."""
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        # capital sigma is lowered by itself, whatever follows it
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return sum(map(self.__getitem__, self.pattern.findall(text)))


_COUNTERS: dict[str, PairCounter] = {}


def _counter(path: str) -> PairCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PairCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Every row of ``docs`` without its text, with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    ``path`` is a vocabulary file that every executor has.  Null and empty texts have 0 bytes and 0
    tokens.  Rows are counted one by one, in one pass without a shuffle; nothing is truncated.  Input
    columns called like a result column are replaced.
    """
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    rest = [c for c in docs.columns if c != text]
    scanned = fresh(docs, "scanned")[0]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            n = pa.array([counter.count(t) if (t := s.as_py()) else 0 for s in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], n, batch.column(1)], schema.names)

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias(fresh(docs, "size")[0])
    found = docs.select(F.col(text).alias(scanned), size, *rest).mapInArrow(count, schema)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
