"""Vectorised word scanning over Arrow string buffers (numpy only, bounded memory).

Both word classes used by the operators are unions of ASCII characters plus, where wanted, every
non-ASCII character.  In UTF-8 each byte of a non-ASCII character is >= 0x80, so words can be cut on
bytes without decoding the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_M = np.uint64(0x9E3779B97F4A7C15)

#: ``[^\x20\x09-\x0D]+``
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_POWERS = np.multiply.accumulate(np.full(1 << 12, _rng.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)))
_HASH_BYTES = 1 << 21


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words of a run of texts: byte spans in ``data``, the row of each, and the rows' first words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first[i]:first[i+1] are the words of row i

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.start), np.uint64)
        lens = self.end - self.start
        at = 0
        total = np.cumsum(lens)
        while at < len(out):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + _HASH_BYTES, "right")))
            n = lens[at:to]
            offs = np.cumsum(n) - n
            inner = np.arange(int(n.sum())) - np.repeat(offs, n)
            src = inner + np.repeat(self.start[at:to], n)
            vals = _TABLE[self.data[src]] * _power(inner)
            out[at:to] = np.add.reduceat(vals, offs)
            at = to
        return mix(out ^ (lens.astype(np.uint64) * _M))


def _power(i: np.ndarray) -> np.ndarray:
    global _POWERS
    top = int(i.max()) + 1 if len(i) else 0
    while top > len(_POWERS):
        _POWERS = np.concatenate([_POWERS, _POWERS * _POWERS[-1]])
    return _POWERS[i]


def chunks(column: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column whose texts hold about ``max_bytes`` (one row at least)."""
    off = _offsets(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1)
        to = min(to, n)
        yield at, to
        at = to


def _plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind)
    return column.fill_null(b"") if column.null_count else column


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if column.buffers()[1] is not None else np.zeros(1, np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)


def scan(column: pa.Array, cls: np.ndarray, lower: bool = True) -> Words:
    """Cut every text of a string column into words of a byte class; null texts have none."""
    column = _plain(column)
    off = _offsets(column)
    raw = column.buffers()[2]
    data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[off[0] : off[-1]]
    off = off - off[0]
    if lower:
        data = _LOWER[data]
    inside = cls[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = np.unique(off[(off > 0) & (off < len(data))])
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, off))
