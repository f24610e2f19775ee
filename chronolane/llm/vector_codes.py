"""Vector code compression: product codes from Lloyd rounds over distinct integer parts.

Method: vectors become whole numbers and are cut into parts.  Equal parts of one position are one row with
a weight, so a round of Lloyd's algorithm reads each distinct part once; its sums are made per task and
merged per entry.  At last each distinct part gets its code and its error, which are joined back to the
vectors.  All arithmetic is on integers, so no order of summing changes a result.

Scale: sums, codebooks and first entries are bounded by positions x entries.  Distinct parts come from a
partial aggregation, so copies of a vector shrink before they travel.  For the join back a task holds some
thousand vectors as a block: a part that many of them share is sent once for the block with the list of
its rows, so a vector that a third of all rows have costs a few rows a block, and a block is put together
again by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.llm.base import Workspace, fresh

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Whole numbers beyond this would overflow a part's squared distance.
MOST = 1 << 27
BLOCK_ROWS = 4096
RESULT = ["code", "error", "label_error"]


def whole_parts(vector: str, parts: int, scale: int) -> tuple:
    """Expressions: the vector as whole numbers (NULL if a component is missing or not finite), and its parts."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    small = lambda x: F.when(F.abs(x) < MOST / scale, x).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST // scale}")).cast("double"))
    whole = F.when(F.forall(vector, finite), F.transform(vector, lambda x: F.floor(small(x.cast("double")) * scale)))
    each = F.size(vector) / parts
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice(F.col(vector), (k * each + 1).cast("int"), each.cast("int")))
    return whole, cut


def nearest(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of equals) and the squared distance, for rows of whole numbers."""
    code, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for at in range(0, len(parts), 4096):
        some = parts[at : at + 4096]
        far = reduce(np.add, ((some[:, j, None] - codebook[None, :, j]) ** 2 for j in range(parts.shape[1])), np.zeros((len(some), len(codebook)), np.int64))
        code[at : at + 4096] = far.argmin(axis=1)
        error[at : at + 4096] = far.min(axis=1)
    return code, error


def _columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and part of each row of a batch, as arrays."""
    return batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, width)


def _assigned(pos: np.ndarray, part: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, error = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    for p in np.unique(pos).tolist():
        own = pos == p
        code[own], error[own] = nearest(part[own], books[p])
    return code, error


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """New codebooks (positions x entries x width): floors of the weighted means; an entry that nothing is nearest to stays."""
    _, entries, width = books.shape
    names = [f"s{j}" for j in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books) * entries, width + 1), object)  # no sum overflows
        for batch in batches:
            pos, part = _columns(batch, width)
            weight = batch.column(2).to_numpy()
            at = pos * entries + _assigned(pos, part, books)[0]
            held, into = np.unique(at, return_inverse=True)
            wide = object if int(weight.max()) * MOST * len(weight) >= 1 << 62 else np.int64
            for j, column in enumerate([np.ones_like(weight), *part.T]):
                own = np.zeros(len(held), wide)
                np.add.at(own, into, column.astype(wide) * weight)
                total[held, j] += own
        used = np.flatnonzero(total[:, 0])
        columns = [pa.array([str(v) for v in total[used, j]]) for j in range(width + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *columns], ["at", "n", *names])

    found = distinct.select("pos", "part", "weight").mapInArrow(sums, "at int, n string, " + ", ".join(f"{s} string" for s in names))
    found = found.groupBy("at").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *names)])
    out = books.copy()
    for r in found.collect():  # positions x entries rows at most
        out[r["at"] // entries, r["at"] % entries] = [int(r[s]) // int(r["n"]) for s in names]
    return out


def _first_books(whole: DataFrame, id: str, parts: int, entries: int) -> np.ndarray:
    rows = whole.orderBy(F.col(id).asc_nulls_last(), "whole").limit(entries).collect()
    cut = np.array([r["whole"] for r in rows], np.int64).reshape(len(rows), parts, -1)
    return cut.transpose(1, 0, 2)


def vector_codes(
    vectors: DataFrame, vector: str = "embedding", id: str = "vec_id", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """Kept vectors without their components, with code (two hex digits a part), error and label_error; and the codebooks.

    Left out are vectors that are NULL, hold NULL or non-finite components, or are not as long as that of
    the smallest kept id (whose length must be a multiple of ``parts``, of one component a part at least,
    or the vector is left out too).  Components become floor(scale * x); one beyond 2^27 is an error.  The
    codebook of a position begins as the parts of the vectors of smallest ids (equal ids: by components),
    of fewer than ``entries`` where there are fewer vectors.  Ties go to the lower entry.  label_error sums
    the errors of rows of one label, NULL labels together.  Repeated rows count each.  An empty table gives
    an empty table and no entries.  Input columns called like a result column are replaced, others may have any name.
    """
    spark = vectors.sparkSession
    vectors = vectors.drop(*RESULT)
    ws = Workspace(spark, "codes")
    numbers, row = fresh(vectors, "whole", "row")
    whole, _ = whole_parts(vector, parts, scale)
    fits = (F.size(vector) > 0) & (F.size(vector) % parts == 0)
    rest = [c for c in vectors.columns if c != vector]
    kept = vectors.filter(F.col(vector).isNotNull() & fits).withColumn(numbers, whole).filter(F.col(numbers).isNotNull())
    kept = ws.table(kept.select(*rest, numbers).withColumn(row, F.monotonically_increasing_id()), "kept")
    first = kept.orderBy(F.col(id).asc_nulls_last(), numbers).select(F.size(numbers)).limit(1).collect()
    length = first[0][0] if first else parts
    width = length // parts
    kept = kept.filter(F.size(numbers) == length)
    _, cut = whole_parts(numbers, parts, scale)
    pieces = kept.select(F.posexplode(cut).alias("pos", "part"))
    distinct = ws.table(pieces.groupBy("pos", "part").agg(F.count("*").alias("weight")), "distinct")
    books = _first_books(kept.select(F.col(id).alias("id"), F.col(numbers).alias("whole")), "id", parts, entries) if first else np.zeros((parts, 0, width), np.int64)
    for _ in range(rounds):
        books = lloyd_round(distinct, books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, part = _columns(batch, width)
            code, error = _assigned(pos, part, books)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int32()), pa.array(error)], ["pos", "part", "code", "error"])

    codes = distinct.select("pos", "part").mapInArrow(coded, "pos int, part array<bigint>, code int, error long")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct parts of a block of rows, each with the rows that have it; the block is called by its first row."""
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                cut = some.column(1).flatten().to_numpy().reshape(-1, parts, width)
                out: list[tuple] = []
                for p in range(parts):
                    found, which = np.unique(cut[:, p], axis=0, return_inverse=True)
                    order = np.argsort(which.ravel(), kind="stable")
                    ends = np.cumsum(np.bincount(which.ravel(), minlength=len(found)))
                    out += [(p, part, rows) for part, rows in zip(found, np.split(order, ends[:-1]), strict=True)]
                pos, part, rows = zip(*out, strict=True)
                own = some.column(0).to_numpy()
                name = pa.array(np.full(len(pos), own[0]), pa.int64())
                lists = [pa.array(v, pa.list_(pa.int64())) for v in (part, [own[r] for r in rows])]
                yield pa.RecordBatch.from_arrays([name, pa.array(pos, pa.int32()), *lists], ["block", "pos", "part", "rows"])

    def assemble(key: tuple, table: pa.Table) -> pa.Table:
        """Code and error of each row of a block."""
        table = table.combine_chunks()
        pos, code, error = (table[c].to_numpy() for c in ("pos", "code", "error"))
        lists = table["rows"].combine_chunks()
        many = np.diff(lists.offsets.to_numpy())
        ids, rows = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        codes = np.zeros((len(ids), parts), np.uint8)
        codes[rows, np.repeat(pos, many)] = np.repeat(code, many)
        errors = np.zeros(len(ids), np.int64)
        np.add.at(errors, rows, np.repeat(error, many))
        spelled = codes.tobytes().hex()
        texts = [spelled[k : k + 2 * parts] for k in range(0, len(spelled), 2 * parts)]
        return pa.table({"row": ids, "code": texts, "error": errors})

    sent = kept.select(row, numbers).mapInArrow(blocks, "block long, pos int, part array<bigint>, rows array<bigint>")
    back = sent.join(codes, ["pos", "part"]).groupBy("block").applyInArrow(assemble, "row long, code string, error long")
    code, error, label_error, same = fresh(kept, "_code", "_error", "_label_error", "_label")
    found = kept.drop(numbers).join(back.select(F.col("row").alias(code + "_row"), F.col("code").alias(code), F.col("error").alias(error)), F.col(row) == F.col(code + "_row")).drop(code + "_row")
    found = ws.table(found, "found")
    per = found.groupBy(F.col(label).alias(same)).agg(F.sum(error).alias(label_error))
    found = found.join(per, F.col(label).eqNullSafe(F.col(same)))
    return found.select(*rest, *[F.col(c).alias(name) for c, name in zip((code, error, label_error), RESULT, strict=True)]), books


def codebooks_sha256(books: np.ndarray) -> str:
    """Digest of all entries' components as decimal numbers, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
