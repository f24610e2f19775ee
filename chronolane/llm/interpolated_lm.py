"""Bigram language-model scores by deleted interpolation.

p(w | v) mixes c(vw)/c(v), c(w)/N and 1/(V+1) with weights that depend on how often the context v was
seen, in octaves of its count.  The weights come from expectation-maximisation on held-out counts: a
tenth of the training documents is deleted from the counts and its tokens are explained with the rest;
the final scores use all training counts.

Scale: nothing of the model is broadcast or collected.  Documents are written once as batches, one
compressed row each.  A batch sends its distinct words and bigrams, as sorted keys with counts, to the
owners of key ranges; an owner adds up each key and answers every batch in the order it asked, so the
way back is counts alone and a hot word or bigram costs one entry per batch at each end.  Words and
bigrams have 64-bit keys, sent as 6-byte steps from the ones before them.  The driver sees three totals and a
histogram of (context bucket, probability cells) whose size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from chronolane.llm.base import Workspace, packed, unpacked
from chronolane.llm.textscan import NON_SPACE, chunks, mix, scan

BATCH_BYTES = 8 << 20
BUCKETS = 16  # octaves of the context count; 0: never seen
STEPS, OCTAVES = 4, 44  # probability cells of the histogram: STEPS to an octave
CELLS = STEPS * OCTAVES + 1
ROUNDS = 60
_END = np.uint64(0x5851F42D4C957F2D)
_LEFT = np.uint64(0x9FB21C651E98DF25)
_ASKED = "kind string, part int, batch long, keys binary, train binary, gone binary"


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of each text with an end after them, bigram hashes (the end also starts a text), first token of each row."""
    words = scan(column, NON_SPACE)
    n = len(words.first) - 1
    row = words.row()
    uni = np.full(len(words.start) + n, _END, np.uint64)
    uni[np.arange(len(words.start)) + row] = words.hashes()
    first = words.first + np.arange(n + 1)
    left = np.empty_like(uni)
    left[1:] = uni[:-1]
    left[first[:-1]] = _END
    return uni, mix(left * _LEFT + uni), first


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Owners of ascending key ranges."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _small(x: np.ndarray) -> bytes:
    """Counts in as few bytes as they need, compressed; _counts() reads them."""
    top = int(x.max()) if len(x) else 0
    kind = next(k for k in "BHIQ" if top < 1 << (8 * np.dtype(k).itemsize))
    return kind.encode() + pa.compress(x.astype(kind).tobytes(), codec="zstd", asbytes=True) + len(x).to_bytes(8, "little")


def _counts(raw: bytes) -> np.ndarray:
    kind, n = chr(raw[0]), int.from_bytes(raw[-8:], "little")
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(raw[1:-8], decompressed_size=size, codec="zstd", asbytes=True), kind).astype(np.int64) if n else np.zeros(0, np.int64)


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys as the first and 6-byte steps, where those fit."""
    step = np.diff(keys)
    if len(step) and int(step.max()) >= 1 << 48:
        return b"8" + keys.tobytes()
    return b"6" + keys[:1].tobytes() + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _keys(raw: bytes) -> np.ndarray:
    body = np.frombuffer(raw, np.uint8, offset=1)
    if raw[:1] == b"8":
        return np.frombuffer(body.tobytes(), np.uint64)
    step = np.zeros(((len(body) - 8) // 6, 8), np.uint8)
    step[:, :6] = body[8:].reshape(-1, 6)
    return np.cumsum(np.concatenate([np.frombuffer(body[:8].tobytes(), np.uint64), step.view("<u8").ravel()]), dtype=np.uint64)


def _batches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One compressed row per batch of documents; deleted documents have batches of their own."""
    task, k = TaskContext.get().partitionId(), 0
    for batch in incoming:
        for away in (True, False):
            some = batch.filter(batch.column(2) if away else pa.compute.invert(batch.column(2)))
            for a, b in chunks(some.column(3), BATCH_BYTES):
                part = pa.Table.from_batches([some.slice(a, b - a)])
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + k]), pa.array([away]), pa.array([packed(part)], pa.binary())], ["batch", "away", "docs"])
                k += 1


def _ask(parts: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for incoming in rows:
            for batch, away, raw in zip(*(c.to_pylist() for c in incoming.columns), strict=True):
                docs = unpacked(raw)
                uni, bi, first = _tokens(docs.column("text").combine_chunks())
                learn = np.repeat(~docs.column("held").to_numpy().astype(bool), np.diff(first))
                for name, tokens in (("word", uni), ("pair", bi)):
                    keys, inv = np.unique(tokens, return_inverse=True)
                    train = np.bincount(inv, weights=learn, minlength=len(keys)).astype(np.int64)
                    cut = np.searchsorted(_part(keys, parts), np.arange(parts + 1))
                    have = np.flatnonzero(np.diff(cut)).tolist()
                    own = [(keys[cut[p] : cut[p + 1]], train[cut[p] : cut[p + 1]]) for p in have]
                    counts = [_small(t) for _, t in own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(have)), pa.array(have, pa.int32()), pa.array([batch] * len(have), pa.int64()), pa.array([_steps(k) for k, _ in own], pa.binary()), pa.array(counts, pa.binary()), pa.array(counts if away else [b""] * len(have), pa.binary())],
                        ["kind", "part", "batch", "keys", "train", "gone"],
                    )

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """Totals of one key range, for each batch in the order it asked; batch -1: tokens, distinct tokens, deleted tokens."""
    kind, part = asked.column("kind")[0].as_py(), asked.column("part")[0].as_py()
    batches = asked.column("batch").to_pylist()
    keys = [_keys(x) for x in asked.column("keys").to_pylist()]
    away = [len(x) > 0 for x in asked.column("gone").to_pylist()]
    known, inv = np.unique(np.concatenate(keys), return_inverse=True)
    each = [_counts(x) for x in asked.column("train").to_pylist()]
    train = np.bincount(inv, weights=np.concatenate(each), minlength=len(known)).astype(np.int64)
    lost = np.concatenate([x if gone else np.zeros_like(x) for x, gone in zip(each, away, strict=True)])
    gone = np.bincount(inv, weights=lost, minlength=len(known)).astype(np.int64)
    cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    own = [inv[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    totals = np.array([train.sum(), (train > 0).sum(), gone.sum()], np.int64)
    return pa.table(
        {
            "batch": pa.array([*batches, -1], pa.int64()),
            "kind": pa.array([kind] * (len(own) + 1)),
            "part": pa.array([part] * (len(own) + 1), pa.int32()),
            "train": pa.array([*(_small(train[i]) for i in own), totals.tobytes()], pa.binary()),
            "gone": pa.array([*(_small(gone[i]) if x else b"" for i, x in zip(own, away, strict=True)), b""], pa.binary()),
        }
    )


def _joined(batches: pa.Table, replies: pa.Table, deleted: bool):
    """Per token of a batch: counts of its bigram, its context and itself; kept counts if ``deleted``."""
    docs = unpacked(batches.column("docs")[0].as_py())
    uni, bi, first = _tokens(docs.column("text").combine_chunks())
    counts = {}
    replies = replies.sort_by("part")
    for kind, tokens in (("word", uni), ("pair", bi)):
        rows = replies.filter(pa.compute.equal(replies.column("kind"), kind))
        get = lambda name: np.concatenate([_counts(x) for x in rows.column(name).to_pylist()])  # noqa: B023, E731
        total = get("train") - (get("gone") if deleted else 0)
        counts[kind] = total[np.unique(tokens, return_inverse=True)[1]]
    word, pair = counts["word"], counts["pair"]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    ends = word[first[1:] - 1][:1]  # the end's count: it closes every text and is the context of the first word
    context[first[:-1]] = ends
    return docs, first, pair, context, word


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(BUCKETS - 1, np.log2(np.maximum(context, 1)).astype(np.int64) + 1), 0)


def _ratio(part: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _cell(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.minimum(CELLS - 1, (-STEPS * np.log2(np.maximum(p, 1e-300))).astype(np.int64) + 1), 0)


def _histogram(kept_tokens: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        _, _, pair, context, word = _joined(docs, replies, True)
        p2, p1 = _ratio(pair, context), _ratio(word, kept_tokens)
        cell = (_bucket(context) * CELLS + _cell(p2)) * CELLS + _cell(p1)
        found, inv = np.unique(cell, return_inverse=True)
        add = lambda x: np.bincount(inv, weights=x, minlength=len(found))
        return pa.table({"cell": found, "n": add(np.ones(len(cell))), "p2": add(p2), "p1": add(p1)})

    return run


def learn_weights(cell: np.ndarray, n: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bigram, word, uniform) of each context bucket, by expectation-maximisation.

    p2, p1: sums of the probabilities in a cell.  A bucket without held-out tokens keeps the weights of
    the nearest lower one that has some.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    bucket = cell // (CELLS * CELLS)
    probs = np.stack([p2 / n, p1 / n, np.full(len(n), p0)], axis=1) if len(n) else np.zeros((0, 3))
    seen = np.bincount(bucket, weights=n, minlength=BUCKETS)
    for _ in range(rounds):
        share = weights[bucket] * probs
        share *= (n / share.sum(axis=1))[:, None]
        for k in range(3):
            new = np.bincount(bucket, weights=share[:, k], minlength=BUCKETS)
            weights[:, k] = np.where(seen > 0, new / np.maximum(seen, 1), weights[:, k])
    for b in range(1, BUCKETS):
        if not seen[b]:
            weights[b] = weights[b - 1] if b > 1 else (1 / 3, 1 / 3, 1 / 3)
    weights = np.maximum(weights, [0, 0, 1e-6])  # unseen words keep some probability
    return weights / weights.sum(axis=1, keepdims=True)


def _score(tokens: int, distinct: int, weights: np.ndarray):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs, first, pair, context, word = _joined(docs, replies, False)
        base = np.log10((word + 0.1) / (tokens + 0.1 * (distinct + 1)))
        w = weights[_bucket(context)]
        mixed = np.log10(w[:, 0] * _ratio(pair, context) + w[:, 1] * _ratio(word, tokens) + w[:, 2] / (distinct + 1))
        add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has its end, so no row is empty
        n = np.diff(first)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held"),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(add((word > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(n), tokens), pa.int64()),
                "base_score": pa.array(add(base)),
                "score": pa.array(add(mixed)),
            }
        )

    return run


def lm_scores(docs: DataFrame, text: str = "text", id: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Per row: its id (as ``doc_id``), held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Training rows are those whose crc32 of the id as text, mod 10, isn't 0; remainder 1 is deleted while
    weights are learned.  Tokens are runs of anything but space and \\t-\\r, A-Z lower-cased, then one end.
    Null and empty texts are one end.  A null id counts as the empty text, so it is held out.  Repeated
    rows count and are scored one by one.  Without training rows scores come from the uniform part; an
    empty input gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "lm")
    kind = docs.schema[id].dataType.simpleString()
    left = F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % 10
    source = docs.select(F.col(id).alias("doc_id"), (left == 0).alias("held"), (left == 1).alias("deleted"), F.col(text).alias("text"))
    parts = parts or max(8, 2 * source.rdd.getNumPartitions())
    home = source.mapInArrow(_batches, "batch long, away boolean, docs binary")
    home.write.option("compression", "none").parquet(ws.path("home"))
    home = ws.read("home", home)
    asked = home.mapInArrow(_ask(parts), _ASKED)
    answers = asked.groupBy("kind", "part").applyInArrow(_answer, "batch long, kind string, part int, train binary, gone binary")
    answers.write.option("compression", "none").parquet(ws.path("answers"))
    answers = ws.read("answers", answers)
    totals = [np.frombuffer(r[0], np.int64) for r in answers.filter("batch = -1 AND kind = 'word'").select("train").collect()]
    tokens, distinct, gone = (int(x) for x in np.sum(totals, axis=0)) if totals else (0, 0, 0)
    replies = answers.filter("batch >= 0")
    away = home.filter("away")
    told = replies.join(away.select("batch"), "batch", "left_semi")
    cells = away.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_histogram(tokens - gone), "cell long, n double, p2 double, p1 double")
    held = cells.groupBy("cell").agg(F.sum("n"), F.sum("p2"), F.sum("p1")).orderBy("cell").collect()
    cell, n, p2, p1 = (np.array([r[k] for r in held], np.int64 if k == 0 else float) for k in range(4))
    weights = learn_weights(cell, n, p2, p1, 1 / (distinct + 1))
    shape = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return home.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(_score(tokens, distinct, weights), shape)
