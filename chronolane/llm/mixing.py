"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source gets a target in words; its documents, in a seeded random order and pass after pass, are
one stream that the target cuts off.  The stream is cut into blocks, and the exact block quotas of all
sources are split among output shards by a tree: each node draws, without replacement, how many blocks
of each source its left half gets.  A shard then owns a range of each source's permuted blocks, so
shards are disjoint, and orders its documents by a seeded hash.

Scale: nothing of a plan is held anywhere.  A multivariate draw is a chain of draws between halves of
the sources, each with a generator of its own node of both trees, so a task draws only what lies on the way from
the root to the blocks it has.  For that a source carries the blocks of the dyadic ranges of sources around
it, summed in Spark; sources and shards may be as many as they like.  The order of a source is a sort
by hash range: documents are dealt to sqrt(N) ranges per source, summed per range, and ordered only within a
range, so a source with most of the rows is spread like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.llm.base import Workspace, aside, fresh, or_empty
from chronolane.operators.sampling import global_row_number

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20240501
#: Blocks of a full shard; a block grows where there would be more than 2^29 of them, as numpy draws from fewer than 10^9.
SHARD_BLOCKS = 64
MOST_BLOCKS = 1 << 29
#: Draws and placed blocks that a task remembers.
MEMORY = 500_000
_WORD = r"[^\x20\x09-\x0D]+"
_PIECES = T.ArrayType(T.StructType([T.StructField("copy", T.IntegerType()), T.StructField("shard", T.LongType()), T.StructField("words", T.LongType())]))


class SplittingTree:
    """Which shard a block of a source goes to; every task that asks draws the same.

    ``lefts`` of a source are the blocks of the left halves of the dyadic ranges of sources that hold it,
    from all sources down to a pair; the bits of the source's number say on which side it lies.
    """

    def __init__(self, seed: int, shards: int, blocks: int):
        self.seed, self.shards, self.blocks = seed, shards, blocks
        self.drawn: dict[tuple[int, int, int, int], int] = {}
        self.placed: dict[tuple[int, int], int] = {}
        self.steps: dict[int, tuple[int, int]] = {}

    def _draw(self, lo: int, hi: int, level: int, node: int, left: int, right: int, many: int) -> int:
        """How many of ``many`` blocks that the left half of shards lo to hi gets are of the left half of a range of sources."""
        if not many or not left:
            return 0
        if not right or many == left + right:
            return min(many, left)
        key = (lo, hi, level, node)
        if key not in self.drawn:
            if len(self.drawn) >= MEMORY:
                self.drawn.clear()
            rng = np.random.Generator(np.random.PCG64([self.seed, *key]))
            self.drawn[key] = int(rng.hypergeometric(left, right, many))
        return self.drawn[key]

    def shard(self, source: int, lefts: list[int], at: int) -> int:
        """The shard of the block at place ``at`` of the source's permuted blocks."""
        depth, lo, hi = len(lefts), 0, self.shards
        right_side = [source >> (depth - 1 - d) & 1 for d in range(depth)]
        have = [self.blocks]
        for left, right in zip(lefts, right_side, strict=True):
            have.append(have[-1] - left if right else left)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            gets = [have[0] * (mid - lo) // (hi - lo)]
            for d, right in enumerate(right_side):
                left = have[d] - have[d + 1] if right else have[d + 1]
                some = self._draw(lo, hi, depth - d, source >> (depth - d), left, have[d] - left, gets[d])
                gets.append(gets[d] - some if right else some)
            if at < gets[-1]:
                have, hi = gets, mid
            else:
                at -= gets[-1]
                have, lo = [h - g for h, g in zip(have, gets, strict=True)], mid
        return lo

    def shard_of_block(self, source: int, lefts: list[int], quota: int, block: int) -> int:
        """The shard of a block of the source's stream, whose blocks are permuted by a step that has no factor in common with their number."""
        if (source, block) not in self.placed:
            if len(self.placed) >= MEMORY:
                self.placed.clear()
            if source not in self.steps:
                rng = np.random.Generator(np.random.PCG64([self.seed, source]))
                step, shift = int(rng.integers(1, max(2, quota))), int(rng.integers(quota))
                while math.gcd(step, quota) != 1:
                    step = step % (quota - 1) + 1
                self.steps[source] = step, shift
            step, shift = self.steps[source]
            self.placed[source, block] = self.shard(source, lefts, (block * step + shift) % quota)
        return self.placed[source, block]


def _targets(sources: DataFrame, weight: str, words: str, most: int) -> tuple[Column, int]:
    """The target of a source as an expression, and all words.

    Shares of the total by weight; a share above ``most`` times its size stops there and the excess is
    shared again among the others.  A round is one sum over sources, and shares only grow, so the sources that
    have stopped are those above the share of the round.
    """
    total, open_ = sources.agg(F.coalesce(F.sum(words), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0.0))).first()
    rest, stopped = float(total), 0
    while True:
        per = rest / open_ if open_ else 0.0
        over = F.lit(per) * F.col(weight) > F.col(words) * most
        now, held, left = sources.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col(words) * most)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col(weight))), F.lit(0.0))).first()
        if now == stopped:
            return F.when(over, (F.col(words) * most).cast("double")).otherwise(F.lit(per) * F.col(weight)), int(total)
        rest, open_, stopped = float(total - held), left, now


def _sources(sums: DataFrame, weights: tuple[float, ...], most: int, shard_words: int, ws: Workspace) -> tuple[DataFrame, int, int, int]:
    """Sources with number, target, take, quota (blocks) and lefts; the blocks of all, the shards, and a block's words."""
    numbered = global_row_number(sums, [F.col("source").asc_nulls_last()], "number").withColumn("number", F.col("number") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = ws.table(numbered.withColumn("weight", weight), "numbered")
    target, words = _targets(sources, "weight", "words", most)
    block = max(1, shard_words // SHARD_BLOCKS, -(-words // MOST_BLOCKS))
    take = F.rint("target").cast("long")
    sources = sources.withColumn("target", target).withColumn("take", take).withColumn("quota", F.ceil(F.col("take") / block).cast("long"))
    sources = ws.table(sources.select("source", "number", "words", "target", "take", "quota"), "sources")
    many, blocks = sources.agg(F.count("*"), F.coalesce(F.sum("quota"), F.lit(0))).first()
    depth = max(0, int(many) - 1).bit_length()
    node = lambda level: F.call_function("shiftright", F.col("number"), level.cast("int"))
    levels = sources.select("number", "quota", F.explode(F.sequence(F.lit(0), F.lit(max(0, depth - 1)))).alias("level"))
    nodes = ws.table(levels.groupBy("level", node(F.col("level")).alias("node")).agg(F.sum("quota").alias("blocks")), "nodes")
    wanted = levels.select("number", "level", (node(F.col("level") + 1) * 2).alias("node"))
    found = wanted.join(nodes, ["level", "node"]).groupBy("number").agg(F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("up"), "blocks"))).alias("found"))
    lefts = F.transform("found", lambda v: v["blocks"]) if depth else F.array().cast("array<bigint>")
    sources = ws.table(sources.join(found.select("number", lefts.alias("lefts")), "number"), "split")
    return sources, int(blocks), max(1, -(-words // shard_words)), block


def mix(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST,
    shard_words: int = 1_000_000,
    seed: int = SEED,
    with_text: bool = False,
) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and pieces (copy, shard, words).

    Sources, by code point with null last, weigh ``weights`` in turn and share the sum of all sizes; a
    target stops at ``most`` times its source's size.  A document's size is its number of words (runs of
    anything but space and \\t-\\r); null and empty texts have none and take no part.  The pieces' words
    of a source sum to its rounded target: only the document at the end of the stream is cut.  A source
    without words gets nothing.  Rows are ordered by a hash of seed, source, id and text, so reruns and
    other partitionings agree; equal rows are interchangeable.  An empty input gives an empty result.
    Input columns called like a result column are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "source_size", "target", "pieces")
    order, span, before, offset, total, of = fresh(docs, "order", "span", "before", "offset", "total", "of")
    ws = Workspace(spark, "mix")
    sized = docs.withColumn("size", F.regexp_count(or_empty(text), F.lit(_WORD)).cast("long")).withColumn(order, F.xxhash64(F.lit(seed), F.col(source), F.col(id), F.col(text)))
    sized = ws.table(sized if with_text else sized.drop(text), "sized")
    sums = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    found, blocks, shards, block = _sources(sums, weights, most, shard_words, ws)
    ranges = max(1, math.isqrt(sized.count()))
    held = found.select(F.struct("*").alias(of))
    number = F.col(f"{of}.number")
    placed = sized.join(held, F.col(source).eqNullSafe(F.col(f"{of}.source")))
    placed = placed.withColumn(span, (F.shiftright(F.col(order), 32) + F.lit(1 << 31)) * F.lit(ranges))
    placed = placed.withColumn(span, F.shiftright(F.col(span), 32).cast("int"))
    per = ws.table(placed.groupBy(number.alias("number"), F.col(span).alias("span")).agg(F.sum("size").alias("words")), "ranges")
    below = Window.partitionBy("number").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.struct("number", "span", F.coalesce(F.sum("words").over(below), F.lit(0)).alias("words")).alias(total))
    inside = Window.partitionBy(number, span).orderBy(order, F.col(id), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn(before, F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(per, (number == F.col(f"{total}.number")) & (F.col(span) == F.col(f"{total}.span")))
    rest = [c for c in sized.columns if c != order]
    schema = T.StructType([*(sized.schema[c] for c in rest), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("pieces", _PIECES)])
    kind = pa.list_(pa.struct([("copy", pa.int32()), ("shard", pa.int64()), ("words", pa.int64())]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = SplittingTree(seed, shards, blocks)
        for batch in batches:
            columns = (batch.column(k).to_numpy() for k in range(6))
            pieces = []
            for n, words, take, quota, at, size, lefts in zip(*(c.tolist() for c in columns), batch.column(6), strict=True):
                own = []
                for copy in range(most):
                    start = at + copy * words
                    if (taken := min(max(take - start, 0), size)) > 0:
                        own.append({"copy": copy, "shard": tree.shard_of_block(n, lefts.as_py(), quota, start // block), "words": taken})
                pieces.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[7:], pa.array(pieces, kind)], schema.names)

    names = fresh(sized, *[f"_c{k}" for k in range(7)])
    scalars = [number, *(F.col(f"{of}.{c}") for c in ("words", "take", "quota")), F.col(before) + F.col(f"{total}.words"), F.col("size"), F.col(f"{of}.lefts")]
    given = [c.alias(n) for c, n in zip(scalars, names, strict=True)]
    return placed.select(*given, *rest, F.col(f"{of}.words").alias(fresh(sized, "source_size")[0]), F.col(f"{of}.target").alias(fresh(sized, "target")[0])).mapInArrow(deal, schema)


def mixed_shards(docs: DataFrame, text: str = "text", id: str = "doc_id", seed: int = SEED, **options) -> DataFrame:
    """The mix itself: a row per piece, in seeded random order within each shard.

    The input's columns come first, with the piece's text in place of the document's; then size,
    source_size, target, copy, shard and words.  An input column of one of these names keeps its name and
    values, and the result column gets an underscore in front.  The piece at the end of a source's stream keeps its
    first ``words`` words, joined by spaces; every other piece is the whole text.  Documents without words,
    null and empty texts give no piece, a text of any length is one value of its row.  Repeated rows are
    documents each.  An empty input gives an empty result.
    """
    docs, back = aside(docs, "size", "source_size", "target", "pieces", "piece", "copy", "shard", "words")
    named = {new: old for old, new in back.items()}
    source = options.pop("source", "source")
    source = back.get(source, source)
    text_, id_ = back.get(text, text), back.get(id, id)
    found = mix(docs, text_, id_, source, seed=seed, with_text=True, **options)
    rows = found.withColumn("piece", F.explode("pieces")).select(*docs.columns, "size", "source_size", "target", "piece.*")
    cut = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(F.regexp_extract_all(text_, F.lit(_WORD), F.lit(0)), 1, F.col("words").cast("int")), " ")).otherwise(F.col(text_))
    rows = rows.withColumn(text_, cut)
    rows = rows.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed + 1), "shard", F.col(id_), "copy"), id_, "copy")
    own = ["size", "source_size", "target", "copy", "shard", "words"]
    names = [named.get(c, c) for c in docs.columns]
    taken = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)])
    return rows.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], *[F.col(c).alias(n) for c, n in zip(own, fresh(taken, *own), strict=True)])
