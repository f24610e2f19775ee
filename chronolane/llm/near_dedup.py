"""MinHash near-dedup by a signature-coordinate inverted join.

1. Each text becomes its set of word shingles and a signature of ``COORDINATES`` minima.  Documents
   with one set are collapsed to a class named by its smallest id.
2. Every (coordinate, value) pair posts the classes that have it.  A pair at or above the similarity
   threshold collides in at least ``needed(percent)`` coordinates except with a probability of ``MISS``,
   so with each class's pairs ordered from the rarest, two such classes share a pair within their first
   ``COORDINATES - needed + 1`` (the prefix).  Pairs that only one class has are skipped, and so is every
   class with fewer shared pairs than needed; of lists with the same members one is kept.
3. In each list a class's collisions with the classes of other components are counted coordinate stride
   by stride, and a class is skipped as soon as what is left can't reach the match threshold.  Pairs that
   reach it make candidate components; a list of several blocks is one as it stands, and a list within
   it isn't looked at.  A candidate component of one block is confirmed as a whole, so its texts travel
   once; in larger ones each class is confirmed in its longest list first, dealt in blocks in two ways.
4. In a block pairs with enough collisions are confirmed on the full shingle sets, and a confirmed link
   joins their components.  A block emits its joined components as stars, fewer rows than it has.
5. Lists of large candidate components that still lie in several components are confirmed next: those of
   one block whole, in others every class outside the list's largest component meets every class of the
   list, block by block.

Scale: counts, members and smallest ids of lists are partially aggregated before the shuffle; no list,
link or component is collected; a task holds two blocks, which are bounded by rows and by bytes of sets.
Texts travel only for classes of candidate components.  Work is quadratic only in classes of one list
that lie outside its largest component once each block is contracted; what is shuffled for them is
divided by the block size, and nothing is emitted for them but links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.base import Workspace
from chronolane.llm.components import components
from chronolane.llm.textscan import NON_SPACE, chunks, mix, scan

WORDS = 5
COORDINATES = 64
MISS = 1e-10  # chance that a pair at exactly the threshold collides in too few coordinates
STRIDE = 16
BLOCK = 1024
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 4 << 20

_rng = np.random.Generator(np.random.PCG64(77))
_MUL = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_ORDER = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    for a, b in chunks(column, CHUNK_BYTES):
        found = scan(column.slice(a, b - a), NON_SPACE)
        h = found.hashes()
        if len(h) >= words:
            rolled = np.zeros(len(h) - words + 1, np.uint64)
            for k in range(words):
                rolled += h[k : len(h) - words + 1 + k] * _ORDER[k]
            rolled = mix(rolled)
        for s, e in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
            if e - s >= words:
                yield np.unique(rolled[s : e - words + 1])
            elif e > s:
                yield mix((h[s:e] * _ORDER[: e - s]).sum(keepdims=True) ^ np.uint64(e - s))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One minimum per coordinate, as 32-bit values."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 256):  # small enough for a core's cache
        out = np.minimum(out, (shingles[k : k + 256, None] * _MUL + _ADD).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def _same(shingles: np.ndarray) -> bytes:
    """The class of a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, same, signs = [], [], []
        for s in shingle_sets(batch.column(1)):
            sizes.append(len(s))
            same.append(_same(s) if len(s) else None)
            signs.append(signature(s).tobytes() if len(s) else None)
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(signs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n", "same", "sign"])


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, cls, token) of each coordinate; a token is coordinate << 32 | value."""
    coords = np.arange(COORDINATES, dtype=np.int64) << 32
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            tokens = (_signs(part.column(2)).astype(np.int64) | coords).ravel()
            at = pa.array(np.repeat(np.arange(part.num_rows), COORDINATES))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in (0, 1)), pa.array(tokens)], ["rep", "cls", "token"])


def needed(percent: int) -> int:
    """Collisions asked of a pair: fewer have a probability of at most ``MISS`` at exactly ``percent``."""
    p, below, m = percent / 100, 0.0, 0
    while m < COORDINATES and (below := below + math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)) <= MISS:
        m += 1
    if m < 1:
        raise ValueError(f"percent = {percent}: too low for {COORDINATES} coordinates, such a pair may agree in none")
    return m


def forest(signs: np.ndarray, sets: list[np.ndarray] | None, label: np.ndarray, queries: np.ndarray, others: np.ndarray, matches: int, percent: int) -> None:
    """Join the components (``label``, changed in place) of ``queries`` with those of ``others``.

    Two rows are candidates if their signatures collide in at least ``matches`` coordinates, and linked if
    also 100 * intersection >= percent * union of their sets; without sets candidates count as linked.
    Pairs within a component aren't looked at.
    """
    if sets is not None:
        size = np.array([len(s) for s in sets])
        first = np.cumsum(size) - size
        item = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mark = np.zeros(len(item), bool)
    whole = queries is others
    for k, q in enumerate(queries.tolist()):
        alive = others[k + 1 :] if whole else others
        alive = alive[label[alive] != label[q]]
        if sets is not None:
            alive = alive[percent * np.maximum(size[alive], size[q]) <= 100 * np.minimum(size[alive], size[q])]
        hits = np.zeros(len(alive), np.int64)
        for c in range(0, COORDINATES, STRIDE):
            hits += (signs[alive, c : c + STRIDE] == signs[q, c : c + STRIDE]).sum(axis=1)
            reach = hits + (COORDINATES - STRIDE - c) >= matches
            alive, hits = alive[reach], hits[reach]
        if sets is None:
            label[np.isin(label, label[alive])] = label[q]
            continue
        alive = alive[np.argsort(-hits, kind="stable")]
        mark[item[first[q] : first[q] + size[q]]] = True
        while len(alive):
            some, alive = alive[:64], alive[64:]
            begin = np.cumsum(size[some]) - size[some]
            at = np.arange(int(size[some].sum())) + np.repeat(first[some] - begin, size[some])
            both = np.add.reduceat(mark[item[at]].astype(np.int64), begin)
            for x in some[100 * both >= percent * (size[q] + size[some] - both)].tolist():
                if label[x] != label[q]:
                    label[label == label[x]] = label[q]
            alive = alive[label[alive] != label[q]]
        mark[item[first[q] : first[q] + size[q]]] = False


def _joined(rows: pa.Table, matches: int, percent: int) -> pa.RecordBatch:
    """Stars (a, b) over the components that one block joins; a is the smallest."""
    comp = rows.column("comp").combine_chunks()
    signs, keep, sets = _signs(rows.column("sign")), np.arange(rows.num_rows), None
    if "text" in rows.column_names:
        sets = list(shingle_sets(rows.column("text").combine_chunks()))
        same = rows.column("same").to_pylist()
        keep = np.array([k for k, s in enumerate(sets) if len(s) and _same(s) == same[k]], np.int64)  # rows that repeat an id may hold other texts
        sets = [sets[k] for k in keep]
    names = comp.unique()
    names = names.take(pc.sort_indices(names))
    code = pc.index_in(comp, names).to_numpy()[keep]
    label, everyone = code.copy(), np.arange(len(keep))
    outside = rows.column("outside").to_numpy()[keep]
    queries, others = (np.flatnonzero(outside), np.flatnonzero(~outside)) if outside.any() else (everyone, everyone)
    if len(keep):
        forest(signs[keep], sets, label, queries, others, matches, percent)
    code, at = np.unique(code, return_index=True)
    _, first, back = np.unique(label[at], return_index=True, return_inverse=True)
    hub = code[first][back]
    return pa.RecordBatch.from_arrays([names.take(pa.array(x[hub != code])) for x in (hub, code)], ["a", "b"])


def _block_links(matches: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (token, i, j); a block may lie across batches."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in range(3)])
            last = [held[-1].column(c)[0].as_py() for c in range(3)] if held else key[:, 0].tolist()
            changed = np.any(key != np.concatenate([np.array(last).reshape(3, 1), key[:, :-1]], axis=1), axis=0)
            at = 0
            for cut in np.flatnonzero(changed).tolist():
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                yield _joined(pa.Table.from_batches(held), matches, percent)
                held, at = [], cut
            held.append(batch.slice(at))
        if held:
            yield _joined(pa.Table.from_batches(held), matches, percent)

    return run


def near_groups(docs: DataFrame, text: str = "text", id: str = "doc_id", percent: int = 75) -> DataFrame:
    """Every row's id (as ``doc_id``) with n_shingles, component_id and kept.

    Words are runs of anything but space and \\t-\\r, A-Z lower-cased; a text of fewer than five words is
    one shingle.  Documents are linked if 100 * intersection >= percent * union of their sets;
    component_id is the smallest id reachable.  Null, empty and blank texts have no shingles and are
    linked with nothing.  An id, of any type with an order, names one document: rows that repeat it share
    its links.  Rows with a null id get a null component_id and are kept.  Other columns, whatever their
    names, are not looked at.  A very long text is held whole with its set (8 bytes a shingle) in the
    block that it falls into.  An empty input gives an empty result.  A percentage so low that
    pairs may collide nowhere is refused.
    """
    matches = needed(percent)
    kind = docs.schema[id].dataType.simpleString()
    ws = Workspace(docs.sparkSession, "near")
    source = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    signed = ws.table(source.mapInArrow(_sign, f"id {kind}, n long, same binary, sign binary"), "signed")
    named = signed.filter("id IS NOT NULL AND same IS NOT NULL")
    classes = ws.table(named.groupBy("same").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sign").alias("sign")), "classes")

    classes = classes.withColumn("cls", F.xxhash64("same"))
    of_class = ["rep", "cls"]

    # postings: lists of one are skipped; each class keeps its rarest COORDINATES - matches + 1.  Joins
    # with postings or texts are merge joins at every size, so a small input is planned like a large one.
    posts = classes.select("rep", "cls", "sign").mapInArrow(_postings, f"rep {kind}, cls long, token long")
    lists = ws.table(posts.groupBy("token").agg(F.count("*").alias("posted")).filter("posted > 1"), "lists")
    shared = posts.join(lists.hint("merge"), "token").groupBy(of_class).agg(F.sort_array(F.collect_list(F.struct("posted", "token"))).alias("own"))
    prefix = F.transform(F.slice("own", 1, F.size("own") - (matches - 1)), lambda x: x["token"])
    placed = shared.filter(F.size("own") >= matches).join(classes.select("rep", "cls", "n"), of_class)
    placed = ws.table(placed.select("rep", "cls", "n", F.explode(prefix).alias("token")), "placed")
    # of lists with the same members one is kept
    digests = [F.bit_xor(F.xxhash64(F.lit(k), "rep", "cls")).alias(f"x{k}") for k in (0, 1)]
    members = placed.groupBy("token").agg(F.count("*").alias("rows"), F.sum("n").alias("items"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), *digests)
    members = members.filter("rows > 1").groupBy("rows", "items", "lo", "hi", "x0", "x1").agg(F.min("token").alias("token"))
    blocks = lambda rows, items: F.ceil(F.greatest(F.col(rows) / BLOCK, F.col(items) * 8 / BLOCK_BYTES)).cast("int")
    kept = ws.table(members.select("token", "lo", "rows", blocks("rows", "items").alias("blocks")), "kept")
    place = lambda n, *more: F.pmod(F.xxhash64("token", "rep", "cls", *more), n).cast("int")
    dealt = placed.join(kept, "token").select(*of_class, "n", F.struct("blocks", "rows", "token", "lo", place("blocks").alias("block")).alias("of"))
    # a row per class with its lists, so joins on the class give a row per class
    dealt = ws.table(dealt.groupBy(of_class).agg(F.first("n").alias("n"), F.collect_list("of").alias("lists"), F.max("of").alias("longest")), "dealt")
    ws.drop("lists", "placed", "kept")

    def joined(rows: DataFrame, name: str) -> DataFrame:
        """What the blocks (token, i, j) of rows join, written."""
        rows = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
        return ws.table(rows.mapInArrow(_block_links(matches, percent), f"a {kind}, b {kind}").distinct(), name)

    # candidate components: a list of several blocks joins its classes; in lists of one block that lie in
    # several such components collisions are counted
    single = F.explode(F.filter("lists", lambda x: x["blocks"] == 1)).alias("of")
    one = dealt.select(*of_class, F.when(F.col("longest.blocks") > 1, F.col("longest.lo")).otherwise(F.col("rep")).alias("comp"), single)
    one = ws.table(one.select("of.token", *of_class, "comp"), "one")
    several = one.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    one = one.join(several, "token", "left_semi").groupBy(*of_class, "comp").agg(F.collect_list("token").alias("tokens"))
    one = one.join(classes.select("rep", "cls", "sign"), of_class).withColumn("token", F.explode("tokens"))
    near = joined(one.select("token", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("outside"), "comp", "sign"), "near")
    several_blocks = dealt.select("rep", F.explode("lists").alias("of")).filter("of.blocks > 1 AND rep <> of.lo")
    near = near.union(several_blocks.select(F.col("of.lo").alias("a"), F.col("rep").alias("b")).distinct())
    family = components(near, ws, "family")
    active = ws.table(dealt.select("rep", "cls", "n").join(family.withColumnRenamed("node", "rep").withColumnRenamed("comp", "family"), "rep"), "active")
    families = active.groupBy("family").agg(F.count("*").alias("rows"), F.sum("n").alias("items"))
    families = families.select("family", (blocks("rows", "items") > 1).alias("large"))
    active = ws.table(active.join(families, "family"), "members")
    whole = active.filter("NOT large").select(F.xxhash64("family").alias("token"), F.lit(0).alias("i"), F.lit(0).alias("j"), *of_class)
    large = active.filter("large").select(*of_class, "family")
    turns = F.sequence(F.lit(0), F.when(F.col("blocks") > 1, 1).otherwise(0))
    parts = dealt.select(*of_class, "longest.*").join(large, of_class, "left_semi").withColumn("j", F.explode(turns)).select("token", place("blocks", "j").alias("i"), "j", *of_class)

    # confirmed on the texts of candidates; a class's text is that of its smallest id
    texts = source.withColumnRenamed("id", "rep").join(active.select("rep").distinct().hint("merge"), "rep", "left_semi")
    texts = texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["rep", "h"]).drop("h")
    texts = texts.join(classes.select("rep", "cls", "same", "sign").join(active.select(of_class), of_class, "left_semi").hint("merge"), "rep")
    texts = ws.table(texts, "texts")

    def confirmed(rows: DataFrame, name: str) -> DataFrame:
        where = rows.groupBy(of_class).agg(F.collect_list(F.struct("token", "i", "j", "outside", "comp")).alias("where"))
        return joined(where.join(texts.hint("merge"), of_class).select(F.explode("where").alias("at"), "same", "sign", "text").select("at.*", "same", "sign", "text"), name)

    links = confirmed(whole.union(parts).select("token", "i", "j", F.lit(False).alias("outside"), F.col("rep").alias("comp"), *of_class), "links")
    # rows that share an id but not a set tie their classes together
    ties = named.join(classes.select("same", "rep"), "same").filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    ties = ties.join(classes.select(F.col("rep").alias("a")).distinct(), "a", "left_semi")
    final = components(links.union(ties), ws, "first")

    # lists of large candidate components that still lie in several components
    large = large.join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    long = dealt.join(large, of_class).select(*of_class, "n", "comp", "family", F.explode("lists").alias("of")).select(*of_class, "n", "comp", "family", "of.*")
    long = ws.table(long.withColumn("token", F.xxhash64("token", "family")), "long")
    held = long.groupBy("token", "blocks", "comp").agg(F.count("*").alias("rows"))
    held = held.groupBy("token", "blocks").agg(F.sum("rows").alias("rows"), F.max("rows").alias("most"), F.max_by("comp", "rows").alias("largest")).filter("rows > most")
    outer = F.ceil((F.col("rows") - F.col("most")) / F.col("rows") * F.col("blocks")).cast("int")
    open_ = ws.table(held.select("token", "largest", outer.alias("outer")), "open")
    if not open_.isEmpty():
        long = long.join(open_, "token").withColumn("outside", F.col("comp") != F.col("largest"))
        every = long.select("token", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("i"), F.col("block").alias("j"), F.lit(False).alias("outside"), "comp", *of_class)
        queries = long.filter("outside AND blocks > 1").select("token", place("outer").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "outside", "comp", *of_class)
        final = components(links.union(ties).union(confirmed(every.union(queries), "more_links")), ws, "final")
    ws.drop("dealt", "one", "near", "active", "members", "texts", "long", "open")
    all_ = signed.join(classes.select("same", "rep"), "same", "left").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "rep", "id"))
    return all_.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", percent: int = 75) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id."""
    gone = near_groups(docs, text, id, percent).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id] == gone["_gone"], "left_anti")
