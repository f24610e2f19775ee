"""Fill-in-the-middle, packing and vector codes against brute force, with every odd case."""

import collections
import hashlib
import itertools
import json
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronolane.llm import bin_completion, packing, queries
from chronolane.llm.automaton import Automaton, line_units, matcher, running, utf8_units, value_of
from chronolane.llm.fill_in_middle import Rule, fill_in_middle, restored
from chronolane.llm.packing import pack, packed_sequences
from chronolane.llm.vector_codes import codebooks_sha256, nearest, vector_codes

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["plain words ", "ünïcödé ", "日本語", "😀", "<", "P>", "<S", "<M>", "<P>", "\n", "x", "<<", ">"]


def texts():
    rng = random.Random(8)
    out = ["".join(rng.choices(PIECES[:6], k=rng.randint(1, 60))) for _ in range(60)]
    out += ["".join(rng.choices(PIECES, k=rng.randint(1, 30))) for _ in range(40)]
    return [*out, "", None, "a", "é", "😀", "<P", "x" * 5000, "日" * 3000 + "<M>", out[0], out[0]]


def rows():
    found = [(k, t) for k, t in enumerate(texts())]
    return [*found, found[1], found[1], (None, "without an id")]


def by_hand(id, text, rule):
    t = text or ""
    h = hashlib.sha256(f"{rule.seed}:{'' if id is None else id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(m in t for m in rule.marks()) or h3 % 100 >= rule.cut:
        return len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < rule.spm:
        return len(t), "spm", a, b - a, rule.suffix + s + rule.prefix + p + rule.middle + m
    return len(t), "psm", a, b - a, rule.prefix + p + rule.suffix + s + rule.middle + m


@pytest.mark.parametrize("size", [1, 2, 5, 64])
def test_chunks_compose_to_the_whole(size):
    auto = Automaton.make(utf8_units(), matcher([b"<P>", b"<S>", b"<M>"]))
    for t in texts():
        raw = (t or "").encode()
        chunks = [raw[k : k + size] for k in range(0, len(raw), size)]
        scans = [auto.scan(c) for c in chunks]
        states, before, marks = running([s.function() for s in scans])
        assert (before[-1], marks > 0) == (len(t or ""), any(m in (t or "") for m in ("<P>", "<S>", "<M>")))
        if t:
            for k in {1, len(t) // 2, len(t)} - {0}:
                no = int(np.searchsorted(before, k, "left")) - 1
                assert no * size + scans[no].select(states[no], k - before[no]) == len(t[:k].encode())


def test_other_units_and_overlapping_words():
    lines = Automaton.make(line_units(), matcher([b"aa", b"aab"]))
    assert value_of(int(lines.scan(b"aaab\n\nx").function()[0]))[1:] == (2, 3)
    assert lines.scan(b"ab\ncd\n").select(0, 2) == 6


@pytest.mark.parametrize("chunk", [3, 16, 1 << 16])
def test_fill_in_middle(spark, chunk):
    docs = spark.createDataFrame([(i, t, "mine", k) for k, (i, t) in enumerate(rows())], "doc_id long, text string, key string, no int").repartition(3)
    rule = Rule()
    out = fill_in_middle(docs, rule=rule, chunk_bytes=chunk).withColumn("again", restored(F.col("output"), F.col("form")))
    got = {r.no: r for r in out.collect()}
    assert len(got) == len(rows()) and out.columns[:4] == ["doc_id", "text", "key", "no"]
    for k, (i, t) in enumerate(rows()):
        r = got[k]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(i, t, rule) and r.again == (t or "") and r.key == "mine" and r.text == t
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_fill_in_middle_edges(spark):
    docs = spark.createDataFrame([(1, "abc", 5)], "doc_id long, text string, lo int")
    assert fill_in_middle(docs.limit(0)).count() == 0
    assert fill_in_middle(docs).columns == ["doc_id", "text", "lo", "n", "form", "prefix_chars", "middle_chars", "output"]
    rule = Rule("[pre]", "[suf]", "[mid]", cut=100, spm=50, seed=7)
    many = spark.createDataFrame([(k, f"text <P> number {k}") for k in range(40)], "doc_id long, text string")
    for r in fill_in_middle(many, rule=rule).withColumn("again", restored(F.col("output"), F.col("form"), rule)).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, r.text, rule) and r.again == r.text
    for bad in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("aba", "x", "y"), ("ab", "bc", "z"), ("abc", "b", "z")):
        with pytest.raises(ValueError):
            Rule(*bad)


def test_a_very_long_text_is_cut_by_chunks(spark):
    text = "".join(random.Random(1).choices(PIECES[:4], k=900_000))  # some 7 MB
    docs = spark.createDataFrame([(1, text), (2, text[::-1]), (3, "short")], "doc_id long, text string")
    for r in fill_in_middle(docs).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, r.text, Rule())


# --- packing ---------------------------------------------------------------------------------------


def fewest(sizes, capacity):
    """The least number of bins, by trying everything."""
    sizes, best = sorted(sizes, reverse=True), len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[k]:
                rest = list(rooms)
                rest.remove(room)
                place(k + 1, [*rest, room - sizes[k]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


def used(patterns, capacity):
    out = np.zeros(capacity + 1, np.int64)
    for items, n in patterns:
        assert sum(items) <= capacity and n > 0
        for s in items:
            out[s] += n
    return out


@pytest.mark.parametrize("seed", range(40))
def test_bin_completion_finds_the_fewest(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 50, 100])
    sizes = [rng.randint(1, capacity) if seed % 2 else rng.randint(capacity // 5, capacity // 2) for _ in range(11)]
    counts = np.bincount(sizes, minlength=capacity + 1)
    patterns, bound = bin_completion.complete(counts)
    assert (used(patterns, capacity) == counts).all()
    assert bound <= fewest(sizes, capacity) == sum(n for _, n in patterns)


def test_bin_completion_beats_best_fit_and_takes_large_counts():
    rng = np.random.default_rng(2)
    a, b = rng.integers(260, 400, 100), rng.integers(260, 400, 100)
    triples = np.bincount(np.concatenate([a, b, 1024 - a - b]), minlength=1025)
    fit = sum(n for _, n in bin_completion.best_fit(triples))
    found, bound = bin_completion.complete(triples)
    assert bound == 100 and (used(found, 1024) == triples).all() and sum(n for _, n in found) <= min(fit - 5, 104)
    many = np.bincount(rng.integers(1, 1025, 5000), minlength=1025) * 1_000_000_000
    found, bound = bin_completion.complete(many)
    assert (used(found, 1024) == many).all() and sum(n for _, n in found) <= 1.005 * bound
    assert sum(n for _, n in found) <= sum(n for _, n in bin_completion.best_fit(many))
    assert bin_completion.complete(np.zeros(11, int))[0] == []


def test_best_fit_is_best_fit():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.randint(1, 30) for _ in range(40)]
        rooms = []
        for s in sorted(sizes, reverse=True):
            fit = [r for r in rooms if r >= s]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else 30) - s)
        counts = np.bincount(sizes, minlength=31)
        found = bin_completion.best_fit(counts)
        assert (used(found, 30) == counts).all() and sum(n for _, n in found) == len(rooms)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


def wordy():
    rng = random.Random(3)
    words = ["the", "packing", "Ünïted", "日本", "don't", "we'll", "12345", "x y", "a\xa0b", "\x1c", "\x85", "<|endoftext|>", "  ", "\n\n", "😀", "!?", "²³", "᠎", "é"]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(120)]
    return [*out, "", None, "<|endoftext|>", "word " * 9000, out[0], out[0]]


def test_ids_are_the_librarys(library):
    reader = packing.TokenIds(VOCAB, room=50)
    for t in wordy():
        assert np.frombuffer(reader.ids(t or ""), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids
    every = "".join(f"a{chr(c)}1 {chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000)
    assert np.frombuffer(reader.ids(every), "<u4").tolist() == library.encode(every, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing(spark, library, capacity):
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(wordy())] + [(0, wordy()[0], "mine")], "doc_id long, text string, size string").repartition(3)
    out = pack(docs, VOCAB, capacity=capacity)
    assert out.columns == ["doc_id", "size", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got, want, full = out.collect(), collections.Counter(), collections.defaultdict(list)
    sizes = []
    for i, t in [*enumerate(wordy()), (0, wordy()[0])]:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        over = len(ids) % capacity or capacity
        for p, (a, b) in enumerate(itertools.pairwise([0, *range(over, len(ids) + 1, capacity)])):
            want[i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
            sizes.append(b - a)
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        full[r.sequence_id].append((r.offset, r.length))
        assert r.size == "mine"
    for held in full.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= capacity
    assert sorted(full) == list(range(len(full)))
    assert len(full) <= sum(n for _, n in bin_completion.best_fit(np.bincount(sizes, minlength=capacity + 1)))
    assert len(full) <= bin_completion.least_bins(np.bincount(sizes, minlength=capacity + 1)) + 1


def test_packed_sequences(spark, library):
    docs = spark.createDataFrame(list(enumerate(wordy())), "doc_id long, text string")
    texts = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(wordy())}
    seen = collections.Counter()
    for r in packed_sequences(docs, VOCAB, capacity=256).collect():
        assert len(r.ids) <= 256 and sum(p.length for p in r.pieces) == len(r.ids)
        for p in r.pieces:
            over = len(texts[p.id]) % 256 or 256
            start = over + 256 * (p.piece - 1) if p.piece else 0
            assert r.ids[p.offset : p.offset + p.length] == texts[p.id][start : start + p.length]
            seen[p.id] += p.length
    assert seen == {i: len(t) for i, t in texts.items()}
    assert pack(docs.limit(0), VOCAB).count() == 0
    nulls = spark.createDataFrame([(None, None, None), (None, None, None)], "doc_id long, text string, sequence_id string")
    assert [(r.length, r.sequence_id) for r in pack(nulls, VOCAB).collect()] == [(1, 0), (1, 0)]


def test_a_size_that_most_pieces_have_is_ranked_in_groups(spark):
    docs = spark.createDataFrame([(k, "same text" if k % 3 else f"text number {k}") for k in range(3000)], "doc_id long, text string")
    got = pack(docs, VOCAB, capacity=32).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 3000
    sizes = np.bincount([r.length for r in got], minlength=33)
    assert len({r.sequence_id for r in got}) == sum(n for _, n in bin_completion.complete(sizes)[0])


def test_other_vocabularies_are_encoded_whole():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    reader, whole = packing.TokenIds(path), Tokenizer.from_file(path)
    assert reader.pattern is None
    for t in ("Some Words", "", "ÉÉ <|endoftext|> x"):
        assert np.frombuffer(reader.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


# --- vector codes ----------------------------------------------------------------------------------


def codes_by_hand(rows, parts, entries, rounds, scale=256):
    kept = [(i, [math.floor(scale * float(x)) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def near(v, book):
        far = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            mine = collections.defaultdict(list)
            for _, v, _ in kept:
                mine[near(cut(v, p), books[p])[0]].append(cut(v, p))
            books[p] = [[sum(c) // len(mine[e]) for c in zip(*mine[e], strict=True)] if e in mine else old for e, old in enumerate(books[p])]
    out, per = [], collections.Counter()
    for i, v, g in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{c:02x}" for c, _ in found), sum(e for _, e in found), g))
        per[g] += out[-1][2]
    return sorted(((i, c, e, per[g]) for i, c, e, g in out), key=repr), books


def vectors():
    rng = random.Random(6)
    rows = [(k, [rng.choice([-0.51, -0.25, 0.0, 0.1, 0.3, 0.7]) for _ in range(8)], rng.choice([1, 2, None])) for k in range(150)]
    rows += [(200 + k, rows[3][1], 1) for k in range(70)]  # a vector that a third of all rows have
    rows += [(k, rows[k][1], rows[k][2]) for k in (5, 5, 9)]  # repeated rows
    return rows, [(500, None, 1), (501, [None] + [0.0] * 7, 1), (502, [math.nan] + [0.0] * 7, 1), (503, [math.inf] + [0.0] * 7, 1), (504, [], 1), (505, [0.1] * 7, 1), (506, [0.1] * 16, 1)]


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 16, 2), (8, 64, 1), (1, 5, 3), (2, 400, 2)])
def test_vector_codes(spark, parts, entries, rounds):
    rows, bad = vectors()
    if parts == 1:
        bad = [r for r in bad if not r[1] or len(r[1]) != 7]
    df = spark.createDataFrame([(*r, "mine", 7) for r in rows + bad], "vec_id long, embedding array<float>, label int, row string, pos int").repartition(5)
    found, books = vector_codes(df, parts=parts, entries=entries, rounds=rounds)
    assert found.columns == ["vec_id", "label", "row", "pos", "code", "error", "label_error"]
    want, hand = codes_by_hand([(i, None if v is None else np.float32(v).tolist(), g) for i, v, g in rows], parts, entries, rounds)
    assert books.tolist() == hand
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found.collect()), key=repr) == want
    assert codebooks_sha256(books) == hashlib.sha256(",".join(str(x) for p in hand for e in p for x in e).encode()).hexdigest()


def test_vector_codes_edges(spark):
    df = spark.createDataFrame([(None, [0.5] * 4, None), (None, [0.25] * 4, None), (3, [1.0] * 4, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes(df.limit(0), parts=2)[0].count() == 0
    found, books = vector_codes(df, parts=2, entries=2, rounds=0)
    assert books.tolist() == [[[256, 256], [64, 64]]] * 2  # ids in order, missing ones last
    assert sorted((r.code, r.label_error) for r in found.collect()) == [("0000", 0), ("0101", 4 * 64**2), ("0101", 4 * 64**2)]
    with pytest.raises(Exception, match="beyond"):
        vector_codes(spark.createDataFrame([(1, [1e30] * 4, 1)], "vec_id long, embedding array<float>, label int"), parts=2)[0].count()


def test_ties_go_to_the_lower_entry():
    code, error = nearest(np.array([[0, 0], [4, 0]]), np.array([[1, 0], [-1, 0], [4, 0], [4, 0]]))
    assert code.tolist() == [0, 2] and error.tolist() == [1, 0]


def test_new_queries_are_registered():
    names = [n for n in queries.QUERIES if int(n[2:].split("_")[0]) > 10]
    assert names == ["op11_fill_in_middle", "op12_packing", "op13_vector_codes"]
    assert json.dumps(sorted(set(names) & set(queries.ORACLE_SQL))) == '["op11_fill_in_middle", "op13_vector_codes"]'


def test_missing_words_are_merged_by_the_model_alone(monkeypatch):
    """op12's finding: what the library does around the merges costs more than they do, and was paid for every new word."""

    reader = packing.TokenIds(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Don't  naïve\n\n Ωmega 日本語 12345 x" + "".join(map(chr, range(33, 0x250))) + " 🙂🙂!?\t\x00 \xad"
    words = [w for w in reader.pattern.findall(text) if all(map(reader._same, w))]
    assert len(words) > 20 and all(reader._word(w) == reader._ids(w) for w in words)
    called = []
    monkeypatch.setattr(reader, "_ids", lambda t: called.append(t) or b"")
    assert reader.ids("twelve brand new words, each of which is met here once") and not called
