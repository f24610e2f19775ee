"""Operators for training data against brute force, on small documents with every odd case."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolane.llm import chat, interpolated_lm, mixing, warc
from chronolane.llm import decontaminate as decontaminate_module
from chronolane.llm.decontaminate import contamination, decontaminate
from chronolane.llm.exact_dedup import exact_dedup, exact_groups
from chronolane.llm.fm_index import FMIndex
from chronolane.llm.interpolated_lm import learn_weights, lm_scores
from chronolane.llm.line_dedup import line_dedup
from chronolane.llm.near_dedup import near_dedup, near_groups
from chronolane.llm.textscan import ALNUM, NON_SPACE, scan
from chronolane.llm.token_counts import PairCounter, token_counts
from chronolane.llm.toxicity import Model, WordTable, fit, normalise, score_texts, toxicity, train

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDY = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(60)] + ["Émile", "naïve", "日本語", "x\x85y", "a\xa0b", "UPPER", "mid-dash", "end."]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 120))) for _ in range(60)]
    out = list(base)
    for t in base[:25]:
        out.append(t)  # exact copies
        w = t.split(" ")
        for _ in range(3):  # near copies and nearer ones
            v = list(w)
            for _ in range(max(1, len(v) // rng.choice([8, 20, 40, 60]))):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            out.append(" ".join(v))
    block = "\n".join(" ".join(rng.choices(vocab, k=6)) for _ in range(4))
    out += [f"{a}\n{block}\n{b}" for a, b in zip(base[:8], base[8:16], strict=True)] + [block, "one\ntwo", "\n\n\n\n", "a\nb\nc\na\nb\nc\na\nb\nc"]
    out += ["", None, " \t\r\n\x0b\x0c ", "word", "x" * 5000, "\x1c", "q q q q q q q q q", " ".join(rng.choices(vocab, k=6000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(3 * k + 1, t, "en", f"src{k % 4}" if k % 9 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (rows[1][0], rows[1][1], "en", "src1", 0)]  # repeated rows
    return spark.createDataFrame(rows, DOCS).repartition(5)


def collected(df, key="doc_id"):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


def empty(docs):
    return docs.limit(0)


# --- words -----------------------------------------------------------------------------------------


def test_scan_cuts_words_like_the_patterns(texts):
    column = pa.array(texts, pa.string()).slice(3)
    for cls, pattern in ((NON_SPACE, SPACED), (ALNUM, WORDY)):
        found = scan(column, cls)
        h = found.hashes()
        seen = {}
        for k, t in enumerate(texts[3:]):
            want = pattern.findall(low(t or ""))
            span = range(found.first[k], found.first[k + 1])
            assert [found.data[found.start[i] : found.end[i]].tobytes().decode() for i in span] == want
            for i, w in zip(span, want, strict=True):
                assert seen.setdefault(w, h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)


# --- 9 exact dedup ---------------------------------------------------------------------------------


@pytest.mark.parametrize("keep, pick", [("max", max), ("min", min)])
def test_exact_groups(docs, keep, pick):
    got = exact_groups(docs.withColumn("kept", F.lit("clash")), keep=keep, first_bytes=4, growth=3).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = sorted((i, pick(groups[t]), len(groups[t]), i == pick(groups[t])) for i, t in rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
    assert exact_groups(empty(docs)).count() == 0


def test_exact_dedup_with_null_and_shared_ids(spark):
    rows = [(None, "a"), (5, "a"), (None, "b"), (None, "b"), (7, "ax"), (7, "bx"), (8, "ax")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(df, first_bytes=1, growth=2).collect()), key=str)
    assert got == sorted([(None, 5, 2, False), (5, 5, 2, True), (None, None, 2, True), (None, None, 2, True), (7, 8, 2, False), (8, 8, 2, True), (7, 7, 1, True)], key=str)
    assert exact_dedup(df).columns == df.columns


# --- 3 line dedup ----------------------------------------------------------------------------------


def brute_lines(rows, n=3):
    seen, out = {}, {}
    for i, t in sorted({(i, t or "") for i, t in rows}):
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - n + 1):
            w = tuple(lines[k : k + n])
            if seen.setdefault(w, (i, k, t)) != (i, k, t):
                gone |= set(range(k, k + n))
        out[i, t] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def test_line_dedup(docs):
    got = line_dedup(docs.withColumn("n_lines", F.lit("clash")).withColumn("digest", F.lit(1))).join(docs.select(F.col("doc_id").alias("k"), F.col("text").alias("was")).distinct(), F.col("doc_id") == F.col("k")).collect()
    want = brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert len(got) == docs.count() and sum(r.n_removed for r in got) > 20
    for r in got:
        text, gone = want[r.doc_id, r.was or ""]
        assert (r.text or "", r.n_removed) == (text, gone) and (r.text is None) == (r.was is None)
    assert line_dedup(empty(docs)).count() == 0


# --- 4 near dedup ----------------------------------------------------------------------------------


def shingles(t):
    w = SPACED.findall(low(t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, percent=75):
    sets = collections.defaultdict(set)
    for i, t in rows:
        sets[i].add(shingles(t))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(s and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_near_groups(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_components(rows)
    got = near_groups(docs.withColumn("rep", F.lit(1)).withColumn("kept", F.lit(2))).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == sorted((i, want[i], want[i] == i) for i, _ in rows)
    n = {r.doc_id: r.n_shingles for r in got}
    assert all(n[i] == len(shingles(t)) for i, t in rows)
    assert len(set(want.values())) < len(want) - 20  # there is something to find


def test_near_dedup_keeps_one_of_a_hot_group(spark):
    rng = random.Random(9)
    words = [f"t{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for k in range(250):
        v = list(words)
        for _ in range(rng.randint(0, 4)):
            v[rng.randrange(120)] = f"u{rng.randrange(10**6)}"
        rows.append((k + 5, " ".join(v)))
    rows += [(None, rows[0][1]), (1000, ""), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components([r for r in rows if r[0] is not None])
    got = {r.doc_id: r.component_id for r in near_groups(df).collect() if r.doc_id is not None}
    assert got == want
    left = near_dedup(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i in want if want[i] == i} | {None}
    assert near_groups(df.limit(0)).count() == 0


# --- 10 decontamination ----------------------------------------------------------------------------


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(2)
    seq = np.append(rng.integers(0, 6, 400), 0)
    index = FMIndex(seq, 5, sample=4)
    for n in (1, 2, 3, 5):
        patterns = rng.integers(1, 6, (60, n))
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi, strict=True):
            want = [k for k in range(len(seq) - n + 1) if (seq[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_contamination(spark, docs, texts):
    words = [WORDY.findall(low(t or "")) for t in texts]
    items = [(10, " ".join(words[3][:20]).upper()), (11, " ".join(words[5][2:15])), (2, " ".join(words[5][2:15])), (12, "w1 w2"), (13, ""), (14, None), (15, "w7"), (16, " ".join(words[-1][100:160])), (None, "w3 w4")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_words string")
    got = contamination(docs.withColumn("items", F.lit(1)), bench).collect()
    blocks = contamination(docs, bench, shard_bytes=500).collect()
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORDY.findall(low(t or ""))
        for k in range(max(1, len(w) - 12) if w and i is not None else 0):
            windows[tuple(w[k : k + 13])].add(i)
    want = {}
    for r in docs.collect():
        w, hit, named = WORDY.findall(low(r.text or "")), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    named |= windows[tuple(w[k : k + n])]
        want[r.doc_id] = (len(w), len(hit), sorted(named, key=str), bool(hit) and 20 * len(hit) >= len(w))
    for rows in (got, blocks):
        assert len(rows) == docs.count()
        for r in rows:
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == want[r.doc_id]
            assert sum(s.end_word - s.first_word for s in r.spans) == r.n_hit
    assert decontaminate(docs, bench).columns == docs.columns
    assert contamination(docs, bench.limit(0)).filter("contaminated OR n_hit > 0").count() == 0
    assert contamination(empty(docs), bench).count() == 0
    named = contamination(docs, bench.withColumn("item_id", F.concat(F.lit("item "), "item_id"))).collect()
    assert all(r["items"] == [f"item {i}" for i in want[r.doc_id][2]] and r.n_hit == want[r.doc_id][1] for r in named)


def test_contamination_by_a_benchmark_larger_than_the_filter(spark, monkeypatch):
    """20 MB of benchmark past a filter that is full: the same hits, and the filter's size is what is broadcast."""
    monkeypatch.setattr(decontaminate_module, "FILTER_WORDS", 64)
    rng = random.Random(6)
    passages = [" ".join(f"p{k}q{rng.randrange(10**6)}" for k in range(30)) for _ in range(40)]
    docs = spark.createDataFrame([(k, " ".join(f"d{rng.randrange(10**6)}" for _ in range(20)) + " " + (passages[k] if k % 2 else "")) for k in range(40)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    padding = spark.range(1000, 41000).select(F.col("id").alias("item_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.substring(F.sha2((F.col("id") * 64 + k).cast("string"), 224), 1, 12)), " ").alias("text"))
    got = contamination(docs, bench.unionByName(padding)).collect()
    assert all((r.n_hit, r["items"], r.contaminated) == ((30, [r.doc_id], True) if r.doc_id % 2 else (0, [], False)) for r in got) and len(got) == 40


# --- 6 token counts --------------------------------------------------------------------------------


def test_token_counts(docs, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), PairCounter(path, room=50)
    odd = ["a<|endoftext|>B <|startoftext|><|endoftext|>x", "ΑΣ ΟΔΟΣ İstanbul", "it's we'll I'M don’t ½ ² Ⅷ 123\x1c4\x855", "é ́ ﬁ 👩‍👩‍👧", "<|endof text|>", "�\x00\x01"]
    for t in [*texts, *odd]:
        assert own.count(t or "") == len(library.encode(t or "", add_special_tokens=False).ids), t
    for r in token_counts(docs.withColumn("size", F.lit(1)), path, limit=100).join(docs.select("doc_id", F.col("text").alias("t")).distinct(), "doc_id").collect():
        assert r.n_bytes == len((r.t or "").encode()) and r.n_tokens == own.count(r.t or "") and r.over_limit == (r.n_tokens > 100)
    assert token_counts(empty(docs), path).count() == 0


# --- 7 language model ------------------------------------------------------------------------------


def test_lm_scores(docs):
    got = lm_scores(docs.withColumn("batch", F.lit(1)), parts=3).collect()
    rows = [(r.doc_id, SPACED.findall(low(r.text or "")) + [None]) for r in docs.collect()]
    left = lambda i: zlib.crc32(str(i).encode()) % 10
    train_rows = [w for i, w in rows if left(i) != 0]
    c = collections.Counter(x for w in train_rows for x in w)
    n, v = sum(c.values()), len(c)
    own = collections.defaultdict(list)
    for i, w in rows:
        own[i].append((len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known) in {o[:2] for o in own[r.doc_id]} and r.train_tokens == n and r.held_out == (left(r.doc_id) == 0)
        assert any(r.base_score == pytest.approx(o[2], rel=1e-9) for o in own[r.doc_id])
        assert math.isfinite(r.score) and r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scores(empty(docs)).count() == 0


def brute_model(rows, left, weights=None):
    """Scores by direct counting; weights by EM over single tokens where none are given."""

    def counts(some):
        return collections.Counter(x for w in some for x in w), collections.Counter(p for w in some for p in zip([None, *w], w, strict=False))

    def parts(one, two, w):
        n = sum(one.values())
        return [(one[a], two[a, b] / max(1, one[a]), one[b] / max(1, n)) for a, b in zip([None, *w], w, strict=False)]

    bucket = lambda c: min(15, int(math.log2(c)) + 1) if c else 0
    one, two = counts([w for i, w in rows if left(i) != 0])
    floor = 1 / (len(one) + 1)
    if weights is None:
        kept = counts([w for i, w in rows if left(i) > 1])
        seen = collections.defaultdict(list)
        for w in (w for i, w in rows if left(i) == 1):
            for c, p2, p1 in parts(*kept, w):
                seen[bucket(c)].append((p2, p1, floor))
        weights = np.full((16, 3), 1 / 3)
        weights[0] = 0, 0.5, 0.5
        for b, probs in seen.items():
            probs = np.array(probs)
            for _ in range(60):
                share = weights[b] * probs
                weights[b] = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        for b in range(1, 16):
            if b not in seen:
                weights[b] = weights[b - 1] if b > 1 else 1 / 3
        weights = np.maximum(weights, [0, 0, 1e-6])
        weights /= weights.sum(axis=1, keepdims=True)
    return [(i, sum(math.log10(weights[bucket(c)] @ [p2, p1, floor]) for c, p2, p1 in parts(one, two, w))) for i, w in rows], weights


def test_lm_score_equals_direct_counting(docs, monkeypatch):
    rows = [(r.doc_id, SPACED.findall(low(r.text or "")) + [None]) for r in docs.collect()]
    left = lambda i: zlib.crc32(str(i).encode()) % 10
    learned = []
    real = interpolated_lm.learn_weights
    monkeypatch.setattr(interpolated_lm, "learn_weights", lambda *a: learned.append(real(*a)) or learned[-1])
    monkeypatch.setattr(interpolated_lm, "BATCH_BYTES", 1 << 20)
    got = collections.defaultdict(list)
    for r in lm_scores(docs, parts=3).collect():
        got[r.doc_id].append(r.score)
    same, _ = brute_model(rows, left, learned[0])
    assert all(any(x == pytest.approx(want, rel=1e-9) for x in got[i]) for i, want in same)
    # cells of a quarter octave instead of single tokens change the weights little
    exact, weights = brute_model(rows, left)
    assert np.abs(weights - learned[0]).max() < 0.05
    assert all(any(x == pytest.approx(want, rel=0.02) for x in got[i]) for i, want in exact)


def test_lm_keys_travel_whole():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 100_000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        if n:
            assert (interpolated_lm._keys(interpolated_lm._steps(keys)) == keys).all()
    near = np.uint64(2**63) + np.cumsum(rng.integers(1, 2**40, 1000, dtype=np.uint64))
    assert len(interpolated_lm._steps(near)) == 9 + 999 * 6 and (interpolated_lm._keys(interpolated_lm._steps(near)) == near).all()


def test_weights_find_the_better_part():
    cell = np.array([((5 * 177) + 10) * 177 + 60])
    w = learn_weights(cell, np.array([1000.0]), np.array([200.0]), np.array([1.0]), 1e-6)
    assert w[5, 0] > 0.99 and np.allclose(w.sum(axis=1), 1) and w[0, 0] == 0


# --- 8 chat ----------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(1)
    parts = ["<", "s", ">", "/", "[", "INST", "]", "<<", "SYS", ">>", chat.ESCAPE, "0", "1", "\n", "</s>", "[INST]", "[/INST]", "<<ROLE>>", "<<END>>"]
    say = lambda: "".join(rng.choices(parts, k=rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", "a<s>"]), say()) for c in range(80) for t in range(rng.randint(1, 6))]
    rows += [(100, 0, "user", None), (100, 0, "assistant", "tie"), (100, 1, None, "x"), (None, 0, "user", "q")]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(6)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, (r is not None, r or ""), x or "", r))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(r or "", x) for _, _, x, r in sorted(turns, key=lambda z: z[:3])]
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.limit(0)).count() == 0


def test_role_machine():
    f = chat.Formatter(chat.Template())
    assert f.error(["system", "user", "assistant"]) is None
    assert f.error(["user", "user"]) and f.error(["assistant"]) and f.error(["user"]) and f.error([])


# --- 2 WARC ----------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "http://b/\r\nX: y", "other é"), (4, None, None), (5, "http://b/5", ""), (None, "http://n", "same"), (2, "http://a/2", "same"), (9, "http://big", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/w"
    warc.archive_pages(pages.repartition(3), path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows)
    b32 = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(i, "revisit" if h == "same" and i != 1 else "revisit" if (h or "") == "" and i == 5 else "response", len((h or "").encode()), "sha1:" + b32(h or "")) for i, _, h in rows]
    number = lambda u: int(u[10:-1]) if u[10:-1] else None
    assert sorted(((number(r.record_id), r.type, r.payload_length, r.payload_digest) for r in got), key=str) == sorted(want, key=str)
    assert {number(r.refers_to) for r in got if r.type == "revisit"} == {1, 4}
    assert {bytes(r.payload).decode() for r in got if r.type == "response"} == {"same", "other é", "", "z" * 300_000}
    only = warc.read_warc(spark, path, "skip", F.col("type") == "revisit")
    assert only.count() == 4 and all(r.payload is None for r in warc.read_warc(spark, path, "skip", "type = 'revisit'").collect())
    assert warc.read_warc(spark, path, "verify", F.col("target_uri").startswith("http://b/")).count() == 2
    members = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("w/*.gz"))
    assert members.count(b"WARC/1.1\r\n") == len(rows)
    warc.archive_pages(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_plain_files_folders_and_sizes(spark, tmp_path):
    rows = [dict(record_id=f"<urn:page:{k}>", type="response", target_uri="u", date=warc.DATE, payload_digest="sha1:" + warc.base32_sha1(b"x" * k), refers_to=None, payload_length=k, payload=b"x" * k) for k in (0, 3, 70_000, 5)]
    plain = b"".join(warc.encode_record(r) for r in rows)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.warc").write_bytes(plain)
    (tmp_path / "in" / "deep" / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.encode_record(r)) for r in rows))
    path = f"file://{tmp_path}/in"
    assert sorted(len(r.payload) for r in warc.read_warc(spark, path).collect()) == [0, 0, 3, 3, 5, 5, 70_000, 70_000]
    assert warc.read_warc(spark, path, "verify", "record_id = '<urn:page:5>'").count() == 2
    assert [r.payload_length for r in warc.read_warc(spark, path, "skip", F.col("record_id").endswith(":3>")).collect()] == [3, 3]
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(plain[:-6])
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, f"file://{tmp_path}/cut").collect()
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 50).alias("html")).coalesce(1)
    warc.register(spark)
    warc.page_records(pages).coalesce(1).write.format("warc").option("fileBytes", 20_000).mode("append").save(f"{path}/out")
    assert len(list((tmp_path / "in" / "out").glob("*.warc.gz"))) > 3 and warc.read_warc(spark, f"{path}/out", "verify").count() == 200


def test_warc_without_lengths_and_with_a_broken_payload(tmp_path):
    row = dict(record_id="<urn:page:1>", type="response", target_uri="u", date=warc.DATE, payload_digest="sha1:" + warc.base32_sha1(b"abc"), refers_to=None, payload_length=3, payload=b"abc")
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(warc.encode_record(row)) + warc.gzip_member(warc.encode_record(row)) + gzip.compress(warc.encode_record(row | {"payload": b"abd"})))
    with open(tmp_path / "x.warc.gz", "rb") as f:
        assert [r["payload"] for r in warc.read_records(f, lambda r: True, "read")] == [b"abc", b"abc", b"abd"]
        with pytest.raises(ValueError, match="doesn't hold"):
            list(warc.read_records(f, lambda r: True, "verify"))
        assert list(warc.read_records(f, lambda r: False, "read")) == []


# --- 5 mixing --------------------------------------------------------------------------------------


def targets_by_hand(sizes, weights, most=3):
    """Shares by weight; whoever is above ``most`` times the size stops there, the rest is shared again."""
    out, rest, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        per = rest / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if per * weights[i] > most * sizes[i]]
        for i in full or sorted(open_):
            out[i] = float(most * sizes[i]) if full else per * weights[i]
        if not full:
            break
        rest -= sum(out[i] for i in full)
        open_ -= set(full)
    return out


def test_targets_by_hand():
    got = targets_by_hand([10, 1000, 0, 500], [5, 2, 1, 5])
    assert got[0] == 30 and got[2] == 0 and sum(got) == pytest.approx(1510) and got[1] <= 3000 and got[3] <= 1500


def lefts_of(quotas, source):
    """Blocks of the left halves of the dyadic ranges around a source, from all sources down."""
    depth = (len(quotas) - 1).bit_length() if len(quotas) > 1 else 0
    total = lambda level, node: sum(quotas[node << level : (node + 1) << level])
    return [total(level, source >> (level + 1) << 1) for level in reversed(range(depth))]


@pytest.mark.parametrize(("quotas", "shards"), [([1000, 3, 0, 57, 12], 7), ([40], 9), ([5, 5], 1), ([1, 0, 0, 1, 300, 20, 4], 64)])
def test_splitting_tree_deals_exact_quotas(quotas, shards):
    place = lambda: [[tree.shard(s, lefts_of(quotas, s), b) for b in range(q)] for s, q in enumerate(quotas)]
    tree = mixing.SplittingTree(3, shards, sum(quotas))
    first = place()
    per = np.bincount([x for row in first for x in row], minlength=shards)
    assert len(per) == shards and np.ptp(per) <= (shards - 1).bit_length()
    assert all(row == sorted(row) for row in first)  # a shard has a range of permuted blocks
    tree = mixing.SplittingTree(3, shards, sum(quotas))
    assert place() == first
    many = mixing.SplittingTree(4, shards, sum(quotas))
    for s, q in enumerate(quotas):
        if q:
            seen = collections.Counter(many.shard_of_block(s, lefts_of(quotas, s), q, b) for b in range(q))
            assert seen == collections.Counter(many.shard(s, lefts_of(quotas, s), b) for b in range(q))


def test_splitting_tree_draws_without_bias():
    quotas, shards = [30, 10, 40], 4
    mean = np.mean([[np.bincount([tree.shard(s, lefts_of(quotas, s), b) for b in range(q)], minlength=shards) for s, q in enumerate(quotas)] for seed in range(300) for tree in [mixing.SplittingTree(seed, shards, 80)]], axis=0)
    assert np.abs(mean - np.array([[7.5], [2.5], [10]])).max() < 0.5


def test_mix_of_many_sources(spark):
    n = 200_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.lpad("id", 7, "0")).alias("source"), F.concat(F.lit("a b "), F.col("id")).alias("text"))
    found = mixing.mix(docs.unionByName(docs.filter("doc_id < 3000").withColumn("source", F.lit("t"))), shard_words=40_000).select("source", "source_size", "size", "target", "pieces").persist()
    row = found.select("size", "target", F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"]).alias("taken"), F.explode_outer("pieces").alias("p"))
    per = row.groupBy("p.shard").agg(F.sum("p.words").alias("w")).filter("shard IS NOT NULL").collect()
    assert len(per) == -(-(3 * n + 9000) // 40_000) and max(r.w for r in per) < 1.5 * 40_000
    got = found.groupBy("source").agg(F.first("target").alias("g"), F.first("source_size").alias("s")).collect()
    sizes = {r.source: r.s for r in got}
    names = sorted(sizes)
    want = dict(zip(names, targets_by_hand([sizes[k] for k in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    assert all(r.g == pytest.approx(want[r.source]) for r in got)


def test_mixed_shards_keep_clashing_columns(docs):
    extra = docs.withColumns({c: F.lit(f"my {c}") for c in ("copy", "shard", "words", "size", "target", "pieces", "piece")})
    out = mixing.mixed_shards(extra, shard_words=3000)
    assert out.columns == [*extra.columns, "_size", "source_size", "_target", "_copy", "_shard", "_words"]
    rows = out.collect()
    assert {(r.copy, r.shard, r.words, r.size, r.target, r.pieces, r.piece) for r in rows} == {("my copy", "my shard", "my words", "my size", "my target", "my pieces", "my piece")}
    assert all(len(SPACED.findall(r.text)) == r._words for r in rows)
    assert mixing.mixed_shards(empty(extra)).count() == 0


def test_rows_that_stay_keep_clashing_columns(docs):
    names = ["keep_id", "group_size", "kept", "n_words", "items", "spans", "contaminated"]
    extra = docs.withColumns({c: F.lit(f"my {c}") for c in names})
    bench = docs.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id = 4")
    for out in (exact_dedup(extra), decontaminate(extra, bench)):
        assert out.columns == extra.columns
        assert all(r[c] == f"my {c}" for r in out.collect() for c in names)


def test_mix(docs):
    found = mixing.mix(docs.withColumn("target", F.lit("clash")), shard_words=3000).collect()
    assert len(found) == docs.count()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(SPACED.findall(r.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, targets_by_hand([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    taken = collections.Counter()
    for r in found:
        t = sum(p.words for p in r.pieces)
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and t <= 3 * r.size
        taken[r.source] += t
    assert all(taken[s] == round(goal[s]) for s in names)
    again = mixing.mix(docs.repartition(2), shard_words=3000).collect()
    key = lambda rows: sorted((str(r.doc_id), sum(p.words for p in r.pieces), [p.shard for p in r.pieces]) for r in rows)
    assert key(found) == key(again)
    out = mixing.mixed_shards(docs, shard_words=3000).collect()
    assert sum(r.words for r in out) == sum(taken.values()) and all(len(SPACED.findall(r.text)) == r.words for r in out)
    assert mixing.mix(empty(docs)).count() == 0


# --- 1 toxicity ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(6)
    vocab = ["".join(rng.choices(["ka", "lo", "mi", "ter", "na", "ol", "es", "vin", "dor"], k=rng.randint(1, 3))) for _ in range(300)]
    bad = ["idiot", "moron", "scum", "pathetic"]
    rows = []
    for k in range(600):
        w = rng.choices(vocab, k=rng.randint(20, 80))
        y = int(k % 3 == 0)
        for _ in range(rng.randint(1, 3) if y else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((k, ". ".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)), y))
    return rows


def test_toxicity_learns_and_tolerates_noise(labelled):
    model = train([t for _, t, _ in labelled[:400]], [y for *_, y in labelled[:400]])
    table = WordTable(model)
    p = score_texts(model, table, pa.array([t for _, t, _ in labelled[400:]], pa.string()))
    y = np.array([y for *_, y in labelled[400:]])
    assert (p[y == 1] >= 0.3).mean() > 0.95 and (p[y == 0] < 0.3).mean() > 0.95
    clean = next(t for _, t, y in labelled if not y)
    bent = ["id.i.ot", "i d i o t", "MORON", "m0r0n", "idi*ot", "idiiot"]
    assert (score_texts(model, table, pa.array([f"{clean} {b} {clean}" for b in bent], pa.string())) > score_texts(model, table, pa.array([clean], pa.string()))[0] + 0.1).all()
    assert normalise("Ìdïö7!".encode()) == b"idiot"


def test_toxicity_frames(spark, docs, labelled):
    corpus = spark.createDataFrame([(i, t, "s") for i, t, _ in labelled], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled] + [(10**9, 1), (5, None)], "doc_id long, toxic int")
    model = fit(corpus, labels, most=150)
    assert isinstance(model, Model) and model.landmarks == fit(corpus.repartition(7), labels, most=150).landmarks
    got = toxicity(docs.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity(empty(docs), model).count() == 0
    none = fit(corpus.limit(0), labels)
    assert all(0 <= r.score <= 1 for r in toxicity(docs, none).collect())
