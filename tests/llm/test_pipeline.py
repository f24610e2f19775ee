"""The pipeline on a small corpus against its stages done by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronolane.llm.queries import TOXIC, toxicity_model
from chronolane.llm.toxicity import toxicity
from tests.llm.test_llm import SPACED, WORDY, brute_components, brute_lines, low, targets_by_hand


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choices(["ka", "lo", "mi", "ter", "na", "ol", "es"], k=rng.randint(1, 3))) for _ in range(200)]
    say = lambda n: "\n".join(" ".join(rng.choices(vocab, k=8)) for _ in range(n))
    shared, items = say(4), [(k, " ".join(rng.choices(vocab, k=18))) for k in range(3)]
    rows, labels = [], []
    for k in range(240):
        t = say(rng.randint(1, 9))
        if k % 6 == 0:
            t = f"{t}\n{shared}"
        if k % 10 == 3:
            t = rows[k - 1][1]
        if k % 10 == 4:
            w = rows[k - 2][1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if k % 24 == 7:
            t = f"{t} {items[k % 3][1]}"
        bad = k % 5 == 1
        if bad:
            t = f"{t}\nidiot and moron and scum\n{say(1)}"
        rows.append((k, t if k != 77 else None, "en", f"s{k % 3}", len(t)))
        labels.append((k, 1, int(bad)))
    d = tmp_path_factory.mktemp("corpus")
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{d}/{name}.parquet")
    return str(d), rows, items


def test_stages_return_the_columns_of_documents(spark, corpus):
    d, rows, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), d).columns == docs.columns


def test_run_equals_the_stages_by_hand(spark, corpus):
    d, rows, items = corpus
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    toxic = {r.doc_id for r in toxicity(docs, toxicity_model(docs, labels)).filter(f"score >= {TOXIC}").collect()}
    planted = {k for k in range(240) if k % 5 == 1 and k % 10 not in (3, 4) and k != 77}
    assert len(toxic & planted) > 0.9 * len(planted)
    kept = {i: (t, s) for i, t, _, s, _ in rows if i not in toxic}
    cleaned = brute_lines([(i, t) for i, (t, _) in kept.items()])
    kept = {i: (None if t is None else cleaned[i, t][0], s) for i, (t, s) in kept.items()}
    comp = brute_components([(i, t) for i, (t, _) in kept.items()])
    kept = {i: v for i, v in kept.items() if comp[i] == i}
    windows = {tuple(w[k : k + 13]) for _, t in items for w in [WORDY.findall(low(t))] for k in range(len(w) - 12)}

    def clean(t):
        w = WORDY.findall(low(t or ""))
        hit = {j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for j in range(k, k + 13)}
        return not hit or 20 * len(hit) < len(w)

    kept = {i: v for i, v in kept.items() if clean(v[0])}
    out = corpus_pipeline.run(spark, d).collect()
    sizes, taken = {}, {}
    for i, (t, s) in kept.items():
        sizes[s] = sizes.get(s, 0) + len(SPACED.findall(t or ""))
    for r in out:
        assert r.doc_id in kept and (r.text == kept[r.doc_id][0] or r.words < r.size)
        assert len(re.findall(SPACED, r.text)) == r.words
        taken[r.source] = taken.get(r.source, 0) + r.words
    names = sorted(sizes)
    goals = targets_by_hand([sizes[s] for s in names], [5, 2, 1])
    assert [taken[s] for s in names] == [round(g) for g in goals]
    assert {r.doc_id for r in out if r.copy == 0} <= set(kept)


CLASHES = ["words", "copy", "shard", "piece", "pieces", "items", "kept", "score", "size", "n_lines", "n_hit", "spans", "keep_id", "component_id", "scanned"]


def test_run_keeps_extra_columns_of_any_name(spark, corpus, tmp_path):
    d, rows, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    known = sorted({w for k, t, *_ in rows if t and k % 5 != 1 for w in t.split()})
    rng = random.Random(2)
    long = "\n".join(" ".join(rng.choices(known, k=9)) for _ in range(360_000))  # 20 MB
    assert len(long) > 2e7
    odd = [(1000, "", "en", "s0", 0), (1001, None, None, None, None), (1002, " \n\t", "en", "s1", 3), (1003, long, "en", "s2", len(long)), (1003, long, "en", "s2", len(long))]
    whole = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    whole = whole.withColumns({c: F.concat(F.lit(f"{c} "), "doc_id") for c in CLASHES})
    whole.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*whole.columns, "_size", "source_size", "target", "_copy", "_shard", "_words"]
    got = out.collect()
    assert all(r[c] == f"{c} {r.doc_id}" for r in got for c in CLASHES)
    plain = {(r.doc_id, r.copy) for r in corpus_pipeline.run(spark, d).collect()}
    assert {r.doc_id for r in got} - {1003} <= {i for i, *_ in rows} and len({r.doc_id for r in got} & {i for i, _ in plain}) > 0.9 * len({i for i, _ in plain})
    mine = [r for r in got if r.doc_id == 1003]
    assert mine, "gone"
    assert any(r.text == long for r in mine), [(len(r.text), r._words, r._size, len(long), r.target, r.source) for r in mine]


def test_run_of_an_empty_table(spark, corpus, tmp_path):
    d, _, _ = corpus
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
