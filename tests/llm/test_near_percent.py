"""Near dedup: pairs at the edge, other percentages, lists of several blocks."""

import random

import numpy as np
import pytest

from chronolane.llm import near_dedup
from chronolane.llm.near_dedup import COORDINATES, MISS, forest, near_groups, needed, signature


def brute(sets, percent):
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            inter = len(sets[a] & sets[b])
            if a < b and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}


def shingles(text):
    w = text.split(" ")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def test_counts_follow_the_percentage():
    assert needed(90) > needed(75) > needed(60) > 0
    rng = np.random.default_rng(1)
    for percent in (60, 75, 90):
        draws = rng.binomial(COORDINATES, percent / 100, 1_000_000)
        assert (draws < needed(percent)).sum() == 0 and MISS <= 1e-9
    with pytest.raises(ValueError):
        needed(10)


def test_no_pair_at_the_edge_is_missed(spark):
    """10,000 pairs with 60 shingles in common of 80, exactly 75 percent, and 2,000 with one fewer."""
    rng = random.Random(7)
    rows, want = [], {}
    for k in range(12000):
        common = [f"w{rng.getrandbits(48)}" for _ in range(64 if k < 10000 else 63)]
        tails = [[f"w{rng.getrandbits(48)}" for _ in range(10)] for _ in (0, 1)]
        rows += [(2 * k + s, " ".join(common + tails[s])) for s in (0, 1)]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if k < 10000 else 2 * k + 1}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_groups(df).collect()}
    assert got == want


def test_pairs_at_sixty_percent_are_linked(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(1 << 40)}"
    rows = []
    for k in range(300):
        common = [word() for _ in range(64)]  # 60 shingles of 100 in the union
        rows += [(2 * k + s, " ".join(common + [word() for _ in range(20)])) for s in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_groups(df, percent=60).collect()} == {d: d - d % 2 for d, _ in rows}
    assert all(r.kept for r in near_groups(df, percent=61).collect())


def family(rng, n, words=60, most=9):
    """Variants of one text, many of them near the threshold of one another."""
    base = [f"b{k}" for k in range(words)]
    out = []
    for _ in range(n):
        v = list(base)
        for _ in range(rng.randint(0, most)):
            v[rng.randrange(words)] = f"x{rng.randrange(40)}"
        out.append(" ".join(v))
    return out


def test_forest_joins_what_is_linked_and_nothing_else():
    rng = random.Random(2)
    texts = sorted(set(family(rng, 120)))
    ids = {s: k for k, s in enumerate({s for t in texts for s in shingles(t)})}
    sets = [np.array(sorted(ids[s] for s in shingles(t)), np.uint64) for t in texts]
    signs = np.stack([signature(s * np.uint64(0x9E3779B97F4A7C15)) for s in sets])
    everyone = np.arange(len(texts))
    label = everyone.copy()
    forest(signs, sets, label, everyone, everyone, 0, 75)
    want = brute({k: set(s.tolist()) for k, s in enumerate(sets)}, 75)
    assert all((want[a] == want[b]) == (label[a] == label[b]) for a in everyone for b in everyone)
    assert len(set(want.values())) > 5


@pytest.mark.parametrize("limits", [{"BLOCK": 16}, {"BLOCK_BYTES": 4000}])
def test_lists_of_several_blocks_lose_no_link(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(5)
    texts = family(rng, 300, most=12)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_groups(df).collect()}
    want = brute({k: shingles(t) for k, t in enumerate(texts)}, 75)
    assert got == want and 5 < len(set(want.values())) < 295


def test_ids_may_be_strings_and_columns_may_clash(spark):
    words = " ".join(f"w{k}" for k in range(40))
    rows = [("b", words, 1), ("a", words + " more", 2), ("c", "other", 3), ("c", words, 4), (None, words, 5), ("e", None, 6)]
    df = spark.createDataFrame(rows, "name string, body string, token long")
    df = df.withColumn("rep", df.token).withColumn("comp", df.token).withColumn("same", df.token)
    got = sorted((r.doc_id or "", r.n_shingles, r.component_id, r.kept) for r in near_groups(df, "body", "name").collect())
    assert got == [("", 36, None, True), ("a", 37, "a", True), ("b", 36, "a", False), ("c", 1, "a", False), ("c", 36, "a", False), ("e", 0, "e", True)]


def test_joins_on_a_class_give_a_row_per_class(spark, monkeypatch):
    """Pipeline's finding: each class of a large group of near copies came out of such joins once for every list that it is in."""
    from chronolane.llm import near_dedup as module

    kept = {}

    class Keeping(module.Workspace):
        def table(self, df, name):
            kept[name] = super().table(df, name)
            return kept[name]

        def drop(self, *names):
            pass

    monkeypatch.setattr(module, "Workspace", Keeping)
    words = [f"w{k}" for k in range(200)]
    df = spark.createDataFrame([(d, " ".join([*words, f"own{d}"])) for d in range(1500)], "doc_id long, text string")
    assert {r.component_id for r in near_groups(df).collect()} == {0}
    dealt = kept["dealt"].selectExpr("count(*) AS rows", "count(DISTINCT rep, cls) AS classes", "sum(size(lists)) AS lists").first()
    assert dealt.rows == dealt.classes == 1500 and dealt.lists > 10 * dealt.rows
