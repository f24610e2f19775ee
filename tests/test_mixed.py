"""Mixed models from sums against the likelihood with the whole covariance."""

import math

import numpy as np
import pandas as pd
import pytest

from chronolane.operators import mixed


def dense(y, x, unit):
    """REML with the covariance of all rows: beta, se, group and residual variance."""
    same = (unit[:, None] == unit[None, :]).astype(float)
    n, k = x.shape

    def at(log_ratio):
        v = np.eye(n) + math.exp(log_ratio) * same
        inverse = np.linalg.inv(v)
        a = x.T @ inverse @ x
        beta = np.linalg.solve(a, x.T @ inverse @ y)
        r = y - x @ beta
        noise = float(r @ inverse @ r) / (n - k)
        return (n - k) * math.log(noise) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1], beta, noise, a

    grid = np.linspace(-16, 12, 113)
    best = grid[np.argmin([at(g)[0] for g in grid])]
    lo, hi = best - 0.25, best + 0.25
    for _ in range(60):
        p, q = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, q) if at(p)[0] < at(q)[0] else (p, hi)
    _, beta, noise, a = at((lo + hi) / 2)
    return beta, np.sqrt(noise * np.diag(np.linalg.inv(a))), math.exp((lo + hi) / 2) * noise, noise


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(7)
    rows = []
    for virus in ("u", "v"):
        for unit in range(14):
            own, n = rng.normal(0, 2), int(rng.integers(1, 9))
            for _ in range(n):
                level, group = rng.choice(["A", "B", "R"]), rng.choice(["g1", "g2"])
                rows.append((virus, f"m{unit}", level, group, 10 + own + {"A": 1.5, "B": -1.0, "R": 0.0}[level] + rng.normal()))
    return pd.DataFrame(rows, columns=["virus", "mouse", "level", "group", "y"])


def test_factor_model(spark, table):
    odd = pd.DataFrame([("w", "m1", "A", "g1", 1.0), ("w", "m2", "A", "g1", 2.0), ("u", None, "A", "g1", 5.0), ("u", "m1", "A", "g1", None), ("u", "m1", None, "g1", 3.0)], columns=table.columns)
    df = spark.createDataFrame(pd.concat([table, odd]).astype(object).where(lambda d: d.notna(), None).values.tolist(), "virus string, mouse string, level string, group string, y double").repartition(4)
    got = {(r.virus, r.term): r for r in mixed.factor_model(df, "y", "level", "mouse", "R", {"virus": "string"}).collect()}
    for virus in ("u", "v"):
        t = table[table.virus == virus]
        x = np.column_stack([np.ones(len(t)), t.level == "A", t.level == "B"]).astype(float)
        beta, se, _, _ = dense(t.y.to_numpy(), x, t.mouse.to_numpy())
        for j, level in ((1, "A"), (2, "B")):
            r = got[virus, f"{level} - R"]
            assert r.estimate == pytest.approx(beta[j], abs=1e-5) and r.se == pytest.approx(se[j], rel=1e-4) and r.n == len(t)
            assert r.z == pytest.approx(r.estimate / r.se) and r.ci_upper - r.ci_lower == pytest.approx(2 * mixed.Z95 * r.se)
    assert got["w", "not fitted"].n == 2 and len(got) == 5
    assert mixed.factor_model(df.limit(0), "y", "level", "mouse", "R", {"virus": "string"}).count() == 0


def test_interaction_model(spark, table):
    some = table[table.level.isin(["A", "R"])]
    df = spark.createDataFrame(some.values.tolist(), "virus string, mouse string, level string, group string, y double")
    got = {(r.virus, r.term): r for r in mixed.interaction_model(df, "y", "level", "R", "group", ("g1", "g2"), "mouse", {"virus": "string"}).collect()}
    for virus in ("u", "v"):
        d = some[some.virus == virus]
        t, g = (d.level == "A").to_numpy(float), (d.group == "g2").to_numpy(float)
        beta, se, _, _ = dense(d.y.to_numpy(), np.column_stack([np.ones(len(d)), g, t * (1 - g), t * g]), d.mouse.to_numpy())
        for term, j in (("effect | g1", 2), ("effect | g2", 3)):
            assert got[virus, term].estimate == pytest.approx(beta[j], abs=1e-5) and got[virus, term].se == pytest.approx(se[j], rel=1e-4)
        assert got[virus, "interaction: g2 - g1"].estimate == pytest.approx(beta[3] - beta[2], abs=1e-5)
    empty_cell = df.filter("NOT (level = 'A' AND group = 'g2')")
    assert {r.term for r in mixed.interaction_model(empty_cell, "y", "level", "R", "group", ("g1", "g2"), "mouse", {"virus": "string"}).collect()} == {"not fitted"}


def test_a_task_has_no_rows_and_no_units(spark):
    n = 40_000
    rng = np.random.default_rng(3)
    unit = rng.integers(0, 5_000, n)
    pdf = pd.DataFrame({"virus": "u", "mouse": unit, "level": rng.choice(["A", "R"], n), "y": rng.normal(size=n) + rng.normal(size=5_000)[unit]})
    pdf["y"] += (pdf.level == "A") * 0.5
    df = spark.createDataFrame(pdf)
    held = mixed.cell_sums(df, "y", df["level"], "mouse", ["virus"]).count()
    assert held < 250  # a few numbers for each of some thirty sizes
    r = mixed.factor_model(df, "y", "level", "mouse", "R", {"virus": "string"}).first()
    assert r.estimate == pytest.approx(0.5, abs=0.05) and r.n == n


def test_tasks_of_a_joined_table_do_not_grow_with_it(spark, monkeypatch):
    from pyspark.sql import functions as F

    from chronolane.plans import registry
    from chronolane.plans.table_queries import lines

    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, lines(spark, sf).collect()))
    monkeypatch.setattr(registry, "TASK_ROWS", 300)
    got = lines(spark, sf)
    assert sorted(map(tuple, got.collect())) == want
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > len(want) // 300 * 0.8 and max(tasks) < 900
    from chronolane.plans.model_queries import m_lmm, m_timeseries_lmm

    for query in (m_lmm, m_timeseries_lmm):
        assert query(spark, sf).count() > 0
