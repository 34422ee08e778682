"""Radix selection, the fast Gauss transform and sketched uniqueness against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import fidelity as FD
from cohortkit.operators import privacy as P
from cohortkit.operators import textprep as TP
from cohortkit.operators.quantiles import exact_quantiles
from cohortkit.operators.selection import hash_threshold, values_at


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_quantiles_equal_numpy(spark, bins):
    rnd = random.Random(bins)
    groups = {"a": [rnd.gauss(0, 1) for _ in range(301)], "b": [float(rnd.randint(0, 3)) for _ in range(200)] + [2.0] * 400, None: [5.0],
              "c": [1e-300, 1e300, -1e308, 1.7e308, 0.0, 5e-324]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None)]
    rnd.shuffle(rows)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", probs, bins=bins).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g]["n_values"] == len(vs)
        for i, p in enumerate(probs):
            assert got[g][f"q{i}"] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-300), (g, p)
    assert exact_quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", probs).collect() == []


def test_infinite_values_and_nan_have_their_ranks(spark):
    values = [-math.inf, -math.inf, 1.0, 2.0, math.inf, math.nan]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double").groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    n, found = values_at(df, ["g"], "v", "c", lambda n: list(range(1, n + 1)))[("g",)]
    assert n == 6 and found[:5] == values[:5] and math.isnan(found[5])


def test_hash_threshold_and_split(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([5, 65536, 65537, 4294967295, 70000]), k) for k in range(300)]
    df = spark.createDataFrame(rows, "h long, k long")
    order = sorted(rows)
    for rank in (1, 2, 60, 150, 299, 300):
        assert hash_threshold(df, "h", "k", rank) == order[rank - 1]
    assert hash_threshold(df, "h", "k", 0) is None
    for n in (0, 1, 4, 101):
        split = TP.split_exact(spark.range(n).withColumnRenamed("id", "sample_id"))
        assert split.where("is_test").count() == -(-n // 5)


def test_split_moves_no_rows(spark):
    rows = spark.range(1000).withColumnRenamed("id", "sample_id").checkpoint()
    plan = TP.split_exact(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def exact_density(values, grid):
    v = np.array(values)
    h = v.std(ddof=1) * len(v) ** -0.2
    x = v.min() + np.arange(grid) * ((v.max() - v.min()) / (grid - 1))
    return x, np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi)), h


@pytest.mark.parametrize("tolerance", [1e-3, 1e-6, 1e-10])
def test_fast_density_keeps_its_bound(spark, monkeypatch, tolerance):
    monkeypatch.setattr(FD, "stat6", lambda c: c)  # not rounded
    rnd = random.Random(1)
    groups = {"bell": [rnd.gauss(50, 10) for _ in range(700)], "outlier": [rnd.gauss(0, 1) for _ in range(300)] + [1e4],
              "two": [1.0, 2.0], "steps": [float(rnd.randint(0, 9)) for _ in range(500)]}
    df = spark.createDataFrame([("g", f, v) for f, vs in groups.items() for v in vs], "generator string, feature string, value double")
    worst = 0
    for t in (tolerance, None):
        got = {}
        for r in FD.kde_curve(df, 100, tolerance=t).collect():
            got.setdefault(r["feature"], {})[r["grid_idx"]] = (r["x"], r["density"])
        for f, vs in groups.items():
            x, want, h = exact_density(vs, 100)
            assert sorted(got[f]) == list(range(100))
            error = max(abs(got[f][i][1] - want[i]) for i in range(100)) * h * math.sqrt(2 * math.pi)
            assert error <= (1e-12 if t is None else 2 * t)
            worst = max(worst, error if t else 0)
    assert worst > 0


def test_sketches_flag_as_exact_counts(spark):
    n = 20000
    df = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "Statistical").otherwise("LLM").alias("generator"), F.col("id").alias("all_unique"), (F.col("id") % 7).alias("few"),
        (F.col("id") % 19000).alias("near"), F.when(F.col("id") < 15, F.col("id")).alias("nulls"), F.lit(None).cast("string").alias("none")).checkpoint()
    exact = {(r["generator"], r["column_name"]): r["flagged"] for r in P.uniqueness(df).collect()}
    got = {(r["generator"], r["column_name"]): r["flagged"] for r in P.uniqueness_flags(df).collect()}
    assert got == exact and any(exact.values())
    sketched = {(r["generator"], r["column_name"]): r["flagged"] for r in P.sketched_flags(df).collect()}
    assert sketched["LLM", "all_unique"] is True or sketched["LLM", "all_unique"] is None
    assert sketched["LLM", "near"] is None and sketched["LLM", "few"] is False and sketched["LLM", "none"] is False
    plan = P.sketched_flags(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert "Expand" not in P._exact_counts(df, P._counted(df))._jdf.queryExecution().executedPlan().toString()


def test_exact_ks_pvalues():
    # two samples of 5: the counts of the published tables over 252
    for d, paths in ((0.2, 252), (0.6, 90), (0.8, 20), (1.0, 2)):
        assert FD.exact_ks_pvalue(5, 5, d) == pytest.approx(paths / 252, abs=1e-12)
    import itertools
    for n, m in ((5, 5), (6, 4), (7, 3), (4, 4), (8, 2)):
        by_d = {}
        for where in itertools.combinations(range(n + m), n):
            i = j = worst = 0
            for k in range(n + m):
                i, j = (i + 1, j) if k in where else (i, j + 1)
                worst = max(worst, abs(i * m - j * n))
            by_d[worst] = by_d.get(worst, 0) + 1
        total = math.comb(n + m, n)
        for k in by_d:
            want = sum(c for w, c in by_d.items() if w >= k) / total
            assert FD.exact_ks_pvalue(n, m, k / (n * m)) == pytest.approx(want, abs=1e-12)
            assert FD.exact_ks_pvalue(m, n, k / (n * m)) == pytest.approx(want, abs=1e-12)
    assert FD.exact_ks_pvalue(10, 12, 0.0) == 1.0
    # large samples: near the asymptotic value
    d, n, m = 0.03, 9000, 4000
    lam = d * math.sqrt(n * m / (n + m))
    series = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 50))
    assert FD.exact_ks_pvalue(n, m, d) == pytest.approx(series, abs=0.002)
