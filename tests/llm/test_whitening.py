"""Whitening against exact fractions, and on the awkward cases."""

import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from cohortkit.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors):
    """(n, S, covariance) of the distinct vectors, by fractions."""
    x = sorted({tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors})
    n, dim = len(x), len(x[0])
    mean = [Fraction(sum(v[i] for v in x), n) for i in range(dim)]
    cov = [[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in x) / n) for j in range(dim)] for i in range(dim)]
    return n, [sum(v[i] for v in x) for i in range(dim)], np.array(cov)


def test_against_fractions(spark):
    rnd = random.Random(5)
    base = [[rnd.gauss(0, 1) * (k + 1) / 3 for k in range(6)] for _ in range(200)]
    base = [[v[0] + v[1], *v[1:]] for v in base]
    rows = [(i, v) for i, v in enumerate(base + base[:50] + [base[0]] * 150)]  # a third are copies of one vector
    rows += [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [math.nan] * 6), (903, [math.inf] * 6), (904, []), (None, base[1])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("x", F.lit(1)).withColumn("a.b", F.lit(1))
    got = wh.whiten(df.repartition(5), "vec_id", "embedding").collect()
    n, sums, cov = brute(base)
    values, axes = np.linalg.eigh(cov)
    assert len(got) == 4 * (len(base) + 50 + 150 + 1)
    assert {r["n"] for r in got} == {n}
    at = dict(rows)
    at[None] = base[1]
    signs = {}
    for r in got:
        x = [math.floor(256 * float(np.float32(c))) for c in at[r["id"]]]
        k = r["component"]
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        want = float(np.dot(np.array([a - s / n for a, s in zip(x, sums)]), axes[:, -k])) / math.sqrt(values[-k])
        sign = signs.setdefault(k, 1 if r["whitened"] * want > 0 else -1)
        assert abs(r["whitened"] - sign * want) < 1e-8 * max(1, abs(want))
        assert abs(r["explained"] - values[-k] / values.sum()) < 1e-9
        assert r["identity_error"] < 1e-9


def test_polarised_covariance_is_exact():
    rnd = random.Random(6)
    x = [[rnd.randint(-10 ** 6, 10 ** 6) for _ in range(5)] for _ in range(40)]
    n, sums = len(x), [sum(v[i] for v in x) for i in range(5)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    y = [[a - c for a, c in zip(v, centre)] for v in x]
    squares = {i * 5 + j: sum((v[i] if i == j else v[i] + v[j]) ** 2 for v in y) for i in range(5) for j in range(i, 5)}
    mean = [Fraction(s, n) for s in sums]
    want = [[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in x) / n) for j in range(5)] for i in range(5)]
    assert wh.covariance(n, sums, squares, centre).tolist() == want


def test_awkward_lists(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25])] * 3 + [(2, [1.0]), (3, [2.0]), (4, [1e30, -1e30, 0.0]), (5, [1.0, 2.0, 3.0])], SCHEMA)
    got = {(r["id"], r["component"]): r for r in wh.whiten(df, "vec_id", "embedding").collect()}
    assert sorted(got) == [(1, 1), (1, 2), (2, 1), (3, 1), (4, 1), (4, 2), (4, 3), (5, 1), (5, 2), (5, 3)]
    assert got[1, 1]["whitened"] is None and got[1, 1]["explained"] is None and got[1, 1]["deviation"] == 0 and got[1, 1]["n"] == 1
    assert abs(abs(got[2, 1]["whitened"]) - 1) < 1e-12 and got[2, 1]["explained"] == 1.0
    assert got[4, 1]["deviation"] is None and abs(abs(got[4, 1]["whitened"]) - 1) < 1e-9 and got[4, 2]["whitened"] is None


def test_empty(spark):
    assert wh.whiten(spark.createDataFrame([], SCHEMA), "vec_id", "embedding").collect() == []
    assert wh.whiten(spark.createDataFrame([(1, None)], SCHEMA), "vec_id", "embedding").collect() == []
