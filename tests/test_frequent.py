"""Top lists by sketch and recount against exact counts."""

import random
from collections import Counter

import pytest

from cohortkit.operators import frequent as FQ
from cohortkit.operators import utility as U
from cohortkit.session import materialize


def rows(result):
    return sorted((r["generator"], r["rank"], r["v"], r["cnt"]) for r in result.collect())


def test_shrink_keeps_the_bound():
    rnd = random.Random(1)
    values = [int(rnd.paretovariate(0.8)) for _ in range(5000)]
    exact, held, error = Counter(values), Counter(), 0
    for k in range(0, len(values), 100):
        held.update(values[k:k + 100])
        error += FQ.shrink(held, 20)
        assert len(held) <= 20
    assert all(held[v] <= n <= held[v] + error for v, n in exact.items())
    assert error * 21 <= len(values)  # the summary's own bound


@pytest.mark.parametrize("counters,shape", [(4, 1.1), (16, 0.7), (64, 0.7), (1024, 0.7)])
def test_lists_are_exact(spark, counters, shape):
    rnd = random.Random(counters)
    data = [(rnd.choice("ab"), f"v{min(int(rnd.paretovariate(shape)), 400):03d}" if rnd.random() < 0.97 else None) for _ in range(4000)]
    df = materialize(spark.createDataFrame(data, "generator string, v string").repartition(5))
    for n in (1, 5, 15):
        assert rows(FQ.top_frequent(df, "v", n, counters)) == rows(U.top_n(U.value_counts(df, "v"), "v", n))


def test_even_counts_need_all_values(spark, monkeypatch):
    monkeypatch.setattr(FQ, "MOST", 100)
    df = materialize(spark.createDataFrame([("a", f"v{k % 500}") for k in range(2000)] + [("b", "x"), ("c", None)], "generator string, v string").repartition(3))
    lows = materialize(FQ.sketch(df, "v", 10))
    assert FQ.candidates(lows, 3)[1] is False
    assert rows(FQ.top_frequent(df, "v", 3, 10)) == rows(U.top_n(U.value_counts(df, "v"), "v", 3))
    assert FQ.top_frequent(df.where("false"), "v", 3).collect() == []
