
from decimal import Decimal

from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.operators import generate as G
from cohortkit.sources.catalog import categories
from cohortkit.sources.tables import load

from conftest import SF_SMALL


def _customers(spark):
    return load(spark, SF_SMALL, "customer", "c_custkey")


def test_partition_independent(spark):
    base = sorted(tuple(r) for r in G.statistical_items(spark, _customers(spark)).collect())
    for n in (1, 3, 17):
        again = sorted(tuple(r) for r in G.statistical_items(spark, _customers(spark).repartition(n)).collect())
        assert again == base


def test_line_ranges(spark):
    items = G.statistical_items(spark, _customers(spark))
    prices = {n: Decimal(p) for _, n, p in K.CATALOG}
    for r in items.select("item_name", "quantity", "unit_price", "item_total", "category").collect():
        assert 1 <= r["quantity"] <= 3
        base = prices[r["item_name"]]
        assert base * Decimal("0.95") - Decimal("0.005") <= r["unit_price"] <= base * Decimal("1.05") + Decimal("0.005")
        assert r["item_total"] == r["quantity"] * r["unit_price"]
        assert r["category"] in categories()


def test_totals_and_counts(spark):
    rec = G.statistical_receipts(spark, _customers(spark))
    items = G.statistical_items(spark, _customers(spark))
    n_lines = {r["receipt_id"]: r["n"] for r in items.groupBy("receipt_id").agg(F.count("*").alias("n")).collect()}
    for r in rec.collect():
        assert r["total_amount"] == r["subtotal"] + r["tax"]
        assert r["num_items"] == n_lines[r["receipt_id"]] >= 1
        assert 0 <= r["week_num"] < K.N_WEEKS


def test_retention_rate(spark):
    n_cust = _customers(spark).count()
    kept = G.retained(G.customer_week_grid(G.customer_ids(_customers(spark)))).count()
    n = n_cust * K.N_WEEKS
    p = K.KEEP_PROB
    assert abs(kept - n * p) <= 4 * (n * p * (1 - p)) ** 0.5


def test_preferred_distinct(spark):
    kept = G.retained(G.customer_week_grid(G.customer_ids(_customers(spark))))
    for r in G.receipt_draws(kept).select("preferred").collect():
        assert 1 <= len(r[0]) <= 3 and len(set(r[0])) == len(r[0])


def test_ks_self_and_symmetry(spark):
    from cohortkit.operators.fidelity import ks_statistic
    rec = G.statistical_receipts(spark, _customers(spark))
    twin = rec.unionByName(rec.withColumn("generator", F.lit("LLM")))
    assert all(r["d"] == 0.0 for r in ks_statistic(spark, twin).collect())
    split = rec.withColumn("generator", F.when(F.col("week_num") < 6, "Statistical").otherwise("LLM"))
    flip = split.withColumn("generator", F.when(F.col("generator") == "LLM", "Statistical").otherwise("LLM"))
    a = {r["feature"]: r["d"] for r in ks_statistic(spark, split).collect()}
    b = {r["feature"]: r["d"] for r in ks_statistic(spark, flip).collect()}
    assert a == b


def test_split_disjoint_complete(spark):
    from cohortkit.operators.textprep import split_exact
    df = spark.range(137).withColumnRenamed("id", "sample_id")
    s = split_exact(df)
    assert s.count() == 137 and s.select("sample_id").distinct().count() == 137
    assert s.filter("is_test").count() == (137 + 4) // 5


def test_distributed_median_matches_exact(spark):
    import random
    from cohortkit.operators.quantiles import exact_median
    rnd = random.Random(7)
    rows = [("a", float(rnd.randint(0, 50))) for _ in range(501)] + [("b", rnd.random()) for _ in range(400)] \
        + [("c", 5.0)] * 3
    df = spark.createDataFrame(rows, "g string, x double")
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("x").alias("m")).collect()}
    for b in (7, 100, 100_000):
        got = {r["g"]: r["median"] for r in exact_median(df, "g", "x", bins=b).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) <= 1e-12 for k in want)


def test_auto_bins_match_numpy(spark):
    import numpy as np
    from cohortkit.operators.fidelity import density_histogram
    rnd = np.random.default_rng(3)
    samples = {"a": rnd.normal(50, 10, 997), "b": rnd.exponential(3, 311), "c": np.repeat([1.0, 2.0, 2.0, 2.0, 9.0], 40),
               "d": np.full(7, 4.0)}
    ints = rnd.integers(1, 30, 500)
    rows = [(g, "x", float(v)) for g, xs in samples.items() for v in xs] + [("e", "num_items", float(v)) for v in ints]
    df = spark.createDataFrame(rows, "generator string, feature string, value double")
    h = density_histogram(df).groupBy("generator").agg(F.count("*").alias("bins"), F.sum("cnt").alias("n"),
                                                       F.min("bin_lo").alias("lo")).collect()
    got = {r["generator"]: (r["bins"], r["n"]) for r in h}
    for g, xs in list(samples.items()) + [("e", ints)]:
        assert got[g] == (len(np.histogram_bin_edges(xs, bins="auto")) - 1, len(xs)), g
    assert {r["generator"]: r["lo"] for r in h}["d"] == 3.5


def test_kde_matches_numpy(spark):
    import numpy as np
    from cohortkit.operators.fidelity import kde_curve
    x = np.random.default_rng(5).gamma(3.0, 2.0, 400)
    df = spark.createDataFrame([("a", "f", float(v)) for v in x], "generator string, feature string, value double")
    n, h = len(x), x.std(ddof=1) * len(x) ** (-0.2)
    for cut in (0, 3):
        grid = np.linspace(x.min() - cut * h, x.max() + cut * h, 200)
        want = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(axis=1) / (n * h * np.sqrt(2 * np.pi))
        exact = sorted((r["grid_idx"], r["density"]) for r in (kde_curve(df, cut=cut) if cut else kde_curve(df)).collect())
        assert max(abs(d - w) for (_, d), w in zip(exact, want)) < 2e-6


def test_strip_fences_equals_the_four_strips(spark):
    from cohortkit.functions.scalars import strip_fences
    texts = ["", " ", "{}", "a{}", "é{}é", "{} ", "　{}", "{}`", "json", "j", "```json\n{}\n```", "{\n}", "n{}", "{}s", "` {} `", "\x85x ", None]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    got = {r[0]: r[1] for r in df.select("raw", strip_fences(F.col("raw"))).collect()}
    assert got == {t: None if t is None else t.strip().strip("```json").strip("```").strip() for t in texts}


def test_response_amounts_are_the_decimals(spark):
    from cohortkit.functions.scalars import cents_to_money
    from cohortkit.sources.fixtures import _money_text
    df = spark.createDataFrame([(c,) for c in (0, 1, -1, 5, 99, 100, -100, -105, 123456789, 10 ** 17, None)], "c long")
    assert df.where(~_money_text(F.col("c")).eqNullSafe(cents_to_money(F.col("c")).cast("string"))).count() == 0
