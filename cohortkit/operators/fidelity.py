"""Fidelity comparison of two cohorts.

Every distribution metric starts from one aggregate, the count per (generator, feature, value): the
KS statistic and the quartiles are prefix counts over it (``quantiles.prefix_counts``: no feature in
one task), histograms and density curves are weighted sums over it. All of it is exact at every size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.functions.scalars import MONEY
from cohortkit.operators.cohorts import stat6
from cohortkit.operators.quantiles import ROWS_PER_PART, prefix_counts, quantiles_of_counts
from cohortkit.session import materialize
from cohortkit.operators.utility import _avg_weekly, top_n, value_counts

A, B = "Statistical", "LLM"


def unpivot_features(receipts: DataFrame, features: list[str] = K.FIDELITY_FEATURES, value_type: str = MONEY) -> DataFrame:
    """``(generator, feature, value)`` long form; nulls kept (they count as rows, not values)."""
    pairs = ", ".join(f"'{f}', cast({f} as {value_type})" for f in features)
    return receipts.selectExpr("generator", f"stack({len(features)}, {pairs}) as (feature, value)")


def ks_pvalue(d: Column, n_a: Column, n_b: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value: ``Q(λ) = 2 Σ_{k>=1} (-1)^(k-1) exp(-2 k² λ²)``,
    ``λ = D·sqrt(n_a n_b / (n_a + n_b))``, clamped to [0, 1], 1 for λ < 0.2 (F2)."""
    lam = d * F.sqrt(n_a.cast("double") * n_b / (n_a + n_b))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * (k * k).cast("double") * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * series)))


EXACT_LIMIT = 10_000  # the larger sample's size up to which the p-value is exact


def exact_ks_pvalue(n_a: int, n_b: int, d: float) -> float:
    """P(D >= d) of two samples of one distribution, by counting lattice paths (F2).

    All interleavings of the samples are equally likely; each is a path from (0, 0) to (n, m), and D < d holds
    for the paths that stay where |i · m - j · n| < d · n · m. Row i of the counts is the running sum of row i - 1 inside the
    band; rows are scaled to 1 and the scale is kept as a logarithm.
    """
    n, m = max(n_a, n_b), min(n_a, n_b)
    k = round(d * n * m)
    log_scale, lo, row = 0.0, 0, np.ones(min(m, -(-k // n) - 1) + 1)
    for i in range(1, n + 1):
        low, high = max(0, (i * m - k) // n + 1), min(m, -(-(i * m + k) // n) - 1)
        if low > high or not len(row):
            return 1.0
        row = np.concatenate([row[low - lo:], np.zeros(max(0, high - (lo + len(row) - 1)))])[:high - low + 1].cumsum()
        lo, top = low, row.max(initial=0.0)
        if top == 0:
            return 1.0
        row, log_scale = row / top, log_scale + math.log(top)
    paths = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1)
    return min(1.0, max(0.0, 1.0 - math.exp(math.log(row[-1]) + log_scale - paths))) if row[-1] > 0 else 1.0


def _exact_pvalues(n_a: pd.Series, n_b: pd.Series, d: pd.Series) -> pd.Series:
    """:func:`exact_ks_pvalue` of a row per feature; null where it does not apply."""
    return pd.Series([exact_ks_pvalue(int(a), int(b), x) if x == x and 0 < min(a, b) and max(a, b) <= EXACT_LIMIT else None
                      for a, b, x in zip(n_a, n_b, d.astype(float))], dtype=float)


def distribution(long: DataFrame, value_type: str | None = None) -> DataFrame:
    """``(generator, feature, value, c)``: rows per distinct value, nulls included; computed once."""
    v = F.col("value") if value_type is None else F.col("value").cast(value_type)
    return materialize(long.groupBy("generator", "feature", v.alias("value")).agg(F.count(F.lit(1)).alias("c")))


def ks_statistic(spark: SparkSession, receipts: DataFrame, features: list[str] = K.FIDELITY_FEATURES,
                 a: str = A, b: str = B, rows_per_part: int = ROWS_PER_PART, method: str = "auto") -> DataFrame:
    """Two-sample Kolmogorov–Smirnov statistic, p-value, verdict and status per feature (F1–F3): the two
    empirical CDFs are compared at every distinct value. The p-value is exact while the larger sample has at most
    ``EXACT_LIMIT`` values, else (or with ``method="asymptotic"``) asymptotic."""
    return ks_of(spark, distribution(unpivot_features(receipts, features)), features, a, b, rows_per_part, method)


def ks_of(spark: SparkSession, dist: DataFrame, features: list[str], a: str = A, b: str = B,
          rows_per_part: int = ROWS_PER_PART, method: str = "auto") -> DataFrame:
    """:func:`ks_statistic` from the counts of :func:`distribution`."""
    if method not in ("auto", "asymptotic"):
        raise ValueError(f"unknown method {method!r}")
    cnt = materialize(dist.groupBy("feature", "value").agg(
        F.sum(F.when(F.col("generator") == a, F.col("c")).otherwise(0)).cast("bigint").alias("ca"),
        F.sum(F.when(F.col("generator") == b, F.col("c")).otherwise(0)).cast("bigint").alias("cb")))
    totals = cnt.groupBy("feature").agg(
        F.sum("ca").alias("rows_a"), F.sum("cb").alias("rows_b"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("ca")).otherwise(0)).alias("n_a"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("cb")).otherwise(0)).alias("n_b"))
    cdf = prefix_counts(cnt.filter(F.col("value").isNotNull()), ["feature"], "value", ["ca", "cb"], rows_per_part)
    # a cohort without values gives status `missing`; never divide by its zero count
    both = totals.filter((F.col("n_a") > 0) & (F.col("n_b") > 0)).select("feature", "n_a", "n_b")
    dmax = cdf.join(F.broadcast(both), "feature").groupBy("feature").agg(
        F.max(F.abs(F.col("cum_ca").cast("double") / F.col("n_a") - F.col("cum_cb").cast("double") / F.col("n_b")))
        .alias("d_raw"))
    feats = spark.createDataFrame([(f,) for f in features], "feature string")
    out = feats.join(totals, "feature", "left").join(dmax, "feature", "left")
    rows_a, rows_b = F.coalesce("rows_a", F.lit(0)), F.coalesce("rows_b", F.lit(0))
    n_a, n_b = F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))
    status = (F.when((rows_a == 0) | (rows_b == 0), F.lit("empty"))
              .when((n_a == 0) | (n_b == 0), F.lit("missing"))
              .when((n_a <= 1) | (n_b <= 1), F.lit("not_enough_points"))
              .otherwise(F.lit("ok")))
    # Raw values get names no output alias reuses: a lambda (the p-value series) must never see
    # a rebound name after Catalyst splits or collapses the projections.
    raw = out.select("feature", n_a.cast("bigint").alias("n_a"), n_b.cast("bigint").alias("n_b"),
                     status.alias("status"), "d_raw")
    ok = F.col("status") == "ok"
    exact = ok & (F.greatest("n_a", "n_b") <= EXACT_LIMIT) & F.lit(method == "auto")
    raw = raw.withColumn("p_raw", F.when(ok, ks_pvalue(F.col("d_raw"), F.col("n_a"), F.col("n_b"))))
    if method == "auto":  # a row per feature
        raw = raw.withColumn("p_exact", F.pandas_udf(_exact_pvalues, "double")("n_a", "n_b", "d_raw")).withColumn(
            "p_raw", F.when(exact, F.col("p_exact")).otherwise(F.col("p_raw")))
    return raw.select(
        "feature", "n_a", "n_b", stat6(F.when(ok, F.col("d_raw"))).alias("d"), stat6(F.col("p_raw")).alias("p_value"),
        F.when(ok, F.when(F.col("p_raw") < K.KS_ALPHA, F.lit(K.KS_DIFFER)).otherwise(F.lit(K.KS_SIMILAR))).alias("verdict"),
        "status", F.when(exact, F.lit("exact")).otherwise(F.lit("asymptotic")).alias("method"))


def bin_stats(dist: DataFrame) -> DataFrame:
    """Count, range and standard deviation (two passes over the counts) per feature and cohort: a handful of rows,
    computed once, which then are a local table of the plans that read them."""
    vals = dist.filter(F.col("value").isNotNull())
    st = vals.groupBy("feature", "generator").agg(
        F.sum("c").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        (F.sum(F.col("c") * F.col("value")) / F.sum("c")).alias("mean"))
    # features x cohorts rows
    dev = vals.join(F.broadcast(st), ["feature", "generator"]).groupBy("feature", "generator").agg(
        F.max("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sqrt(F.sum(F.col("c") * F.pow(F.col("value") - F.col("mean"), 2)) / F.nullif(F.max("n") - 1, F.lit(0))).alias("sd"))
    return dist.sparkSession.createDataFrame(dev.collect(), dev.schema)


def auto_bins(n: Column, lo: Column, hi: Column, q25: Column, q75: Column, integral: Column) -> Column:
    """Bin count of the ``"auto"`` rule of numpy-style histograms, which the plotting library
    applies per cohort: width = min(max(FD, sqrt/2), Sturges) with FD = 2·IQR·n^(-1/3),
    sqrt = range/√n, Sturges = range/(log2 n + 1); at least 1 for integer data; one bin for a
    constant sample."""
    rng = hi - lo
    nd = n.cast("double")
    sturges = rng / (F.log2(nd) + F.lit(1.0))
    fd = F.lit(2.0) * (q75 - q25) * F.pow(nd, F.lit(-1.0 / 3.0))
    half_sqrt = rng / F.sqrt(nd) / F.lit(2.0)
    width = F.least(F.greatest(fd, half_sqrt), sturges)
    width = F.when(integral & (width < 1), F.lit(1.0)).otherwise(width)
    return F.when(rng > 0, F.ceil(rng / width)).otherwise(F.lit(1)).cast("int")


INTEGER_FEATURES = ("num_items",)


def density_histogram(long: DataFrame, bins="auto", integer_features=INTEGER_FEATURES) -> DataFrame:
    """Equal-width density histogram per (feature, cohort) over [min, max].

    ``long`` is ``(generator, feature, value double)``. ``bins`` is an int or ``"auto"`` (the
    bin count is chosen per cohort from its size and IQR, as the original's plots do;
    ``integer_features`` get bins at least 1 wide). The last bin is closed on the right; a
    constant sample gets one bin ``[v-0.5, v+0.5]``; the quartiles are exact.
    """
    return histogram_of(distribution(long, "double"), bins, integer_features)


def histogram_of(dist: DataFrame, bins="auto", integer_features=INTEGER_FEATURES, stats: DataFrame | None = None) -> DataFrame:
    """:func:`density_histogram` from the counts of :func:`distribution` (values as double) and their :func:`bin_stats`."""
    vals = dist.filter(F.col("value").isNotNull())
    st = bin_stats(dist) if stats is None else stats
    if bins == "auto":
        qs = quantiles_of_counts(vals, ["feature", "generator"], "value", [0.25, 0.75])
        st = st.join(qs.drop("n_values"), ["feature", "generator"])
        integral = F.col("feature").isin(*integer_features) if integer_features else F.lit(False)
        nb = auto_bins(F.col("n"), F.col("lo"), F.col("hi"), F.col("q0"), F.col("q1"), integral)
    else:
        nb = F.lit(int(bins))
    flat = F.col("hi") <= F.col("lo")
    st = st.withColumn("nbins", nb).withColumn(
        "width", F.when(flat, F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")) / F.col("nbins"))) \
        .withColumn("lo", F.when(flat, F.col("lo") - F.lit(0.5)).otherwise(F.col("lo")))
    st = st.select("feature", "generator", "n", "lo", "width", "nbins")
    # st: features x cohorts rows -> bounded broadcast
    j = vals.join(F.broadcast(st), ["feature", "generator"])
    binned = j.select("feature", "generator", "c", F.least(
        F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.col("nbins") - 1).cast("int").alias("bin"))
    counts = binned.groupBy("feature", "generator", "bin").agg(F.sum("c").alias("cnt"))
    grid = st.select("feature", "generator", "n", "lo", "width",
                     F.explode(F.sequence(F.lit(0), F.col("nbins") - 1)).alias("bin"))
    out = grid.join(counts, ["feature", "generator", "bin"], "left")
    cnt = F.coalesce("cnt", F.lit(0))
    return out.select(
        "feature", "generator", "bin",
        stat6(F.col("lo") + F.col("bin") * F.col("width")).alias("bin_lo"),
        stat6(F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_hi"),
        cnt.alias("cnt"),
        stat6(cnt / (F.col("n") * F.col("width"))).alias("density"))


KDE_TOLERANCE = 1e-10
BOX = 0.25  # half a box of the fast Gauss transform, in units of sqrt(2) bandwidths


def hermite_terms(tolerance: float) -> int:
    """Terms of the Hermite expansion about a box's centre that leave an error of at most ``tolerance`` per unit of weight.

    The k-th term is at most 1.09 · BOX^k · sqrt(2^k / k!) (Cramér's bound), which is less than half of the one
    before, so twice the first omitted one bounds the rest.
    """
    p = 1
    while 2 * 1.09 * BOX ** p * math.sqrt(2.0 ** p / math.factorial(p)) > tolerance:
        p += 1
    return p


def hermite_coefficients(k: int) -> list[int]:
    """Coefficients of the Hermite polynomial H_k by power, by H_(k+1) = 2 t H_k - 2 k H_(k-1)."""
    before, now = [], [1]
    for j in range(k):
        up = [0] + [2 * c for c in now]
        before, now = now, [c - 2 * j * (before[i] if i < len(before) else 0) for i, c in enumerate(up)]
    return now


def kde_curve(long: DataFrame, grid: int = 200, cut: float = 0.0, tolerance: float | None = KDE_TOLERANCE) -> DataFrame:
    """Gaussian kernel density per (feature, cohort) on ``grid`` points.

    Bandwidth by Scott's rule ``h = n^(-1/5)·stddev``; grid from ``min - cut·h`` to ``max + cut·h`` (by
    default the range of the data, as a histogram with a density line draws it). By a binned fast Gauss transform, whose cost is
    linear in the distinct values: these fall into boxes a fraction of the bandwidth wide, each box keeps a few moments, and
    grid points meet the boxes in reach. The density is off by at most ``2 · tolerance`` times one kernel's peak at its full weight,
    ``1 / (h·sqrt(2π))``. ``tolerance=None`` sums every distinct value at every point.
    """
    return kde_of(distribution(long, "double"), grid, cut, tolerance)


def kde_of(dist: DataFrame, grid: int = 200, cut: float = 0.0, tolerance: float | None = KDE_TOLERANCE,
           stats: DataFrame | None = None) -> DataFrame:
    """:func:`kde_curve` from the counts of :func:`distribution` (values as double) and their :func:`bin_stats`."""
    st = (bin_stats(dist) if stats is None else stats).filter((F.col("n") >= 2) & (F.col("sd") > 0)).select(
        "feature", "generator", "n", "lo", "hi",
        (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"))
    g_lo = F.col("lo") - F.lit(cut) * F.col("h")
    step = (F.col("hi") + F.lit(cut) * F.col("h") - g_lo) / (grid - 1)
    centres = dist.filter(F.col("value").isNotNull()).select(
        "feature", "generator", F.col("value").alias("centre"), F.col("c").alias("cnt"))
    pts = st.select("feature", "generator", "n", "h", "lo", "hi",
                    F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("grid_idx")) \
        .withColumn("x", g_lo + F.col("grid_idx") * step)
    if tolerance is None:
        # pts: features x cohorts x grid rows (bounded by parameters) -> broadcast, so every centre
        # row meets its grid points in the task that holds it
        z = (F.col("x") - F.col("centre")) / F.col("h")
        dens = centres.join(F.broadcast(pts), ["feature", "generator"]).groupBy("feature", "generator", "grid_idx").agg(
            F.sum(F.col("cnt") * F.exp(F.lit(-0.5) * z * z)).alias("s"))
    else:
        dens = _fast_gauss(centres, st.withColumn("g_lo", g_lo).withColumn("step", step), grid, tolerance)
    return pts.join(dens, ["feature", "generator", "grid_idx"], "left").select(
        "feature", "generator", "grid_idx", stat6(F.col("x")).alias("x"),
        stat6(F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


def _fast_gauss(centres: DataFrame, st: DataFrame, grid: int, tolerance: float) -> DataFrame:
    """(feature, generator, grid_idx, s): the sums of the kernels (of height 1) at the grid points.

    With s = (v - c) / (sqrt(2) h) and t = (x - c) / (sqrt(2) h) about the centre c of v's box,
    exp(-(t - s)^2) = exp(-t^2) · sum over k of s^k / k! · H_k(t): a box keeps the sums of weight · s^k / k!, which give one polynomial in t.
    """
    terms = hermite_terms(tolerance)
    reach = BOX + math.sqrt(-math.log(tolerance))  # beyond it a kernel is below the tolerance
    unit = F.col("h") * F.lit(math.sqrt(2.0))
    box = F.floor((F.col("centre") - F.col("lo")) / (F.lit(2 * BOX) * unit))
    # st: features x cohorts rows
    boxed = centres.join(F.broadcast(st), ["feature", "generator"]).withColumn("box", box)
    middle = F.col("lo") + (F.col("box") + F.lit(0.5)) * F.lit(2 * BOX) * unit
    boxed = boxed.withColumn("off", (F.col("centre") - middle) / unit)
    moments = boxed.groupBy("feature", "generator", "box", "h", "lo", "g_lo", "step").agg(
        *[F.sum(F.col("cnt") * F.pow(F.col("off"), F.lit(float(k))) / F.lit(float(math.factorial(k)))).alias(f"a{k}") for k in range(terms)])
    hermite = [hermite_coefficients(k) for k in range(terms)]
    powers = []
    for j in range(terms):
        parts = [F.col(f"a{k}") * F.lit(float(h[j])) for k, h in enumerate(hermite) if j < len(h) and h[j]]
        powers.append(sum(parts[1:], parts[0]).alias(f"b{j}"))
    first = F.greatest(F.lit(0), F.ceil((middle - F.lit(reach) * unit - F.col("g_lo")) / F.col("step"))).cast("int")
    last = F.least(F.lit(grid - 1), F.floor((middle + F.lit(reach) * unit - F.col("g_lo")) / F.col("step"))).cast("int")
    near = moments.select("feature", "generator", "h", "g_lo", "step", middle.alias("middle"), first.alias("first"), last.alias("last"), *powers)
    near = near.where("first <= last").withColumn("grid_idx", F.explode(F.sequence("first", "last")))
    t = (F.col("g_lo") + F.col("grid_idx") * F.col("step") - F.col("middle")) / unit
    near = near.withColumn("t", t)
    value = F.col(f"b{terms - 1}")
    for j in range(terms - 2, -1, -1):
        value = value * F.col("t") + F.col(f"b{j}")
    return near.groupBy("feature", "generator", "grid_idx").agg(F.sum(value * F.exp(-F.col("t") * F.col("t"))).alias("s"))


def weekly_spend_long(receipts: DataFrame) -> DataFrame:
    """Average weekly spend per customer as a long feature frame (input of F6)."""
    return _avg_weekly(receipts).select("generator", F.lit("avg_weekly_spend").alias("feature"),
                                        F.col("avg_weekly").alias("value"))


def topn_overlap(items: DataFrame, n: int = K.TOP_ITEMS_FIDELITY, column: str = "item_name",
                 a: str = A, b: str = B) -> DataFrame:
    """Values common to both cohorts' top-n lists, as a count and a share of n."""
    t = top_n(value_counts(items, column), column, n)
    flags = t.groupBy(column).agg(
        F.max(F.when(F.col("generator") == a, 1).otherwise(0)).alias("in_a"),
        F.max(F.when(F.col("generator") == b, 1).otherwise(0)).alias("in_b"))
    res = flags.agg(F.sum(F.col("in_a") * F.col("in_b")).alias("n_common"),
                    F.sum("in_a").alias("n_top_a"), F.sum("in_b").alias("n_top_b"))
    both = (F.coalesce("n_top_a", F.lit(0)) > 0) & (F.coalesce("n_top_b", F.lit(0)) > 0)
    return res.select(
        F.lit(n).alias("top_n"),
        F.coalesce("n_top_a", F.lit(0)).cast("bigint").alias("n_top_a"),
        F.coalesce("n_top_b", F.lit(0)).cast("bigint").alias("n_top_b"),
        F.when(both, F.col("n_common").cast("bigint")).alias("n_common"),
        F.when(both, stat6(F.col("n_common") / F.lit(n))).alias("overlap"),
        F.when(both, F.lit("ok")).otherwise(F.lit("missing")).alias("status"))


def category_compare(items: DataFrame, column: str = "category", a: str = A, b: str = B) -> DataFrame:
    """Side-by-side frequency and share per value for the two cohorts.

    Conditional sums grouped by the value give the full outer join in one aggregate; cohort
    totals are scalar subqueries.
    """
    vc = materialize(value_counts(items, column))   # distinct values; read three times
    wide = vc.groupBy(column).agg(
        F.sum(F.when(F.col("generator") == a, F.col("cnt")).otherwise(0)).alias("cnt_a"),
        F.sum(F.when(F.col("generator") == b, F.col("cnt")).otherwise(0)).alias("cnt_b"))
    tot_a = vc.filter(F.col("generator") == a).agg(F.sum("cnt")).scalar()
    tot_b = vc.filter(F.col("generator") == b).agg(F.sum("cnt")).scalar()
    share_a = F.col("cnt_a") / tot_a
    share_b = F.col("cnt_b") / tot_b
    return wide.select(
        column, F.col("cnt_a").cast("bigint").alias("cnt_a"), F.col("cnt_b").cast("bigint").alias("cnt_b"),
        stat6(share_a).alias("share_a"), stat6(share_b).alias("share_b"),
        stat6(F.abs(share_a - share_b)).alias("abs_diff"))
