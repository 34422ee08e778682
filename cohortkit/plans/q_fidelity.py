"""Fidelity queries over the receipt fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.operators import fidelity as FD
from cohortkit.plans.registry import register
from cohortkit.plans.sqlviews import sql_ks_pvalue, sql_topn, with_views
from cohortkit.sources.fixtures import items_fx, receipts_fx

FEATS_SQL = "(VALUES ('num_items'), ('subtotal'), ('total_amount')) AS f(feature)"

# lattice paths inside the band, row by row of the larger sample; rows are scaled to 1
EXACT_SQL = f"""
WITH RECURSIVE o AS (
  SELECT feature, greatest(n_a, n_b) AS n, least(n_a, n_b) AS m, CAST(round(d * n_a * n_b) AS BIGINT) AS k
  FROM ks WHERE status = 'ok' AND greatest(n_a, n_b) <= {FD.EXACT_LIMIT}),
lat AS (
  SELECT feature, n, m, k, CAST(0 AS BIGINT) AS i, unnest(range(0, CAST(least(m, ceil(k / n) - 1) AS BIGINT) + 1)) AS j, CAST(1 AS DOUBLE) AS a,
         CAST(0 AS DOUBLE) AS log_scale
  FROM o
  UNION ALL
  SELECT feature, n, m, k, i, j, a / top, log_scale + ln(top)
  FROM (SELECT *, max(a) OVER (PARTITION BY feature) AS top
        FROM (SELECT feature, n, m, k, i, j, log_scale, sum(a) OVER (PARTITION BY feature ORDER BY j) AS a
              FROM (SELECT feature, n, m, k, i + 1 AS i, next_j AS j, log_scale, CASE WHEN next_j = j THEN a ELSE 0 END AS a
                    FROM (SELECT *, unnest(CASE WHEN j = max(j) OVER (PARTITION BY feature)
                                                THEN range(j, greatest(j, CAST(least(m, ceil(((i + 1) * m + k) / n) - 1) AS BIGINT)) + 1) ELSE [j] END) AS next_j
                          FROM lat WHERE i < n) e) w
              WHERE j >= CAST(floor((i * m - k) / n) AS BIGINT) + 1 AND j <= ceil((i * m + k) / n) - 1) c) t
  WHERE top > 0)
SELECT feature, least(1, greatest(0, 1 - exp(ln(a) + log_scale - lgamma(n + m + 1) + lgamma(n + 1) + lgamma(m + 1)))) AS p
FROM lat WHERE i = n AND j = m AND a > 0"""

KS_CORE = f"""
WITH cnt AS (SELECT feature, value,
                    sum(CASE WHEN generator = 'Statistical' THEN 1 ELSE 0 END) AS ca,
                    sum(CASE WHEN generator = 'LLM' THEN 1 ELSE 0 END) AS cb
             FROM features_fx GROUP BY feature, value),
tot AS (SELECT feature, sum(ca) AS rows_a, sum(cb) AS rows_b,
               sum(CASE WHEN value IS NOT NULL THEN ca ELSE 0 END) AS n_a,
               sum(CASE WHEN value IS NOT NULL THEN cb ELSE 0 END) AS n_b
        FROM cnt GROUP BY feature),
cdf AS (SELECT feature, sum(ca) OVER w AS cum_a, sum(cb) OVER w AS cum_b FROM cnt WHERE value IS NOT NULL
        WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dm AS (SELECT c.feature, max(abs(cast(cum_a AS DOUBLE) / n_a - cast(cum_b AS DOUBLE) / n_b)) AS d
       FROM cdf c JOIN tot t ON t.feature = c.feature GROUP BY c.feature),
ks AS (SELECT f.feature, cast(coalesce(t.n_a, 0) AS BIGINT) AS n_a, cast(coalesce(t.n_b, 0) AS BIGINT) AS n_b, dm.d,
              CASE WHEN coalesce(t.rows_a, 0) = 0 OR coalesce(t.rows_b, 0) = 0 THEN 'empty'
                   WHEN coalesce(t.n_a, 0) = 0 OR coalesce(t.n_b, 0) = 0 THEN 'missing'
                   WHEN coalesce(t.n_a, 0) <= 1 OR coalesce(t.n_b, 0) <= 1 THEN 'not_enough_points'
                   ELSE 'ok' END AS status
       FROM {FEATS_SQL} LEFT JOIN tot t ON t.feature = f.feature LEFT JOIN dm ON dm.feature = f.feature),
ksp AS (SELECT ks.*, CASE WHEN status = 'ok' THEN CASE WHEN greatest(n_a, n_b) <= {FD.EXACT_LIMIT} THEN coalesce(x.p, 1)
                          ELSE {sql_ks_pvalue('d', 'n_a', 'n_b')} END END AS p,
               CASE WHEN status = 'ok' AND greatest(n_a, n_b) <= {FD.EXACT_LIMIT} THEN 'exact' ELSE 'asymptotic' END AS method
        FROM ks LEFT JOIN ({EXACT_SQL}) x ON x.feature = ks.feature)
"""


@register("ks_statistic", with_views(KS_CORE + """
SELECT feature, n_a, n_b, round(CASE WHEN status = 'ok' THEN d END, 6) AS d, round(p, 6) AS p_value,
       CASE WHEN status = 'ok' THEN CASE WHEN p < 0.05 THEN 'Distributions differ significantly'
                                         ELSE 'Distributions similar' END END AS verdict,
       status, method
FROM ksp
""", "features_fx"))
def q_ks_statistic(spark, sf_dir):
    return FD.ks_statistic(spark, receipts_fx(spark, sf_dir))


@register("ks_pvalue", with_views(KS_CORE + """
SELECT feature, round(p, 6) AS p_value, p < 0.05 AS significant FROM ksp WHERE status = 'ok'
""", "features_fx"))
def q_ks_pvalue(spark, sf_dir):
    ks = FD.ks_statistic(spark, receipts_fx(spark, sf_dir))
    return ks.filter(F.col("status") == "ok").select(
        "feature", "p_value", (F.col("verdict") == K.KS_DIFFER).alias("significant"))


def _hist_sql(long_sql: str) -> str:
    """Histogram with the "auto" bin rule per (feature, cohort), restated in SQL."""
    return f"""
WITH long AS ({long_sql}),
st0 AS (SELECT feature, generator, count(*) AS n, min(value) AS lo, max(value) AS hi,
               quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75
        FROM long WHERE value IS NOT NULL GROUP BY feature, generator),
st1 AS (SELECT *, least(greatest(2.0 * (q75 - q25) * pow(cast(n AS DOUBLE), -1.0 / 3.0),
                                 (hi - lo) / sqrt(cast(n AS DOUBLE)) / 2.0),
                        (hi - lo) / (log2(cast(n AS DOUBLE)) + 1.0)) AS w0 FROM st0),
st2 AS (SELECT *, CASE WHEN feature = 'num_items' AND w0 < 1 THEN CAST(1 AS DOUBLE) ELSE w0 END AS w FROM st1),
st AS (SELECT feature, generator, n, CASE WHEN hi > lo THEN lo ELSE lo - 0.5 END AS lo, nbins,
              CASE WHEN hi > lo THEN (hi - lo) / nbins ELSE CAST(1 AS DOUBLE) END AS width
       FROM (SELECT *, cast(CASE WHEN hi > lo THEN ceil((hi - lo) / w) ELSE 1 END AS INTEGER) AS nbins FROM st2) x),
c AS (SELECT l.feature, l.generator, cast(least(floor((l.value - st.lo) / st.width), st.nbins - 1) AS INTEGER) AS bin,
             count(*) AS cnt
      FROM long l JOIN st ON st.feature = l.feature AND st.generator = l.generator
      WHERE l.value IS NOT NULL GROUP BY ALL),
g AS (SELECT feature, generator, n, lo, width, cast(unnest(range(0, nbins)) AS INTEGER) AS bin FROM st)
SELECT g.feature, g.generator, g.bin, round(g.lo + g.bin * g.width, 6) AS bin_lo,
       round(g.lo + (g.bin + 1) * g.width, 6) AS bin_hi, coalesce(c.cnt, 0) AS cnt,
       round(coalesce(c.cnt, 0) / (g.n * g.width), 6) AS density
FROM g LEFT JOIN c ON c.feature = g.feature AND c.generator = g.generator AND c.bin = g.bin
"""


@register("density_histogram", with_views(
    _hist_sql("SELECT generator, feature, cast(value AS DOUBLE) AS value FROM features_fx"), "features_fx"))
def q_density_histogram(spark, sf_dir):
    return FD.density_histogram(FD.unpivot_features(receipts_fx(spark, sf_dir)))


@register("weekly_spend_histogram", with_views(
    _hist_sql("SELECT generator, 'avg_weekly_spend' AS feature, avg_weekly AS value FROM avg_weekly_fx"),
    "avg_weekly_fx"))
def q_weekly_spend_histogram(spark, sf_dir):
    return FD.density_histogram(FD.weekly_spend_long(receipts_fx(spark, sf_dir)))


KDE_GRID = 200


def _kde_sql(long_sql: str) -> str:
    """Exact Gaussian density over the range of the data, Scott bandwidth, restated in SQL."""
    return f"""
WITH long AS ({long_sql}),
st AS (SELECT feature, generator, count(*) AS n, min(value) AS lo, max(value) AS hi,
              stddev_samp(value) * pow(cast(count(*) AS DOUBLE), -0.2) AS h
       FROM long GROUP BY feature, generator HAVING count(*) >= 2 AND stddev_samp(value) > 0),
b AS (SELECT feature, generator, value AS centre, count(*) AS cnt FROM long GROUP BY ALL),
p AS (SELECT feature, generator, n, h, grid_idx, lo + grid_idx * ((hi - lo) / {KDE_GRID - 1}) AS x
      FROM (SELECT *, cast(unnest(range(0, {KDE_GRID})) AS INTEGER) AS grid_idx FROM st) s)
SELECT p.feature, p.generator, p.grid_idx, round(p.x, 6) AS x,
       round(sum(b.cnt * exp(-0.5 * ((p.x - b.centre) / p.h) * ((p.x - b.centre) / p.h))) / (p.n * p.h * sqrt(2 * pi())), 6)
         AS density
FROM b JOIN p ON p.feature = b.feature AND p.generator = b.generator
GROUP BY p.feature, p.generator, p.grid_idx, p.x, p.n, p.h
"""


@register("kde_curve", with_views(
    _kde_sql("SELECT generator, feature, cast(value AS DOUBLE) AS value FROM features_fx WHERE value IS NOT NULL"),
    "features_fx"))
def q_kde_curve(spark, sf_dir):
    """Density curves of the receipt features."""
    return FD.kde_curve(FD.unpivot_features(receipts_fx(spark, sf_dir)), grid=KDE_GRID)


@register("weekly_spend_kde", with_views(
    _kde_sql("SELECT generator, 'avg_weekly_spend' AS feature, avg_weekly AS value FROM avg_weekly_fx"), "avg_weekly_fx"))
def q_weekly_spend_kde(spark, sf_dir):
    """Density curve of the average weekly spend per customer."""
    return FD.kde_curve(FD.weekly_spend_long(receipts_fx(spark, sf_dir)), grid=KDE_GRID)


@register("topn_overlap", with_views(f"""
WITH t AS ({sql_topn("items_fx", "item_name", K.TOP_ITEMS_FIDELITY)}),
f AS (SELECT item_name, max(CASE WHEN generator = 'Statistical' THEN 1 ELSE 0 END) AS in_a,
             max(CASE WHEN generator = 'LLM' THEN 1 ELSE 0 END) AS in_b FROM t GROUP BY item_name),
r AS (SELECT sum(in_a * in_b) AS n_common, sum(in_a) AS n_top_a, sum(in_b) AS n_top_b FROM f)
SELECT {K.TOP_ITEMS_FIDELITY} AS top_n, cast(coalesce(n_top_a, 0) AS BIGINT) AS n_top_a,
       cast(coalesce(n_top_b, 0) AS BIGINT) AS n_top_b,
       CASE WHEN coalesce(n_top_a, 0) > 0 AND coalesce(n_top_b, 0) > 0 THEN cast(n_common AS BIGINT) END AS n_common,
       CASE WHEN coalesce(n_top_a, 0) > 0 AND coalesce(n_top_b, 0) > 0 THEN round(n_common / {K.TOP_ITEMS_FIDELITY}, 6) END AS overlap,
       CASE WHEN coalesce(n_top_a, 0) > 0 AND coalesce(n_top_b, 0) > 0 THEN 'ok' ELSE 'missing' END AS status
FROM r
""", "items_fx"))
def q_topn_overlap(spark, sf_dir):
    return FD.topn_overlap(items_fx(spark, sf_dir))


@register("category_compare", with_views("""
WITH vc AS (SELECT generator, category, count(*) AS cnt FROM items_fx WHERE category IS NOT NULL GROUP BY ALL),
w AS (SELECT category, sum(CASE WHEN generator = 'Statistical' THEN cnt ELSE 0 END) AS cnt_a,
             sum(CASE WHEN generator = 'LLM' THEN cnt ELSE 0 END) AS cnt_b FROM vc GROUP BY category),
t AS (SELECT sum(CASE WHEN generator = 'Statistical' THEN cnt END) AS ta,
             sum(CASE WHEN generator = 'LLM' THEN cnt END) AS tb FROM vc)
SELECT category, cast(cnt_a AS BIGINT) AS cnt_a, cast(cnt_b AS BIGINT) AS cnt_b,
       round(cnt_a / ta, 6) AS share_a, round(cnt_b / tb, 6) AS share_b,
       round(abs(cnt_a / ta - cnt_b / tb), 6) AS abs_diff
FROM w, t
""", "items_fx"))
def q_category_compare(spark, sf_dir):
    return FD.category_compare(items_fx(spark, sf_dir))


AVAIL_COLS = ["receipt_id", "customer_id", "store_name", "store_location", "receipt_datetime", "week_num",
              "num_items", "subtotal", "tax", "total_amount"]


@register("feature_availability", with_views("SELECT g.generator, c.column_name, coalesce(a.n_rows, 0) AS n_rows, "
    "coalesce(a.n_values, 0) AS n_values, CASE WHEN coalesce(a.n_rows, 0) = 0 THEN 'empty' "
    "WHEN coalesce(a.n_values, 0) = 0 THEN 'missing' ELSE 'ok' END AS status "
    "FROM (VALUES ('Statistical'), ('LLM')) AS g(generator) CROSS JOIN (VALUES "
    + ", ".join(f"('{c}')" for c in AVAIL_COLS) + ") AS c(column_name) LEFT JOIN ("
    + " UNION ALL ".join(f"SELECT generator, '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_values "
                         f"FROM receipts_fx GROUP BY generator" for c in AVAIL_COLS)
    + ") a ON a.generator = g.generator AND a.column_name = c.column_name", "receipts_fx"))
def q_feature_availability(spark, sf_dir):
    from cohortkit.operators.cohorts import feature_availability
    return feature_availability(spark, receipts_fx(spark, sf_dir), AVAIL_COLS)
