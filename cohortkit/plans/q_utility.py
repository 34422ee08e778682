"""Utility queries over the receipt fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.functions.scalars import MONEY, tax_of
from cohortkit.operators import utility as U
from cohortkit.plans.registry import register
from cohortkit.plans.sqlviews import sql_topn, with_views
from cohortkit.session import materialize
from cohortkit.sources.fixtures import cohort_of, items_fx, receipts_fx
from cohortkit.sources.tables import load

COHORTS_SQL = "(VALUES ('Statistical'), ('LLM')) AS g(generator)"


@register("spend_summary", with_views(f"""
SELECT g.generator,
       coalesce(s.n_receipts, 0) AS n_receipts,
       coalesce(s.n_values, 0) AS n_values,
       round(s.avg_total, 6) AS avg_total,
       round(s.median_total, 6) AS median_total,
       CASE WHEN coalesce(s.n_receipts, 0) = 0 THEN 'empty'
            WHEN coalesce(s.n_values, 0) = 0 THEN 'missing' ELSE 'ok' END AS status
FROM {COHORTS_SQL}
LEFT JOIN (SELECT generator, count(*) AS n_receipts, count(total_amount) AS n_values,
                  cast(sum(total_amount) AS DOUBLE) / count(total_amount) AS avg_total,
                  median(cast(total_amount AS DOUBLE)) AS median_total
           FROM receipts_fx GROUP BY generator) s ON s.generator = g.generator
""", "receipts_fx"))
def q_spend_summary(spark, sf_dir):
    return U.spend_summary(spark, receipts_fx(spark, sf_dir))


@register("weekly_spend", with_views("SELECT * FROM weekly_fx", "weekly_fx"))
def q_weekly_spend(spark, sf_dir):
    return U.weekly_spend(receipts_fx(spark, sf_dir))


@register("avg_weekly_spend", with_views("""
SELECT generator, customer_id, n_weeks, round(avg_weekly, 6) AS avg_weekly_spend FROM avg_weekly_fx
""", "avg_weekly_fx"))
def q_avg_weekly_spend(spark, sf_dir):
    return U.avg_weekly_spend(receipts_fx(spark, sf_dir))


@register("avg_weekly_spend_summary", with_views("""
SELECT generator, count(*) AS n_customers, round(avg(avg_weekly), 6) AS mean_avg_weekly,
       round(median(avg_weekly), 6) AS median_avg_weekly
FROM avg_weekly_fx GROUP BY generator
""", "avg_weekly_fx"))
def q_avg_weekly_spend_summary(spark, sf_dir):
    return U.avg_weekly_spend_summary(receipts_fx(spark, sf_dir))


@register("item_counts", with_views("""
SELECT generator, item_name, count(*) AS cnt FROM items_fx WHERE item_name IS NOT NULL GROUP BY generator, item_name
""", "items_fx"))
def q_item_counts(spark, sf_dir):
    return U.value_counts(items_fx(spark, sf_dir), "item_name")


@register("category_counts", with_views("""
SELECT generator, category, count(*) AS cnt FROM items_fx WHERE category IS NOT NULL GROUP BY generator, category
""", "items_fx"))
def q_category_counts(spark, sf_dir):
    return U.value_counts(items_fx(spark, sf_dir), "category")


@register("top10_items", with_views(sql_topn("items_fx", "item_name", K.TOP_ITEMS_UTILITY), "items_fx"))
def q_top10_items(spark, sf_dir):
    return U.top_n(U.value_counts(items_fx(spark, sf_dir), "item_name"), "item_name", K.TOP_ITEMS_UTILITY)


@register("top5_categories", with_views(sql_topn("items_fx", "category", K.TOP_CATEGORIES_UTILITY), "items_fx"))
def q_top5_categories(spark, sf_dir):
    return U.top_n(U.value_counts(items_fx(spark, sf_dir), "category"), "category", K.TOP_CATEGORIES_UTILITY)


@register("top15_items", with_views(sql_topn("items_fx", "item_name", K.TOP_ITEMS_FIDELITY), "items_fx"))
def q_top15_items(spark, sf_dir):
    return U.top_n(U.value_counts(items_fx(spark, sf_dir), "item_name"), "item_name", K.TOP_ITEMS_FIDELITY)


@register("frequent_items", with_views(sql_topn("items_fx", "item_name", K.TOP_ITEMS_FIDELITY), "items_fx"))
def q_frequent_items(spark, sf_dir):
    """The top 15 items per cohort by a sketch and the recount of its candidates."""
    from cohortkit.operators.frequent import top_frequent
    items = materialize(items_fx(spark, sf_dir).select("generator", "item_name"))
    return top_frequent(items, "item_name", K.TOP_ITEMS_FIDELITY)


@register("top15_lists", with_views(f"""
SELECT generator, list(item_name ORDER BY rank) AS top_item_names
FROM ({sql_topn("items_fx", "item_name", K.TOP_ITEMS_FIDELITY)}) t GROUP BY generator
""", "items_fx"))
def q_top15_lists(spark, sf_dir):
    t = U.top_n(U.value_counts(items_fx(spark, sf_dir), "item_name"), "item_name", K.TOP_ITEMS_FIDELITY)
    return U.top_list(t, "item_name")


@register("day_of_week", with_views("""
WITH c AS (SELECT generator, dayname(receipt_datetime) AS day_of_week, count(*) AS n
           FROM receipts_fx WHERE receipt_datetime IS NOT NULL GROUP BY ALL)
SELECT g.generator, d.day_idx, d.day_of_week, coalesce(c.n, 0) AS n_receipts
FROM (SELECT DISTINCT generator FROM c) g CROSS JOIN weekdays d
LEFT JOIN c ON c.generator = g.generator AND c.day_of_week = d.day_of_week
""", "receipts_fx", "weekdays"))
def q_day_of_week(spark, sf_dir):
    return U.day_of_week(spark, receipts_fx(spark, sf_dir))


@register("utility_flag", with_views(f"""
SELECT g.generator,
       coalesce(r.n_receipts, 0) > 0 AND (coalesce(r.n_totals, 0) > 0 OR coalesce(w.n_weekly, 0) > 0
         OR coalesce(i.n_items, 0) > 0 OR coalesce(r.n_dates, 0) > 0) AS analysis_possible
FROM {COHORTS_SQL}
LEFT JOIN (SELECT generator, count(*) AS n_receipts, count(total_amount) AS n_totals, count(receipt_datetime) AS n_dates
           FROM receipts_fx GROUP BY generator) r ON r.generator = g.generator
LEFT JOIN (SELECT generator, count(*) AS n_items FROM items_fx GROUP BY generator) i ON i.generator = g.generator
LEFT JOIN (SELECT generator, count(*) AS n_weekly FROM weekly_fx GROUP BY generator) w ON w.generator = g.generator
""", "receipts_fx", "items_fx", "weekly_fx"))
def q_utility_flag(spark, sf_dir):
    return U.utility_flag(spark, receipts_fx(spark, sf_dir), items_fx(spark, sf_dir))


@register("cohort_counts", with_views(f"""
SELECT g.generator, coalesce(r.n, 0) AS n_receipts, coalesce(i.n, 0) AS n_item_lines
FROM {COHORTS_SQL}
LEFT JOIN (SELECT generator, count(*) AS n FROM receipts_fx GROUP BY generator) r ON r.generator = g.generator
LEFT JOIN (SELECT generator, count(*) AS n FROM items_fx GROUP BY generator) i ON i.generator = g.generator
""", "receipts_fx", "items_fx"))
def q_cohort_counts(spark, sf_dir):
    from cohortkit.operators.report import cohort_counts
    return cohort_counts(spark, receipts_fx(spark, sf_dir), items_fx(spark, sf_dir))


@register("receipt_rollup", with_views("""
SELECT generator, receipt_id, customer_id, cast(count(*) AS INTEGER) AS num_items,
       cast(sum(item_total) AS DECIMAL(18,2)) AS subtotal,
       cast(round(sum(item_total) * 0.08, 2) AS DECIMAL(18,2)) AS tax,
       cast(sum(item_total) + round(sum(item_total) * 0.08, 2) AS DECIMAL(18,2)) AS total_amount
FROM items_fx GROUP BY generator, receipt_id, customer_id
""", "items_fx"))
def q_receipt_rollup(spark, sf_dir):
    from cohortkit.operators.report import receipt_rollup
    return receipt_rollup(items_fx(spark, sf_dir))


@register("header_line_reconcile", with_views("""
WITH h AS (SELECT 'ORD_' || cast(o_orderkey AS VARCHAR) AS receipt_id,
                  CASE WHEN o_orderkey % 10 = 0 THEN 'LLM' ELSE 'Statistical' END AS generator FROM orders),
     l AS (SELECT receipt_id, generator, count(*) AS n FROM items_fx GROUP BY receipt_id, generator),
     o AS (SELECT generator, count(*) AS n FROM items_fx WHERE receipt_id NOT IN (SELECT receipt_id FROM h)
           GROUP BY generator)
SELECT h.generator, count(*) AS n_headers, count(l.n) AS n_headers_with_lines,
       count(*) - count(l.n) AS n_headers_without_lines, cast(coalesce(sum(l.n), 0) AS BIGINT) AS n_lines,
       coalesce(max(o.n), 0) AS n_orphan_lines
FROM h LEFT JOIN l ON l.receipt_id = h.receipt_id AND l.generator = h.generator LEFT JOIN o ON o.generator = h.generator
GROUP BY h.generator
""", "items_fx"))
def q_header_line_reconcile(spark, sf_dir):
    from cohortkit.operators.report import header_line_reconcile
    orders = load(spark, sf_dir, "orders", "o_orderkey")
    headers = orders.select(F.concat(F.lit("ORD_"), F.col("o_orderkey").cast("string")).alias("receipt_id"),
                            cohort_of(F.col("o_orderkey")).alias("generator"))
    return header_line_reconcile(headers, items_fx(spark, sf_dir))
