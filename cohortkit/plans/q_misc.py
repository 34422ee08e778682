"""Prompt, scalar and cross-cohort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.functions.scalars import iso_week
from cohortkit.operators import generate as G
from cohortkit.operators import validate as V
from cohortkit.operators.prompts import receipt_prompts
from cohortkit.plans.q_generate import md5_sql
from cohortkit.plans.q_validate import FIRST_N_SQL, N_SQL, _n, _parsed
from cohortkit.plans.registry import register
from cohortkit.plans.sqlviews import with_views
from cohortkit.sources.catalog import categories
from cohortkit.sources.fixtures import receipts_fx
from cohortkit.sources.tables import load

PROMPT_YEAR = 2025
NAMES_SQL = "[" + ", ".join(f"'{n}'" for _, n, _ in K.CATALOG) + "]"
# the domains are written out here, so that the oracle notices a wrong fill
_FILLED = (K.RECEIPT_PROMPT.replace("<STORES>", "['MegaMart', 'SuperGrocery', 'Local Foods', 'FreshMart']")
           .replace("<LOCATIONS>", "['Downtown', 'Uptown', 'Suburbia', 'Westside']").replace("<TAX_RATE>", "0.08")
           .replace("<CATEGORIES>", "['Produce', 'Dairy', 'Bakery', 'Pantry', 'Meat/Fish', 'Beverages', 'Snacks']"))
PROMPT_SQL = "'" + _FILLED.replace("'", "''") + "'"


@register("prompt_build", f"""
SELECT attempt, sample_items,
       replace(replace({PROMPT_SQL}, '<SAMPLE_ITEMS>', array_to_string(sample_items, ', ')), '<YEAR>', '{PROMPT_YEAR}')
         AS prompt
FROM (SELECT o_orderkey + 1 AS attempt,
             list_slice(list_transform(list_sort(list_transform({NAMES_SQL},
               lambda c: {{'h': {md5_sql('o_orderkey + 1', "'prompt'", 'c')}, 'c': c}})), lambda s: s.c), 1, 5)
               AS sample_items
      FROM orders) t
""")
def q_prompt_build(spark, sf_dir):
    attempts = load(spark, sf_dir, "orders", "o_orderkey").select((F.col("o_orderkey") + 1).alias("attempt"))
    return receipt_prompts(attempts, PROMPT_YEAR)


@register("iso_week", with_views("""
SELECT receipt_id, receipt_datetime, cast(weekofyear(receipt_datetime) AS INTEGER) AS iso_week,
       dayname(receipt_datetime) AS day_name FROM receipts_fx""", "receipts_fx"))
def q_iso_week(spark, sf_dir):
    from cohortkit.functions.scalars import weekday_name
    r = receipts_fx(spark, sf_dir)
    return r.select("receipt_id", "receipt_datetime", iso_week(F.col("receipt_datetime")).alias("iso_week"),
                    weekday_name(F.col("receipt_datetime")).alias("day_name"))


@register("coerce_datetime", with_views("""
SELECT attempt, CASE WHEN c IN (1, 2, 6, 8, 9, 17) THEN NULL ELSE cast(o_orderdate AS TIMESTAMP) END AS receipt_datetime
FROM resp_outcome""", "resp_outcome"))
def q_coerce_datetime(spark, sf_dir):
    return _parsed(spark, sf_dir).select("attempt", "receipt_datetime")


@register("category_domain", with_views("""
SELECT g.category, g.n_lines, list_contains(""" + "[" + ", ".join(f"'{c}'" for c in categories()) + """], g.category) AS in_catalog
FROM (SELECT category, count(*) AS n_lines FROM gen_lines GROUP BY category) g""", "gen_lines"))
def q_category_domain(spark, sf_dir):
    """Categories the generator produced, checked against the catalog's category domain."""
    from cohortkit.sources.catalog import category_array
    items = G.statistical_items(spark, load(spark, sf_dir, "customer", "c_custkey"))
    return items.groupBy("category").agg(F.count(F.lit(1)).alias("n_lines")).select(
        "category", "n_lines", F.array_contains(category_array(), F.col("category")).alias("in_catalog"))


COHORT_COLS = "receipt_id, customer_id, store_name, store_location, receipt_datetime, week_num, num_items, subtotal, tax, total_amount, generator"


@register("cohort_union", with_views(f"""
SELECT {COHORT_COLS} FROM gen_receipts_v
UNION ALL
SELECT {COHORT_COLS} FROM ({FIRST_N_SQL}) f""", "gen_receipts_v", "resp_receipts"))
def q_cohort_union(spark, sf_dir):
    """Statistical cohort (generator) and LLM cohort (first n validated responses) as one long
    frame (O1); every evaluation groups by ``generator``."""
    from cohortkit.operators.generate import HEADER_COLUMNS
    stat = G.statistical_receipts(spark, load(spark, sf_dir, "customer", "c_custkey"))
    llm = V.first_n_accepted(_parsed(spark, sf_dir), _n(spark, sf_dir)).select(*HEADER_COLUMNS)
    return stat.unionByName(llm)


@register("generation_yield", with_views(f"""
SELECT 'Statistical' AS generator, (SELECT count(*) FROM customer) * {K.N_WEEKS} AS target,
       (SELECT count(*) FROM gen_receipts_v) AS actual,
       CASE WHEN (SELECT count(*) FROM customer) * {K.N_WEEKS} > 0
            THEN round((SELECT count(*) FROM gen_receipts_v) / ((SELECT count(*) FROM customer) * {K.N_WEEKS}), 6)
            ELSE 1.0 END AS yield_ratio
UNION ALL
SELECT 'LLM', cast({N_SQL} AS BIGINT), (SELECT count(*) FROM ({FIRST_N_SQL}) f),
       CASE WHEN {N_SQL} > 0 THEN round((SELECT count(*) FROM ({FIRST_N_SQL}) f) / {N_SQL}, 6) ELSE 0.0 END
""", "gen_receipts_v", "resp_receipts"))
def q_generation_yield(spark, sf_dir):
    from cohortkit.operators.report import generation_yield
    customers = load(spark, sf_dir, "customer", "c_custkey")
    stat = G.statistical_receipts(spark, customers)
    n = _n(spark, sf_dir)
    llm = V.first_n_accepted(_parsed(spark, sf_dir), n)
    return generation_yield(spark, stat, customers.agg(F.count(F.lit(1)) * K.N_WEEKS).scalar(), llm, n)


# ---- the original run's comparison: generated cohort vs validated first-n cohort -----------------

from cohortkit.plans.q_fidelity import KS_CORE  # noqa: E402
from cohortkit.plans.sqlviews import view  # noqa: E402

view("e2e_receipts", f"""
SELECT {COHORT_COLS} FROM gen_receipts_v
UNION ALL
SELECT {COHORT_COLS} FROM ({FIRST_N_SQL}) f""", ["gen_receipts_v", "resp_receipts"])

view("e2e_features", """
SELECT generator, 'num_items' AS feature, cast(num_items AS DECIMAL(18,2)) AS value FROM e2e_receipts
UNION ALL SELECT generator, 'subtotal', cast(subtotal AS DECIMAL(18,2)) FROM e2e_receipts
UNION ALL SELECT generator, 'total_amount', cast(total_amount AS DECIMAL(18,2)) FROM e2e_receipts
""", ["e2e_receipts"])


def _e2e(spark, sf_dir):
    from cohortkit.session import materialize
    return materialize(q_cohort_union(spark, sf_dir))


@register("cohort_ks_statistic", with_views(KS_CORE.replace("features_fx", "e2e_features") + """
SELECT feature, n_a, n_b, round(CASE WHEN status = 'ok' THEN d END, 6) AS d, round(p, 6) AS p_value,
       CASE WHEN status = 'ok' THEN CASE WHEN p < 0.05 THEN 'Distributions differ significantly'
                                         ELSE 'Distributions similar' END END AS verdict,
       status, method
FROM ksp""", "e2e_features"))
def q_cohort_ks_statistic(spark, sf_dir):
    """KS of the generated statistical cohort against the validated LLM cohort (F1–F3 on the
    original run's two cohorts)."""
    from cohortkit.operators.fidelity import ks_statistic
    return ks_statistic(spark, _e2e(spark, sf_dir))


@register("cohort_spend_summary", with_views("""
SELECT g.generator, coalesce(s.n_receipts, 0) AS n_receipts, coalesce(s.n_values, 0) AS n_values,
       round(s.avg_total, 6) AS avg_total, round(s.median_total, 6) AS median_total,
       CASE WHEN coalesce(s.n_receipts, 0) = 0 THEN 'empty'
            WHEN coalesce(s.n_values, 0) = 0 THEN 'missing' ELSE 'ok' END AS status
FROM (VALUES ('Statistical'), ('LLM')) AS g(generator)
LEFT JOIN (SELECT generator, count(*) AS n_receipts, count(total_amount) AS n_values,
                  cast(sum(total_amount) AS DOUBLE) / count(total_amount) AS avg_total,
                  median(cast(total_amount AS DOUBLE)) AS median_total
           FROM e2e_receipts GROUP BY generator) s ON s.generator = g.generator""", "e2e_receipts"))
def q_cohort_spend_summary(spark, sf_dir):
    """Mean and median receipt total of the two generated cohorts (A2 on the original run's cohorts)."""
    from cohortkit.operators.utility import spend_summary
    return spend_summary(spark, _e2e(spark, sf_dir))
