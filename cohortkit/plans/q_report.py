"""Report queries (V1, V2, V3, V6): long metric tables; oracles compose the verified parts.

Each report runs over two pairs of cohorts: the order fixture, and the run's own cohorts (generated
receipts against the first n validated responses), whose oracle reads the ``e2e_*`` views instead.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.operators import generate as G
from cohortkit.operators import report as R
from cohortkit.operators import utility as U
from cohortkit.operators import validate as V
from cohortkit.plans import q_misc  # noqa: F401  its views are read here
from cohortkit.plans.q_validate import FIRST_N_SQL, _n, _parsed
from cohortkit.plans.registry import ORACLE, register
from cohortkit.plans.sqlviews import SQL_VIEWS, view, with_views
from cohortkit.session import materialize
from cohortkit.sources.fixtures import items_fx, receipts_fx
from cohortkit.sources.tables import load


def _m(sql: str, metric: str, generator="NULL", key="NULL", value="NULL", text="NULL", section="") -> str:
    return (f"SELECT '{section}' AS section, cast({generator} AS VARCHAR) AS generator, '{metric}' AS metric, "
            f"cast({key} AS VARCHAR) AS key, cast({value} AS DOUBLE) AS value, cast({text} AS VARCHAR) AS text "
            f"FROM ({sql}) t")


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


RK = "lpad(cast(rank AS VARCHAR), 2, '0')"
BIN = "feature || ' ' || lpad(cast(bin AS VARCHAR), 4, '0')"
POINT = "feature || ' ' || lpad(cast(grid_idx AS VARCHAR), 3, '0')"


def fidelity_sql(o) -> str:
    """The fidelity report from its parts; ``o`` gives the oracle of a query."""
    def m(*a, **k):
        return _m(*a, **k, section="fidelity")

    return _union([
        m(o("ks_statistic"), "ks_d", key="feature", value="d", text="status"),
        m(o("ks_statistic"), "ks_p_value", key="feature", value="p_value", text="coalesce(verdict, status)"),
        m(o("density_histogram"), "histogram_count", generator="generator", key=BIN, value="cnt"),
        m(o("density_histogram"), "histogram_low", generator="generator", key=BIN, value="bin_lo"),
        m(o("density_histogram"), "histogram_high", generator="generator", key=BIN, value="bin_hi"),
        m(o("density_histogram"), "histogram_density", generator="generator", key=BIN, value="density"),
        m(o("kde_curve"), "density_x", generator="generator", key=POINT, value="x"),
        m(o("kde_curve"), "density_curve", generator="generator", key=POINT, value="density"),
        m(o("top15_items"), "top15_item", generator="generator", key=RK, value="cnt", text="item_name"),
        m(o("topn_overlap"), "top15_common", key="'item_name'", value="n_common", text="status"),
        m(o("category_compare"), "category_share", generator="'Statistical'", key="category", value="share_a"),
        m(o("category_compare"), "category_share", generator="'LLM'", key="category", value="share_b"),
    ])


def utility_sql(o) -> str:
    def m(*a, **k):
        return _m(*a, **k, section="utility")

    return _union([
        m(o("spend_summary"), "avg_total", generator="generator", value="avg_total", text="status"),
        m(o("spend_summary"), "median_total", generator="generator", value="median_total", text="status"),
        m(o("avg_weekly_spend_summary"), "mean_avg_weekly", generator="generator", value="mean_avg_weekly"),
        m(o("avg_weekly_spend_summary"), "median_avg_weekly", generator="generator", value="median_avg_weekly"),
        m(o("top10_items"), "top10_item", generator="generator", key=RK, value="cnt", text="item_name"),
        m(o("top5_categories"), "top5_category", generator="generator", key=RK, value="cnt", text="category"),
        m(o("day_of_week"), "receipts_by_weekday", generator="generator",
          key="cast(day_idx AS VARCHAR) || ' ' || day_of_week", value="n_receipts"),
        m(o("utility_flag"), "analysis_possible", generator="generator", value="cast(analysis_possible AS INTEGER)",
          text="CASE WHEN analysis_possible THEN 'True' ELSE 'False' END"),
    ])


def privacy_sql(o) -> str:
    def m(*a, **k):
        return _m(*a, **k, section="privacy")

    extremes = "SELECT * FROM (" + o("privacy_extremes") + ") x WHERE n_receipts > 0"
    return _union([
        m(extremes, "max_total_amount", generator="generator", value="max_total_amount"),
        m(extremes, "max_num_items", generator="generator", value="max_num_items"),
        m("SELECT * FROM (" + o("privacy_uniqueness") + ") x WHERE flagged", "high_uniqueness",
          generator="generator", key="column_name", value="ratio"),
        m(o("privacy_verdict"), "uniqueness_verdict", generator="generator", value="len(flagged_columns)", text="verdict"),
        m(o("privacy_verdict"), "customer_id_kind", generator="generator",
          text="CASE WHEN generator = 'Statistical' THEN 'Hashed (Statistical)' ELSE 'Placeholder/Generated (LLM)' END"),
        m(o("privacy_verdict"), "pii_check", generator="generator", text=f"'{R.PII_NOTE}'"),
    ])


@register("fidelity_report", fidelity_sql(ORACLE.__getitem__))
def q_fidelity_report(spark, sf_dir):
    return R.fidelity_report(spark, receipts_fx(spark, sf_dir), items_fx(spark, sf_dir))


@register("utility_report", utility_sql(ORACLE.__getitem__))
def q_utility_report(spark, sf_dir):
    return R.utility_report(spark, receipts_fx(spark, sf_dir), items_fx(spark, sf_dir))


@register("privacy_report", privacy_sql(ORACLE.__getitem__))
def q_privacy_report(spark, sf_dir):
    return R.privacy_report(spark, receipts_fx(spark, sf_dir))


# ---- the run's own cohorts ---------------------------------------------------------------------

ITEM_COLS = "receipt_id, customer_id, item_name, category, quantity, unit_price, item_total, generator"


# the body of the validated lines' oracle, over the same views
ORACLE_ITEMS = """
SELECT o.attempt, l.pos, CASE WHEN o.c = 14 THEN NULL ELSE 'ORD_' || cast(o.order_key AS VARCHAR) END AS receipt_id,
       'CUST_S_' || substr(sha1(cast(o.o_custkey AS VARCHAR)), 1, 8) AS customer_id,
       l.item_name, l.category, cast(l.quantity AS BIGINT) AS quantity, l.unit_price,
       cast(CAST(l.quantity AS DECIMAL(18,0)) * l.unit_price AS DECIMAL(18,2)) AS item_total, 'LLM' AS generator
FROM resp_outcome o JOIN resp_lines l ON l.order_key = o.order_key
WHERE o.reason IS NULL AND l.problem IS NULL"""


@register("first_n_items", with_views(f"""
SELECT * FROM ({ORACLE_ITEMS}) i WHERE attempt IN (SELECT attempt FROM ({FIRST_N_SQL}) f)
""", "resp_receipts", "resp_outcome"))
def q_first_n_items(spark, sf_dir):
    """Lines of the first n accepted receipts."""
    parsed = materialize(_parsed(spark, sf_dir))
    return V.first_n_items(V.first_n_accepted(parsed, _n(spark, sf_dir)), parsed)


def _own_cohorts(spark, sf_dir):
    """Receipts and lines of the generated and of the first-n validated cohort, in one shape each (O1);
    responses are parsed once."""
    customers = load(spark, sf_dir, "customer", "c_custkey")
    parsed = materialize(_parsed(spark, sf_dir))
    first = materialize(V.first_n_accepted(parsed, _n(spark, sf_dir)))
    # the generator's customers are told apart by their key, a model's only by the id that it wrote
    receipts = G.statistical_receipts(spark, customers, keep_key=True).unionByName(
        first.select(*G.HEADER_COLUMNS, F.col("customer_id").alias("customer_key")))
    columns = ITEM_COLS.split(", ")
    kinds = {"quantity": "bigint"}
    lines = [d.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in columns])
             for d in (G.statistical_items(spark, customers), V.first_n_items(first, parsed))]
    return materialize(receipts), lines[0].unionByName(lines[1])


view("e2e_items", f"""
SELECT receipt_id, customer_id, item_name, category, cast(quantity AS BIGINT) AS quantity, unit_price, item_total,
       'Statistical' AS generator FROM gen_lines
UNION ALL
SELECT {ITEM_COLS} FROM ({ORACLE_ITEMS}) i WHERE attempt IN (SELECT attempt FROM ({FIRST_N_SQL}) f)
""", ["gen_lines", "resp_receipts", "resp_outcome"])


@register("cohort_items", with_views(f"SELECT {ITEM_COLS} FROM e2e_items", "e2e_items"))
def q_cohort_items(spark, sf_dir):
    """Lines of the generated and of the first-n validated cohort (O1)."""
    return _own_cohorts(spark, sf_dir)[1]


def _cte(name: str) -> str:
    return f"{name} AS (\n{SQL_VIEWS[name]}\n)"


def _own(part: str) -> str:
    """The oracle of a part query over the own cohorts, which outer views hold."""
    return (ORACLE[part].replace(_cte("priced_lines_fx") + ",\n", "")
            .replace(_cte("receipts_fx"), "receipts_fx AS (SELECT * FROM e2e_receipts)")
            .replace(_cte("items_fx"), "items_fx AS (SELECT * FROM e2e_items)"))


@register("cohort_fidelity_report", with_views(fidelity_sql(_own), "e2e_receipts", "e2e_items"))
def q_cohort_fidelity_report(spark, sf_dir):
    return R.fidelity_report(spark, *_own_cohorts(spark, sf_dir))


@register("cohort_utility_report", with_views(utility_sql(_own), "e2e_receipts", "e2e_items"))
def q_cohort_utility_report(spark, sf_dir):
    return R.utility_report(spark, *_own_cohorts(spark, sf_dir))


@register("cohort_privacy_report", with_views(privacy_sql(_own), "e2e_receipts"))
def q_cohort_privacy_report(spark, sf_dir):
    return R.privacy_report(spark, _own_cohorts(spark, sf_dir)[0])


SUMMARY_SQL = _union([
    _m(ORACLE["generation_yield"], "yield", generator="generator", value="yield_ratio",
       text="format('{:.1f}', yield_ratio * 100) || '%'", section="summary"),
    _m(with_views(_own("utility_flag"), "e2e_receipts", "e2e_items"), "utility_ran", generator="generator",
       value="cast(analysis_possible AS INTEGER)",
       text="CASE WHEN analysis_possible THEN 'True' ELSE 'False' END", section="summary"),
    _m("SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{t}')" for g, t in R.RECOMMENDATIONS) + ") AS r(generator, text)",
       "recommendation", generator="generator", text="text", section="summary"),
])


@register("summary_report", SUMMARY_SQL)
def q_summary_report(spark, sf_dir):
    """Yields and utility flags of the run's own cohorts, with the recommendations (V6)."""
    receipts, items = _own_cohorts(spark, sf_dir)
    customers = load(spark, sf_dir, "customer", "c_custkey")
    yields = R.generation_yield(
        spark, receipts.where(F.col("generator") == "Statistical"), customers.agg(F.count(F.lit(1)) * K.N_WEEKS).scalar(),
        receipts.where(F.col("generator") == "LLM"), _n(spark, sf_dir))
    return R.summary_report(spark, yields, U.utility_flag(spark, receipts, items))
