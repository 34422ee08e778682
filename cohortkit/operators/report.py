"""Roll-ups, reconciliation, counts and the long metrics report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.functions.scalars import MONEY, tax_of
from cohortkit import constants as K
from cohortkit.operators import fidelity as FD
from cohortkit.operators import privacy as P
from cohortkit.operators import utility as U
from cohortkit.operators.cohorts import per_cohort
from cohortkit.session import materialize


def receipt_rollup(items: DataFrame) -> DataFrame:
    """Line count, subtotal, tax = round(subtotal × rate, 2) and total per receipt (A1)."""
    agg = items.groupBy("generator", "receipt_id", "customer_id").agg(
        F.count(F.lit(1)).cast("int").alias("num_items"), F.sum("item_total").cast(MONEY).alias("subtotal"))
    tax = tax_of(F.col("subtotal"))
    return agg.select("generator", "receipt_id", "customer_id", "num_items", "subtotal", tax.alias("tax"),
                      (F.col("subtotal") + tax).cast(MONEY).alias("total_amount"))


def cohort_counts(spark: SparkSession, receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Receipts and item lines per cohort."""
    r = receipts.groupBy("generator").agg(F.count(F.lit(1)).alias("n_receipts"))
    i = items.groupBy("generator").agg(F.count(F.lit(1)).alias("n_item_lines"))
    return per_cohort(spark, r, i).select(
        "generator", F.coalesce("n_receipts", F.lit(0)).alias("n_receipts"),
        F.coalesce("n_item_lines", F.lit(0)).alias("n_item_lines"))


def header_line_reconcile(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Headers with and without lines, and lines without a header, per cohort.

    Lines are counted per cohort and receipt first (partial aggregation), then one full outer join on both
    (an id can occur in several cohorts; null ids meet) answers all three questions.
    """
    per_receipt = items.groupBy(F.col("receipt_id").alias("l_id"), F.col("generator").alias("l_gen")).agg(F.count(F.lit(1)).alias("n"))
    h = headers.select("receipt_id", "generator", F.lit(1).alias("h"))
    j = h.join(per_receipt, F.col("receipt_id").eqNullSafe(F.col("l_id")) & F.col("generator").eqNullSafe(F.col("l_gen")), "full_outer")
    g = j.groupBy(F.coalesce("generator", "l_gen").alias("generator")).agg(
        F.count("h").alias("n_headers"),
        F.count(F.when(F.col("h").isNotNull(), F.col("n"))).alias("n_headers_with_lines"),
        F.coalesce(F.sum(F.when(F.col("h").isNotNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("n_orphan_lines"))
    return g.filter(F.col("n_headers") > 0).select(
        "generator", "n_headers", "n_headers_with_lines",
        (F.col("n_headers") - F.col("n_headers_with_lines")).alias("n_headers_without_lines"),
        "n_lines", "n_orphan_lines")


def generation_yield(spark: SparkSession, stat_receipts: DataFrame, stat_target, llm_receipts: DataFrame,
                     llm_target) -> DataFrame:
    """Actual / target per generator; no statistical target counts as 1, no LLM target as 0.

    Targets are ints or scalar Columns; counts are scalar subqueries.
    """
    def col(x):
        return F.lit(x) if isinstance(x, int) else x

    st, lt = col(stat_target).cast("bigint"), col(llm_target).cast("bigint")
    sa = stat_receipts.agg(F.count(F.lit(1))).scalar()
    la = llm_receipts.agg(F.count(F.lit(1))).scalar()
    rows = spark.range(1).select(
        F.inline(F.array(
            F.struct(F.lit("Statistical").alias("generator"), st.alias("target"), sa.alias("actual"),
                     F.when(st > 0, F.round(sa / st, 6)).otherwise(F.lit(1.0)).alias("yield_ratio")),
            F.struct(F.lit("LLM").alias("generator"), lt.alias("target"), la.alias("actual"),
                     F.when(lt > 0, F.round(la / lt, 6)).otherwise(F.lit(0.0)).alias("yield_ratio")))))
    return rows


METRIC_COLUMNS = ["section", "generator", "metric", "key", "value", "text"]


def metric_rows(df: DataFrame, section: str, metric: str, generator=None, key=None, value=None, text=None) -> DataFrame:
    """Project any metric frame onto the long report schema."""
    def s(x):
        if x is None:
            return F.lit(None).cast("string")
        return (F.col(x) if isinstance(x, str) else x).cast("string")

    v = F.lit(None).cast("double") if value is None else (F.col(value) if isinstance(value, str) else value).cast("double")
    return df.select(F.lit(section).alias("section"), s(generator).alias("generator"), F.lit(metric).alias("metric"),
                     s(key).alias("key"), v.alias("value"), s(text).alias("text"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def fidelity_report(spark: SparkSession, receipts: DataFrame, items: DataFrame) -> DataFrame:
    """KS per feature, histograms and density curves, top-15 lists, their overlap and category shares (V1).

    One aggregate per input (counts per distinct value, counts per item) feeds every section.
    """
    items = materialize(U.item_stats(items))
    dist = FD.distribution(FD.unpivot_features(receipts))
    ks = FD.ks_of(spark, dist, K.FIDELITY_FEATURES)
    as_double = dist.withColumn("value", F.col("value").cast("double"))
    # features x cohorts x bins or points: read by several sections
    stats = FD.bin_stats(as_double)
    hist, kde = materialize(FD.histogram_of(as_double, stats=stats)), materialize(FD.kde_of(as_double, stats=stats))
    at = lambda c, n: F.concat_ws(" ", "feature", F.lpad(F.col(c).cast("string"), n, "0"))
    top = U.top_n(U.value_counts(items, "item_name"), "item_name", K.TOP_ITEMS_FIDELITY)
    ov = FD.topn_overlap(items)
    cc = FD.category_compare(items)
    rk = F.lpad(F.col("rank").cast("string"), 2, "0")
    return union_all([
        metric_rows(ks, "fidelity", "ks_d", key="feature", value="d", text="status"),
        metric_rows(ks, "fidelity", "ks_p_value", key="feature", value="p_value", text=F.coalesce("verdict", "status")),
        metric_rows(hist, "fidelity", "histogram_count", generator="generator", key=at("bin", 4), value="cnt"),
        metric_rows(hist, "fidelity", "histogram_low", generator="generator", key=at("bin", 4), value="bin_lo"),
        metric_rows(hist, "fidelity", "histogram_high", generator="generator", key=at("bin", 4), value="bin_hi"),
        metric_rows(hist, "fidelity", "histogram_density", generator="generator", key=at("bin", 4), value="density"),
        metric_rows(kde, "fidelity", "density_x", generator="generator", key=at("grid_idx", 3), value="x"),
        metric_rows(kde, "fidelity", "density_curve", generator="generator", key=at("grid_idx", 3), value="density"),
        metric_rows(top, "fidelity", "top15_item", generator="generator", key=rk, value="cnt", text="item_name"),
        metric_rows(ov, "fidelity", "top15_common", key=F.lit("item_name"), value="n_common", text="status"),
        metric_rows(cc, "fidelity", "category_share", generator=F.lit(FD.A), key="category", value="share_a"),
        metric_rows(cc, "fidelity", "category_share", generator=F.lit(FD.B), key="category", value="share_b"),
    ])


def utility_report(spark: SparkSession, receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Spend, weekly spend, popular items and categories, weekday trend, ran-flag (V2)."""
    keys = [c for c in ("customer_id", "customer_key") if c in receipts.columns]
    receipts = materialize(receipts.select("generator", *keys, "week_num", "total_amount", "receipt_datetime"), of=receipts)
    items = materialize(U.item_stats(items))
    sp = U.spend_summary(spark, receipts)
    aw = U.avg_weekly_spend_summary(receipts)
    t10 = U.top_n(U.value_counts(items, "item_name"), "item_name", K.TOP_ITEMS_UTILITY)
    t5 = U.top_n(U.value_counts(items, "category"), "category", K.TOP_CATEGORIES_UTILITY)
    dw = U.day_of_week(spark, receipts)
    fl = U.utility_flag(spark, receipts, items)
    rk = F.lpad(F.col("rank").cast("string"), 2, "0")
    return union_all([
        metric_rows(sp, "utility", "avg_total", generator="generator", value="avg_total", text="status"),
        metric_rows(sp, "utility", "median_total", generator="generator", value="median_total", text="status"),
        metric_rows(aw, "utility", "mean_avg_weekly", generator="generator", value="mean_avg_weekly"),
        metric_rows(aw, "utility", "median_avg_weekly", generator="generator", value="median_avg_weekly"),
        metric_rows(t10, "utility", "top10_item", generator="generator", key=rk, value="cnt", text="item_name"),
        metric_rows(t5, "utility", "top5_category", generator="generator", key=rk, value="cnt", text="category"),
        metric_rows(dw, "utility", "receipts_by_weekday", generator="generator",
                    key=F.concat(F.col("day_idx").cast("string"), F.lit(" "), F.col("day_of_week")), value="n_receipts"),
        metric_rows(fl, "utility", "analysis_possible", generator="generator",
                    value=F.col("analysis_possible").cast("int"),
                    text=F.when(F.col("analysis_possible"), F.lit("True")).otherwise(F.lit("False"))),
    ])


PII_NOTE = "no direct personal data by design"


def privacy_report(spark: SparkSession, receipts: DataFrame) -> DataFrame:
    """Extremes, high-uniqueness columns with verdict, id kind and the PII note (V3, V4, V5)."""
    receipts = materialize(receipts, of=receipts)
    ex = P.extremes(spark, receipts).filter(F.col("n_receipts") > 0)
    # exact ratios of the columns that sketches do not rule out; they feed the ratios and the verdict
    un = materialize(P.uniqueness_of(P.open_counts(receipts)).filter("flagged"))
    vd = materialize(P.verdict_from(receipts.select("generator").distinct(), un))
    return union_all([
        metric_rows(ex, "privacy", "max_total_amount", generator="generator", value="max_total_amount"),
        metric_rows(ex, "privacy", "max_num_items", generator="generator", value="max_num_items"),
        metric_rows(un, "privacy", "high_uniqueness", generator="generator", key="column_name", value="ratio"),
        metric_rows(vd, "privacy", "uniqueness_verdict", generator="generator", value=F.size("flagged_columns"),
                    text="verdict"),
        metric_rows(vd, "privacy", "customer_id_kind", generator="generator", text=P.id_kind(F.col("generator"))),
        metric_rows(vd, "privacy", "pii_check", generator="generator", text=F.lit(PII_NOTE)),
    ])


def write_report(report: DataFrame, path: str) -> None:
    """Store a metrics table as Parquet, one folder per section."""
    report.write.mode("overwrite").partitionBy("section").parquet(path)


RECOMMENDATIONS = [
    ("Statistical", "preferred for large, consistent structured data with known rules; fast and controllable"),
    ("LLM", "diverse examples but slow and numerically inconsistent; validate and use to augment"),
]


def summary_report(spark: SparkSession, yields: DataFrame, flags: DataFrame) -> DataFrame:
    """Yields, utility ran-flags and the fixed recommendation rows (V6)."""
    rec = spark.createDataFrame(RECOMMENDATIONS, "generator string, text string")
    pct = F.concat(F.format_number(F.col("yield_ratio") * 100, 1), F.lit("%"))
    return union_all([
        metric_rows(yields, "summary", "yield", generator="generator", value="yield_ratio", text=pct),
        metric_rows(flags, "summary", "utility_ran", generator="generator", value=F.col("analysis_possible").cast("int"),
                    text=F.when(F.col("analysis_possible"), F.lit("True")).otherwise(F.lit("False"))),
        metric_rows(rec, "summary", "recommendation", generator="generator", text="text"),
    ])
