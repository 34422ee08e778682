"""Utility evaluation per cohort.

All inputs are long frames with a ``generator`` column; every metric is one ``groupBy`` with
map-side partial aggregation, so skewed cohorts or customers only cost a bigger partial.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.functions.scalars import MONEY, weekday_name
from cohortkit.operators.cohorts import mean_exact, per_cohort, stat6, status_of
from cohortkit.operators.quantiles import exact_median


def _median(df: DataFrame, value: str) -> DataFrame:
    """``(generator, median)``, exact, with no group in one task."""
    return exact_median(df, "generator", value).select("generator", "median")


def spend_summary(spark: SparkSession, receipts: DataFrame) -> DataFrame:
    """Mean and median receipt total per cohort (A2) with availability status."""
    from cohortkit.session import materialize
    receipts = materialize(receipts.select("generator", "total_amount"), of=receipts)
    agg = receipts.groupBy("generator").agg(
        F.count(F.lit(1)).alias("n_receipts"),
        F.count("total_amount").alias("n_values"),
        mean_exact(F.col("total_amount")).alias("avg_total"),
    ).join(_median(receipts, "total_amount").withColumnRenamed("median", "median_total"),
           "generator", "left")
    out = per_cohort(spark, agg)
    return out.select(
        "generator",
        F.coalesce("n_receipts", F.lit(0)).alias("n_receipts"),
        F.coalesce("n_values", F.lit(0)).alias("n_values"),
        stat6(F.col("avg_total")).alias("avg_total"),
        stat6(F.col("median_total")).alias("median_total"),
        status_of(F.col("n_receipts"), F.col("n_values")).alias("status"),
    )


def _weekly_input(receipts: DataFrame) -> DataFrame:
    """Receipts usable for weekly spend: non-null keys and total, in cohorts with more than one
    customer and more than one week (A3).

    ``nunique() > 1`` is tested as ``min <> max``: one pass, no distinct aggregation.
    """
    from cohortkit.session import materialize
    # the shown customer_id is a short hash, which customers can share: where the frame has the key, it groups
    key = F.col("customer_key") if "customer_key" in receipts.columns else F.col("customer_id")
    # read twice (guard and groups): materialize the columns once
    f = materialize(receipts.select("generator", "customer_id", key.alias("customer_key"), "week_num", "total_amount")
                    .dropna(subset=["customer_id", "week_num", "total_amount"]), of=receipts)
    guard = (f.groupBy("generator")
             .agg(F.min("customer_key").alias("c0"), F.max("customer_key").alias("c1"),
                  F.min("week_num").alias("w0"), F.max("week_num").alias("w1"))
             .filter((F.col("c0") != F.col("c1")) & (F.col("w0") != F.col("w1")))
             .select("generator"))
    # one row per cohort at most: a size-proven broadcast
    return f.join(F.broadcast(guard), "generator", "left_semi")


def weekly_spend(receipts: DataFrame) -> DataFrame:
    """Spend per cohort, customer and week (A4)."""
    return _weekly(receipts).drop("customer_key")


def _weekly(receipts: DataFrame) -> DataFrame:
    return (_weekly_input(receipts)
            .groupBy("generator", "customer_key", "customer_id", "week_num")
            .agg(F.sum("total_amount").cast(MONEY).alias("weekly_total")))


def _avg_weekly(receipts: DataFrame) -> DataFrame:
    return (_weekly(receipts)
            .groupBy("generator", "customer_key", "customer_id")
            .agg(F.count(F.lit(1)).alias("n_weeks"), mean_exact(F.col("weekly_total")).alias("avg_weekly")))


def avg_weekly_spend(receipts: DataFrame) -> DataFrame:
    """Mean weekly spend per customer over the weeks with a receipt (A5)."""
    return _avg_weekly(receipts).select("generator", "customer_id", "n_weeks",
                                         stat6(F.col("avg_weekly")).alias("avg_weekly_spend"))


def avg_weekly_spend_summary(receipts: DataFrame) -> DataFrame:
    """Mean and median over customers of the mean weekly spend.

    One value per customer: the distributed median keeps that from landing in one task.
    """
    from cohortkit.session import materialize
    aw = materialize(_avg_weekly(receipts))
    agg = aw.groupBy("generator").agg(F.count(F.lit(1)).alias("n_customers"), F.avg("avg_weekly").alias("mean"))
    return agg.join(_median(aw, "avg_weekly"), "generator", "left").select(
        "generator", "n_customers", stat6(F.col("mean")).alias("mean_avg_weekly"),
        stat6(F.col("median")).alias("median_avg_weekly"))


WEIGHT = "_lines"


def line_weight(items: DataFrame):
    """Row weight of an items frame: 1 per line, or the ``_lines`` count of a pre-aggregated one."""
    return F.col(WEIGHT) if WEIGHT in items.columns else F.lit(1)


def item_stats(items: DataFrame) -> DataFrame:
    """Items pre-aggregated to (cohort, item, category) with their line count: everything the
    item metrics read, one pass over the lines."""
    return items.groupBy("generator", "item_name", "category").agg(F.count(F.lit(1)).alias(WEIGHT))


def value_counts(items: DataFrame, column: str) -> DataFrame:
    """Frequency of each non-null value per cohort (A7, A8). Accepts raw or pre-aggregated items."""
    return (items.filter(F.col(column).isNotNull())
            .groupBy("generator", column).agg(F.sum(line_weight(items)).cast("bigint").alias("cnt")))


def top_n(counts: DataFrame, column: str, n: int) -> DataFrame:
    """Top ``n`` values per cohort by count, ties by value ascending (L2, Q10), for every cohort of the data.

    One aggregate and one ranked window; the filter on the rank lets each task keep its best ``n`` rows per
    cohort before the shuffle, so a cohort brings n rows per task to its window, not all its values.
    """
    w = Window.partitionBy("generator").orderBy(F.desc("cnt"), F.asc(column))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_list(top: DataFrame, column: str) -> DataFrame:
    """Ordered top list per cohort as an array."""
    return (top.groupBy("generator")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", column))), lambda s: s[column])
                 .alias(f"top_{column}s")))


def day_of_week(spark: SparkSession, receipts: DataFrame) -> DataFrame:
    """Receipts per weekday per cohort, all seven days in Monday-first order, zero-filled."""
    from cohortkit.session import materialize
    valid = receipts.filter(F.col("receipt_datetime").isNotNull())
    # at most cohorts x 7 rows, read twice
    counts = materialize(valid.groupBy("generator", weekday_name(F.col("receipt_datetime")).alias("day_of_week"))
                         .agg(F.count(F.lit(1)).alias("n_receipts")))
    days = F.array(*[F.lit(d) for d in K.WEEKDAYS])
    # every cohort with a valid date gets the seven fixed weekdays (a literal array, no join)
    grid = counts.select("generator").distinct().select(
        "generator", F.posexplode(days).alias("pos", "day_of_week")).withColumn("day_idx", (F.col("pos") + 1).cast("int"))
    return (grid.join(counts, ["generator", "day_of_week"], "left")
            .select("generator", "day_idx", "day_of_week", F.coalesce("n_receipts", F.lit(0)).alias("n_receipts")))


def utility_flag(spark: SparkSession, receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Whether at least one utility analysis ran per cohort."""
    from cohortkit.session import materialize
    keys = [c for c in ("customer_id", "customer_key") if c in receipts.columns]
    receipts = materialize(receipts.select("generator", *keys, "week_num", "total_amount", "receipt_datetime"), of=receipts)
    r = receipts.groupBy("generator").agg(
        F.count(F.lit(1)).alias("n_receipts"),
        F.count("total_amount").alias("n_totals"),
        F.count("receipt_datetime").alias("n_dates"))
    i = items.groupBy("generator").agg(F.sum(line_weight(items)).alias("n_items"))
    wk = _weekly_input(receipts).groupBy("generator").agg(F.count(F.lit(1)).alias("n_weekly"))
    out = per_cohort(spark, r, i, wk)
    ok = (F.coalesce("n_receipts", F.lit(0)) > 0) & (
        (F.coalesce("n_totals", F.lit(0)) > 0) | (F.coalesce("n_weekly", F.lit(0)) > 0)
        | (F.coalesce("n_items", F.lit(0)) > 0) | (F.coalesce("n_dates", F.lit(0)) > 0))
    return out.select("generator", ok.alias("analysis_possible"))
