"""Privacy checks per cohort."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.functions.scalars import MONEY
from cohortkit.operators.cohorts import per_cohort, stat6
from cohortkit.session import materialize

EXCLUDED = ("receipt_id", "generator")
KEY = "customer_key"


def extremes(spark: SparkSession, receipts: DataFrame) -> DataFrame:
    """Largest receipt total and largest line count per cohort (A10)."""
    agg = receipts.groupBy("generator").agg(
        F.count(F.lit(1)).alias("n_receipts"),
        F.max("total_amount").cast(MONEY).alias("max_total_amount"),
        F.max("num_items").cast("int").alias("max_num_items"))
    return per_cohort(spark, agg).select(
        "generator", F.coalesce("n_receipts", F.lit(0)).alias("n_receipts"), "max_total_amount", "max_num_items")


def _counted(receipts: DataFrame) -> dict[str, str]:
    """Shown column -> the column that is counted: a ``customer_key`` stands for the shown ``customer_id``, which is a short hash that
    different customers can share."""
    cols = [c for c in receipts.columns if c not in (*EXCLUDED, KEY)]
    return {c: KEY if c == "customer_id" and KEY in receipts.columns else c for c in cols}


def _exact_counts(receipts: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``(generator, column_name, n_distinct)``: a narrow distinct per column, combined map-side; no row is copied for each column."""
    parts = [receipts.select("generator", F.col(of).alias("v")).where("v IS NOT NULL").distinct().groupBy("generator").agg(
        F.count(F.lit(1)).alias("n_distinct")).select("generator", F.lit(shown).alias("column_name"), "n_distinct")
        for shown, of in columns.items()]
    return reduce(DataFrame.unionAll, parts)


def _with_rows(receipts: DataFrame, columns: list[str]) -> DataFrame:
    """``(generator, n_rows, column_name)``: cohorts x columns rows."""
    rows = receipts.groupBy("generator").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select("generator", "n_rows", F.explode(F.array(*[F.lit(c) for c in columns]).cast("array<string>")).alias("column_name"))


def distinct_counts(receipts: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """``(generator, n_rows, column_name, n_distinct)`` for every column but the excluded ones (or for ``columns``), exact and computed
    once (cohorts x columns rows): it feeds the ratios and the verdict. ``receipts`` should be materialized."""
    columns = _counted(receipts) if columns is None else columns
    if not columns:
        return materialize(_with_rows(receipts, []).withColumn("n_distinct", F.lit(0).cast("long")))
    found = _exact_counts(receipts, columns)
    return materialize(_with_rows(receipts, list(columns)).join(found, ["generator", "column_name"], "left").select(
        "generator", "n_rows", "column_name", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")))


SKETCH_SIZE = 14  # log2 of the registers of a distinct-count sketch
SKETCH_ERROR = 5 * 1.04 / math.sqrt(1 << SKETCH_SIZE)  # five standard errors


def sketched_flags(receipts: DataFrame, ratio: float = K.UNIQUE_RATIO, min_distinct: int = K.UNIQUE_MIN_DISTINCT) -> DataFrame:
    """``(generator, n_rows, column_name, flagged)`` from one mergeable sketch per cohort and column: a pass over the rows, and what is shuffled is
    the sketches alone. ``flagged`` is null where the estimate's bounds (five standard errors) leave either threshold open."""
    columns = _counted(receipts)
    sketches = receipts.groupBy("generator").agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.hll_sketch_estimate(F.hll_sketch_agg(F.col(of).cast("string"), F.lit(SKETCH_SIZE))).alias(f"d_{c}") for c, of in columns.items()])
    pairs = ", ".join(f"'{c}', `d_{c}`" for c in columns)
    estimates = sketches.selectExpr("generator", "n_rows", f"stack({len(columns)}, {pairs}) as (column_name, estimate)")
    low, high = F.col("estimate") * (1 - SKETCH_ERROR), F.col("estimate") * (1 + SKETCH_ERROR)
    least = F.greatest(F.lit(ratio) * F.col("n_rows"), F.lit(float(min_distinct)))  # both thresholds have to be exceeded
    return estimates.select("generator", "n_rows", "column_name", F.when(high <= least, F.lit(False)).when(low > least, F.lit(True)).alias("flagged"))


def open_counts(receipts: DataFrame, ratio: float = K.UNIQUE_RATIO, min_distinct: int = K.UNIQUE_MIN_DISTINCT) -> DataFrame:
    """:func:`distinct_counts` of the columns that sketches do not rule out in every cohort: all that :func:`uniqueness_of` can flag.
    ``receipts`` should be materialized."""
    flags = materialize(sketched_flags(receipts, ratio, min_distinct))
    left = flags.where(F.coalesce("flagged", F.lit(True))).select("column_name").distinct().collect()  # columns
    columns = _counted(receipts)
    return distinct_counts(receipts, {c: columns[c] for c in sorted(r["column_name"] for r in left)})


def uniqueness_flags(receipts: DataFrame, ratio: float = K.UNIQUE_RATIO, min_distinct: int = K.UNIQUE_MIN_DISTINCT) -> DataFrame:
    """``(generator, column_name, flagged)`` as :func:`uniqueness` flags them: by sketches, and by exact counts for the columns that these leave
    open in some cohort. ``receipts`` should be materialized."""
    flags = materialize(sketched_flags(receipts, ratio, min_distinct))
    unsure = [r["column_name"] for r in flags.where("flagged IS NULL").select("column_name").distinct().collect()]  # columns
    decided = flags.where("n_rows > 1")
    if not unsure:
        return decided.select("generator", "column_name", "flagged")
    columns = _counted(receipts)
    exact = _exact_counts(receipts, {c: columns[c] for c in sorted(unsure)})
    d = F.coalesce("n_distinct", F.lit(0))
    return decided.join(exact, ["generator", "column_name"], "left").select("generator", "column_name", F.coalesce(
        "flagged", (d / F.col("n_rows") > F.lit(ratio)) & (d > F.lit(min_distinct))).alias("flagged"))


def uniqueness(receipts: DataFrame, ratio: float = K.UNIQUE_RATIO, min_distinct: int = K.UNIQUE_MIN_DISTINCT) -> DataFrame:
    """Exact distinct count and ratio per cohort and column; flag ratio > 0.95 and > 10 distinct
    (A11, P16). Nulls are not distinct values but stay in the row count (Q9)."""
    return uniqueness_of(distinct_counts(materialize(receipts, of=receipts)), ratio, min_distinct)


def uniqueness_of(counts: DataFrame, ratio: float = K.UNIQUE_RATIO, min_distinct: int = K.UNIQUE_MIN_DISTINCT) -> DataFrame:
    """:func:`uniqueness` from :func:`distinct_counts`."""
    r = F.col("n_distinct") / F.col("n_rows")
    return counts.filter(F.col("n_rows") > 1).select(
        "generator", "column_name", "n_rows", F.col("n_distinct").cast("bigint").alias("n_distinct"),
        stat6(r).alias("ratio"),
        ((r > F.lit(ratio)) & (F.col("n_distinct") > F.lit(min_distinct))).alias("flagged"))


def uniqueness_verdict(spark: SparkSession, receipts: DataFrame) -> DataFrame:
    """Warning with the flagged columns, or a clean verdict, per cohort (V4). Columns far from the threshold are settled by sketches."""
    receipts = materialize(receipts, of=receipts)
    return verdict_from(receipts.select("generator").distinct(), uniqueness_flags(receipts))


def verdict_of(counts: DataFrame) -> DataFrame:
    """:func:`uniqueness_verdict` from :func:`distinct_counts`."""
    return verdict_from(counts.select("generator").distinct(), uniqueness_of(counts))


def verdict_from(cohorts: DataFrame, flags: DataFrame) -> DataFrame:
    """The verdict of every cohort of ``cohorts`` (generator) from (generator, column_name, flagged)."""
    u = flags.filter("flagged").groupBy("generator").agg(F.array_sort(F.collect_list("column_name")).alias("flagged_columns"))
    out = cohorts.join(u, "generator", "left")
    cols = F.coalesce("flagged_columns", F.array().cast("array<string>"))
    return out.select("generator", cols.alias("flagged_columns"),
                      F.when(F.size(cols) > 0, F.lit("warning")).otherwise(F.lit("clean")).alias("verdict"))


def id_kind(generator_col):
    """Customer id kind per cohort (V5): a constant by cohort."""
    return (F.when(generator_col == "Statistical", F.lit(K.ID_KIND["Statistical"]))
            .otherwise(F.lit(K.ID_KIND["LLM"])))
