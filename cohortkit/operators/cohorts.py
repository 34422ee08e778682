"""Cohort dimension and small shared helpers for per-cohort evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COHORTS = ["Statistical", "LLM"]


def cohort_dim(spark: SparkSession) -> DataFrame:
    """The two cohorts of the comparison (fixed 2 rows)."""
    return spark.createDataFrame([(g,) for g in COHORTS], "generator string")


def per_cohort(spark: SparkSession, *metrics: DataFrame) -> DataFrame:
    """The metric frames (a row per cohort each) side by side, for the two cohorts of the comparison,
    also where they are empty (P14), and for every other cohort of the data."""
    out = cohort_dim(spark)
    for m in metrics:
        out = out.join(m, "generator", "full_outer")
    return out


def stat6(c: Column) -> Column:
    """Statistics are reported as doubles rounded to 6 places."""
    return F.round(c.cast("double"), 6)


def mean_exact(c: Column) -> Column:
    """Mean of a decimal column as ``double(sum) / count``: the sum is exact, so every engine
    returns the same double."""
    return F.sum(c).cast("double") / F.count(c)


def status_of(n_rows: Column, n_values: Column) -> Column:
    """``empty`` (no rows), ``missing`` (all values null) or ``ok``."""
    return (F.when(F.coalesce(n_rows, F.lit(0)) == 0, F.lit("empty"))
            .when(F.coalesce(n_values, F.lit(0)) == 0, F.lit("missing"))
            .otherwise(F.lit("ok")))


def feature_availability(spark: SparkSession, df: DataFrame, columns: list[str]) -> DataFrame:
    """Per cohort and column: rows, non-null values and ``empty``/``missing``/``ok``.

    One aggregate over the frame, then the per-column counts are unpivoted with ``stack``.
    """
    agg = df.groupBy("generator").agg(F.count(F.lit(1)).alias("n_rows"),
                                      *[F.count(c).alias(f"v_{c}") for c in columns])
    pairs = ", ".join(f"'{c}', v_{c}" for c in columns)
    long = agg.selectExpr("generator", "n_rows", f"stack({len(columns)}, {pairs}) as (column_name, n_values)")
    names = F.array(*[F.lit(c) for c in columns])
    grid = per_cohort(spark, agg.select("generator")).select("generator", F.explode(names).alias("column_name"))
    out = grid.join(long, ["generator", "column_name"], "left")
    return out.select("generator", "column_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                      F.coalesce("n_values", F.lit(0)).alias("n_values"),
                      status_of(F.col("n_rows"), F.col("n_values")).alias("status"))
