"""Ordered prefix counts and exact quantiles without holding a group in one task.

Everything starts from counts per distinct (group, value), an aggregate with map-side combining.
The counts are range-partitioned by (group, value), so each part is a contiguous stretch of the
order; the part's number is stored with its rows. Totals per (group, part) give every part its
offset, and the running sum is a window inside (group, part). The number of parts follows the number
of distinct values, up to ``MAX_PARTS``. Quantiles need no order of all values: they are selected (``selection``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.operators.selection import BINS, values_at
from cohortkit.session import materialize

# Distinct values per part of the order, and the most parts, whose bounds the driver computes.
ROWS_PER_PART = 100_000
MAX_PARTS = 8192


def prefix_counts(counts: DataFrame, keys: list[str], value: str, weights: list[str],
                  rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``counts`` (one row per ``keys`` and ``value``) with ``cum_<weight>``: the sum of each weight
    over the values up to this one in its group. ``counts`` should be materialized."""
    parts = min(MAX_PARTS, max(1, -(-counts.count() // rows_per_part)))
    dealt = materialize(counts.select(*keys, value, *weights).repartitionByRange(parts, *keys, value)
                        .withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(*keys, "_part").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    # a row per group and part: the running offset is a window over this small frame
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_t_{w}").over(before), F.lit(0)).alias(f"_o_{w}")
                                              for w in weights])
    upto = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(offsets, [*keys, "_part"]).select(
        *keys, value, *weights, *[(F.col(f"_o_{w}") + F.sum(w).over(upto)).alias(f"cum_{w}") for w in weights])


def quantiles_of_counts(counts: DataFrame, keys: list[str], value: str, probs: list[float], bins: int = BINS) -> DataFrame:
    """``(keys..., n_values, q0, q1, ...)``: exact linearly interpolated quantiles per group from
    materialized ``counts`` (keys, value, c); groups are few."""
    def places(n: int) -> list[tuple[int, int, float]]:
        return [(math.floor(p * (n - 1)), math.ceil(p * (n - 1)), p * (n - 1) - math.floor(p * (n - 1))) for p in probs]

    found = values_at(counts, keys, value, "c", lambda n: [k + 1 for lo, hi, _ in places(n) for k in (lo, hi)], bins)
    rows = [(*group, n, *(v[2 * i] + (v[2 * i + 1] - v[2 * i]) * w if v[2 * i] != v[2 * i + 1] else v[2 * i] for i, (_, _, w) in enumerate(places(n))))
            for group, (n, v) in found.items()]
    fields = [T.StructField(k, counts.schema[k].dataType) for k in keys] + [T.StructField("n_values", T.LongType())]
    schema = T.StructType(fields + [T.StructField(f"q{i}", T.DoubleType()) for i in range(len(probs))])
    return counts.sparkSession.createDataFrame(rows, schema)


def exact_quantiles(df: DataFrame, group, value: str, probs: list[float], bins: int = BINS) -> DataFrame:
    """``(group..., n_values, q0, q1, ...)`` over the non-null ``value`` (as double); ``group`` is a
    column name or a list of names."""
    keys = [group] if isinstance(group, str) else list(group)
    v = F.col(value).cast("double")
    counts = materialize(df.filter(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("c")))
    return quantiles_of_counts(counts, keys, "_v", probs, bins)


def exact_median(df: DataFrame, group: str, value: str, bins: int = BINS) -> DataFrame:
    """``(group, n_values, median)`` over non-null ``value`` (as double)."""
    return exact_quantiles(df, group, value, [0.5], bins).withColumnRenamed("q0", "median")
