"""Global ordinal rank without a single-partition window.

``row_number()`` over the whole table sorts everything in one task. Here rows are range-partitioned by
the key, so each part is a contiguous stretch of the order; the part's number is stored with its rows,
the counts per part (one small row each) give it its offset, and ``row_number`` runs inside each part.
The number of parts follows the number of rows, up to ``MAX_PARTS``. Exact as long as the key is unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.session import materialize

ROWS_PER_PART = 100_000
MAX_PARTS = 8192  # whose bounds the driver computes


def ranked(df: DataFrame, key, rank_col: str = "rank", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Add ``rank_col`` = 1-based position in ascending ``key`` order (a column name or a list of names,
    compared in order). ``df`` is counted and then dealt out, so it should be materialized."""
    keys = [key] if isinstance(key, str) else list(key)
    parts = min(MAX_PARTS, max(1, -(-df.count() // rows_per_part)))
    dealt = materialize(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy(*keys)
    return dealt.join(offsets, "_part").withColumn(
        rank_col, F.col("_off") + F.row_number().over(inside)).drop("_part", "_off")
