"""Top lists of many-valued columns: a frequent-items sketch first, then an exact recount of its candidates.

Each task keeps at most ``counters`` values per cohort (the mergeable form of the Misra-Gries summary): when a batch makes
them more, the first surplus count is taken off all of them, and off the total error. A value's count is at least its counters' sum,
``low``, and at most ``low`` plus the errors of all tasks, E. If L is the n-th largest ``low`` of a cohort, only values with ``low`` + E >= L can be among the
first n, and values without a counter cannot as long as E < L. Where that holds for every cohort, the candidates are counted
exactly in a second pass, else the sketch is taken again with more counters; beyond ``MOST`` the counts of all values are made.
So the list is always the exact one; what is shuffled is the counters, not a row per value and task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.operators.utility import line_weight, top_n, value_counts
from cohortkit.session import materialize

COUNTERS = 1024
MOST = 1 << 16


def shrink(counts: Counter, counters: int) -> int:
    """Take the (counters + 1)-th largest count off all values and drop those that are left with none; that count."""
    if len(counts) <= counters:
        return 0
    off = sorted(counts.values(), reverse=True)[counters]
    for v, n in list(counts.items()):
        if n <= off:
            del counts[v]
        else:
            counts[v] = n - off
    return off


def sketch(items: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """(generator, value, low) of the tasks' counters, summed; the row of the null value holds the cohort's error."""
    rows = items.where(F.col(column).isNotNull()).select("generator", F.col(column).alias("value"), line_weight(items).cast("long").alias("n"))
    kind = rows.schema["value"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        errors: Counter = Counter()
        schema = None
        for batch in batches:
            schema = batch.schema
            grouped = pa.Table.from_batches([batch]).group_by(["generator", "value"]).aggregate([("n", "sum")])
            for generator, value, n in zip(*(grouped.column(c).to_pylist() for c in ("generator", "value", "n_sum"))):
                held.setdefault(generator, Counter())[value] += n
            for generator, counts in held.items():
                errors[generator] += shrink(counts, counters)
        out = [(g, v, n) for g, counts in held.items() for v, n in counts.items()] + [(g, None, n) for g, n in errors.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], schema.field(1).type),
                                              pa.array([r[2] for r in out], pa.int64())], names=["generator", "value", "low"])

    found = rows.mapInArrow(run, f"generator string, value {kind.simpleString()}, low long")
    return found.groupBy("generator", "value").agg(F.sum("low").alias("low"))


def candidates(lows: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """(generator, value) that can be among a cohort's first n, and whether no other value can. ``lows``: :func:`sketch`, stored."""
    errors = lows.where("value IS NULL").select(F.col("generator").alias("g"), F.col("low").alias("error"))
    seen = lows.where("value IS NOT NULL")
    ranked = seen.withColumn("r", F.row_number().over(Window.partitionBy("generator").orderBy(F.desc("low")))).where(F.col("r") <= n)
    # a row per cohort, also of those without a counter left; with fewer than n, all values were seen only if nothing was taken off
    least = ranked.groupBy("generator").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("k"))
    bounds = materialize(errors.join(least, F.col("generator").eqNullSafe(F.col("g")), "left").select(
        "g", F.coalesce("least", F.lit(0)).alias("least"), F.coalesce("k", F.lit(0)).alias("k"), "error"))
    sure = bounds.where((F.col("error") > 0) & ((F.col("error") >= F.col("least")) | (F.col("k") < n))).isEmpty()
    found = seen.join(F.broadcast(bounds), F.col("generator").eqNullSafe(F.col("g"))).where(F.col("low") + F.col("error") >= F.col("least"))
    return found.select("generator", "value"), sure


def top_frequent(items: DataFrame, column: str, n: int, counters: int = COUNTERS) -> DataFrame:
    """(generator, column, cnt, rank): the first ``n`` values per cohort by count, ties by value, as
    ``top_n(value_counts(items, column), column, n)`` gives them. ``items`` should be materialized."""
    while counters <= MOST:
        few, sure = candidates(materialize(sketch(items, column, counters)), n)
        if sure:
            few = few.select(F.col("generator").alias("_g"), F.col("value").alias("_v"))
            recounted = items.join(few, F.col("generator").eqNullSafe(F.col("_g")) & (F.col(column) == F.col("_v")), "left_semi")
            return top_n(value_counts(recounted, column), column, n)
        counters *= 8
    return top_n(value_counts(items, column), column, n)
