"""Order statistics by radix selection: count by prefix, then refine the one prefix that holds the rank.

No row is sorted or moved by range. A round is one aggregate to at most ``BINS`` counts per target, combined map-side; the driver sees
one line per target and round, and targets are groups times ranks, which are few.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096
PREFIXES = 1 << 16  # of a 32-bit hash


def _holding(counts: DataFrame, group: list[str], bin: str, rank: Column) -> DataFrame:
    """The bin of each group that holds ``rank``, with ``_before``, the rows before it."""
    upto = Window.partitionBy(*group).orderBy(bin).rowsBetween(Window.unboundedPreceding, 0)  # bins of one target
    return counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_before", F.col("_upto") - F.col("_n")).where(
        (F.col("_before") < rank) & (rank <= F.col("_upto")))


def values_at(counts: DataFrame, keys: list[str], value: str, weight: str, ranks, bins: int = BINS) -> dict[tuple, tuple[int, list[float]]]:
    """group -> (n, values at the 1-based ranks that ``ranks(n)`` lists) from counts per distinct double ``value``.

    A target's interval is cut into ``bins`` of equal width; the bin that holds the rank, shrunk to its smallest and largest
    value, is the next interval, until these are equal. The ends fall into different bins, so each round gets on. Infinite
    values and NaN (the largest, as Spark orders them) are counted apart.
    """
    spark = counts.sparkSession
    v, n = F.col(value), F.col(weight)
    finite = F.abs(v) < F.lit(math.inf)
    sums = counts.groupBy(*keys).agg(
        F.sum(n).alias("_all"), F.sum(F.when(v == F.lit(-math.inf), n).otherwise(0)).alias("_low"), F.sum(F.when(finite, n).otherwise(0)).alias("_mid"),
        F.sum(F.when(v == F.lit(math.inf), n).otherwise(0)).alias("_high"), F.min(F.when(finite, v)).alias("_lo"), F.max(F.when(finite, v)).alias("_hi"))
    out, open_targets = {}, []
    groups = sums.collect()  # a row per group
    for at, r in enumerate(groups):
        wanted = ranks(r["_all"])
        found = [None] * len(wanted)
        out[tuple(r[k] for k in keys)] = (r["_all"], found)
        for i, k in enumerate(wanted):
            if k <= r["_low"]:
                found[i] = -math.inf
            elif k > r["_low"] + r["_mid"]:
                found[i] = math.inf if k <= r["_low"] + r["_mid"] + r["_high"] else math.nan
            elif r["_lo"] == r["_hi"]:
                found[i] = r["_lo"]
            else:
                open_targets.append((at, i, k - r["_low"], r["_lo"], r["_hi"]))
    names = [f"_k{j}" for j in range(len(keys))]
    kinds = ", ".join(f"{a} {counts.schema[k].dataType.simpleString()}" for a, k in zip(names, keys))
    while open_targets:
        rows = [(*(groups[at][k] for k in keys), at, i, k, float(lo), float(hi)) for at, i, k, lo, hi in open_targets]
        targets = spark.createDataFrame(rows, f"{kinds}, _at int, _i int, _rank long, _lo double, _hi double")
        on = None
        for a, k in zip(names, keys):
            same = F.col(k).eqNullSafe(F.col(a))
            on = same if on is None else on & same
        inside = counts.where(finite).join(F.broadcast(targets), on).where((v >= F.col("_lo")) & (v <= F.col("_hi")))
        # very wide intervals by halves, so that their width cannot overflow
        unit = F.when(F.greatest(F.abs("_lo"), F.abs("_hi")) > F.lit(1e300), F.lit(0.5)).otherwise(F.lit(1.0))
        share = (v * unit - F.col("_lo") * unit) / (F.col("_hi") * unit - F.col("_lo") * unit)
        binned = inside.groupBy("_at", "_i", "_rank", F.least(F.floor(share * bins), F.lit(bins - 1)).alias("_bin")).agg(
            F.sum(n).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        open_targets = []
        for r in _holding(binned, ["_at", "_i"], "_bin", F.col("_rank")).collect():
            if r["_lo"] == r["_hi"]:
                out[tuple(groups[r["_at"]][k] for k in keys)][1][r["_i"]] = r["_lo"]
            else:
                open_targets.append((r["_at"], r["_i"], r["_rank"] - r["_before"], r["_lo"], r["_hi"]))
    return out


def hash_threshold(rows: DataFrame, hash32: str, key: str, rank: int) -> tuple[int, object] | None:
    """(hash, key) of the row at 1-based ``rank`` in the order of a 32-bit hash and the key; None for rank 0."""
    if rank < 1:
        return None
    h = F.col(hash32)

    def refine(part: DataFrame, prefix: Column, rank: int) -> tuple[int, int]:
        counts = part.groupBy(prefix.cast("long").alias("_bin")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", F.lit(0))
        r = _holding(counts, ["_g"], "_bin", F.lit(rank)).first()
        return r["_bin"], rank - r["_before"]

    top, rank = refine(rows, F.floor(h / PREFIXES), rank)
    low, rank = refine(rows.where(F.floor(h / PREFIXES) == top), h % PREFIXES, rank)
    found = top * PREFIXES + low
    last = rows.where(h == found).select(key).orderBy(key).limit(rank).agg(F.max(key)).first()[0]  # rows that share all 32 bits
    return found, last
