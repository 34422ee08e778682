"""Packing into optimal length buckets.

A text of n tokens is cut into sequences of at most ``context`` tokens (full ones and one rest), so a
length is between 1 and ``context`` whatever the texts are. The global histogram of lengths (at most
``context`` rows, the only thing the driver sees) goes to a dynamic programme that chooses at most
``n_buckets`` upper bounds with the least padding, when each sequence is padded to the bound of its
bucket. Inside each bucket, sequences form batches of floor(token_budget / bound) members.

Plan: one scan counts tokens and stores (doc, length) rows; the histogram is a map-side combined count;
bounds are literals. The position of a sequence in its bucket is distributed: sequences are dealt to
shards by the leading hex digits of an MD5, a window numbers them inside (bucket, shard), and the
offset of a shard is a prefix sum over the small table of shard counts. The number of shards follows
the number of sequences, so neither a bucket with most rows nor one long text lands in one task.

Defined cases: null, empty and blank texts have no token and no sequence, hence no row; repeated rows
are sequences of their own; ties in order are between equal rows; the last batch of a bucket may hold
fewer members.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import stored

CONTEXT = 2048
N_BUCKETS = 8
TOKEN_BUDGET = 16384
ROWS_PER_SHARD = 1000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Tokens as words (runs of other characters than ASCII white space); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sequences(docs: DataFrame, n_tokens: Column, doc_id: str = "doc_id", context: int = CONTEXT) -> DataFrame:
    """(doc_id, chunk, length): the sequences of at most ``context`` tokens."""
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("pk_n") - 1) / context))
    return (
        docs.select(F.col(doc_id).alias("doc_id"), n_tokens.alias("pk_n")).where(F.col("pk_n") > 0)
        .select("doc_id", "pk_n", F.explode(parts).alias("chunk"))
        .select("doc_id", "chunk", F.least(F.lit(context), F.col("pk_n") - F.col("chunk") * context).cast("long").alias("length"))
    )


def optimal_bounds(histogram: dict[int, int], n_buckets: int = N_BUCKETS) -> list[int]:
    """The upper bounds of at most ``n_buckets`` buckets with the least total padding.

    Ties go to the smaller lower neighbour of each bound, from the last bucket down.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    n = len(lengths)
    # cost[j, i]: padding of a bucket that holds the lengths j+1 .. i (1-based), bound lengths[i-1]
    cost = (rows[None, 1:] - rows[:-1, None]) * lengths[None, :] - (tokens[None, 1:] - tokens[:-1, None])
    far = np.iinfo(np.int64).max // 4
    cost = np.where(np.arange(n)[:, None] <= np.arange(n)[None, :], cost, far)
    best, back = cost[0].copy(), []
    for _ in range(1, min(n_buckets, n)):
        total = np.concatenate([cost[:1], np.minimum(best[:-1, None], far) + cost[1:]])
        j = np.argmin(total, axis=0)
        back.append(j)
        best = total[j, np.arange(n)]
    bounds, i = [], n - 1
    while True:
        bounds.append(int(lengths[i]))
        if not back:
            break
        j = int(back.pop()[i])
        if j == 0:
            break
        i = j - 1
    return bounds[::-1]


def length_histogram(seqs: DataFrame) -> dict[int, int]:
    """Sequences per length; at most ``context`` rows reach the driver."""
    return {int(r["length"]): int(r["n"]) for r in seqs.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}


def bucket_of(length: Column, bounds: list[int]) -> Column:
    """The smallest bound that is not below ``length``."""
    return F.element_at(F.filter(F.array(*[F.lit(int(b)).cast("long") for b in bounds]), lambda b: b >= length), 1)


def pack(docs: DataFrame, n_tokens: Column | None = None, doc_id: str = "doc_id", context: int = CONTEXT,
         n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET,
         rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """One row per sequence: (doc_id, chunk, length, bucket, batch, slot, padding).

    ``bucket`` is the bound, ``batch`` counts from 0 inside the bucket, ``slot`` inside the batch.
    """
    if token_budget < context:
        raise ValueError("token_budget must hold a sequence of context tokens")
    n_tokens = word_count(F.col("text")) if n_tokens is None else n_tokens
    seqs = stored(sequences(docs, n_tokens, doc_id, context), "packing-sequences")
    histogram = length_histogram(seqs)
    bounds = optimal_bounds(histogram, n_buckets) or [context]
    digits = 1
    while 16**digits * rows_per_shard < sum(histogram.values()) and digits < 5:
        digits += 1
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("chunk")))
    placed = (
        seqs.withColumn("bucket", bucket_of(F.col("length"), bounds))
        .withColumn("pk_order", order).withColumn("pk_shard", F.substring("pk_order", 1, digits))
    )
    within = Window.partitionBy("bucket", "pk_shard").orderBy("pk_order", "doc_id", "chunk", "length")
    numbered = placed.withColumn("pk_row", F.row_number().over(within))
    # at most n_buckets x 16**digits rows, a count per shard; the window runs over these alone
    shards = stored(placed.groupBy("bucket", "pk_shard").agg(F.count(F.lit(1)).alias("pk_size")), "packing-shards")
    before = Window.partitionBy("bucket").orderBy("pk_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select(
        F.col("bucket").alias("pk_bucket"), F.col("pk_shard").alias("pk_of"),
        F.coalesce(F.sum("pk_size").over(before), F.lit(0)).alias("pk_before"))
    position = F.col("pk_before") + F.col("pk_row") - 1
    size = F.floor(F.lit(token_budget) / F.col("bucket"))
    return (
        numbered.join(offsets, (F.col("bucket") == F.col("pk_bucket")) & (F.col("pk_shard") == F.col("pk_of")))
        .select("doc_id", "chunk", "length", "bucket", F.floor(position / size).cast("long").alias("batch"),
                (position % size).cast("long").alias("slot"), (F.col("bucket") - F.col("length")).alias("padding"))
    )
