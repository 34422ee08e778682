"""Exact top-k search by inner product: columnar branch and bound.

Vectors are packed into blocks: a block is one row that holds ids and a matrix in vertical layout
(dimension by dimension). Every query block is listed once per number of a candidate block, where it stands, and meets that block in an
equi-join on the number, so the smaller query blocks travel, tasks are as many as candidate blocks, and work on two matrices of bounded size at a time. For a query, scores are accumulated over a
few dimensions at a time; after each step, by Cauchy-Schwarz, the rest of a candidate's score lies
within +-(rest of the query's norm x rest of the candidate's norm). Candidates whose upper bound is
below the k-th best lower bound cannot be among the k best; survivors are compacted, and later
dimensions are only read for them. The k best per block are merged by a ranked window per query.

The query set is stated by the caller and meets all rows in blocks; nothing is broadcast or collected,
and the number of blocks follows the number of rows. Scores are exact: integer components give integer
scores below 2**53, and the bounds carry a margin against rounding.

Defined cases: vectors that are null or hold null or non-finite components, and null ids, take no
part; only vectors of equal length are compared; equal (id, vector) rows count once; a query is not its
own candidate, by id; ties go to the smaller id; queries with no candidate give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import emptied, stored

K = 20
BLOCK_ROWS = 4096
QUERY_BLOCK_ROWS = 512
BLOCK_DIMS = 8
MARGIN = 1e-9


def usable(vector: Column) -> Column:
    """True for a vector of finite components (null vectors and null components give false)."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def blocks(vectors: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
    """``vectors`` (id, dim, vec array<double>) as stored blocks: (dim, block, ids, cells), and the number of blocks of a length.

    ``cells`` is the matrix dim x n in vertical layout. The block of a row is a hash of its id, so a block
    holds about ``rows`` rows whatever the values are.
    """
    count = vectors.count()
    n = max(1, -(-count // rows))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))

    def pack(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("id", kind="stable")
        cells = np.ascontiguousarray(np.stack(table["vec"].to_numpy()).T.astype(np.float64))
        return pd.DataFrame({
            "dim": [int(table["dim"].iloc[0])], "block": [int(table["block"].iloc[0])],
            "ids": [table["id"].to_numpy(np.int64).tobytes()], "cells": [cells.tobytes()],
        })

    packed = dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, ids binary, cells binary")
    return stored(packed, name), n


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, cells: np.ndarray,
                 k: int, block_dims: int = BLOCK_DIMS) -> list[tuple[int, int, float]]:
    """(query id, id, score) of the k best of each query in one block; ``ids`` ascend, ``cells`` is
    dim x n, ``queries`` is dim x m."""
    dim, n = cells.shape
    starts = list(range(0, dim, block_dims))
    # what is left of a candidate's norm before each step, and after the last one
    mass = np.vstack([np.sqrt(np.add.reduceat(cells**2, starts, axis=0)[::-1].cumsum(axis=0)[::-1]), np.zeros(n)])
    out = []
    for i in range(queries.shape[1]):
        q = queries[:, i]
        rest = np.append(np.sqrt(np.add.reduceat(q**2, starts)[::-1].cumsum()[::-1]), 0.0)
        alive = np.flatnonzero(ids != query_ids[i])
        score = np.zeros(len(alive))
        for step, at in enumerate(starts):
            part = slice(at, at + block_dims)
            rows = cells[part] if len(alive) == n else cells[part][:, alive]
            score = score + q[part] @ rows
            if len(alive) <= k:
                continue
            slack = rest[step + 1] * mass[step + 1, alive]
            slack = slack * (1 + MARGIN) + MARGIN * (np.abs(score) + slack)
            lower = score - slack
            least = np.partition(lower, len(lower) - k)[len(lower) - k]
            keep = score + slack >= least
            if not keep.all():
                alive, score = alive[keep], score[keep]
        best = np.lexsort((ids[alive], -score))[:k]
        out += [(int(query_ids[i]), int(ids[alive[j]]), float(score[j])) for j in best]
    return out


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS,
               query_block_rows: int = QUERY_BLOCK_ROWS, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """(query_id, rank, id, score) of the k best candidates of each query by inner product.

    Both inputs have the columns ``id`` (long) and ``vec`` (array of double).
    """
    def prepared(df: DataFrame) -> DataFrame:
        df = df.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
        df = df.where(F.col("id").isNotNull() & usable(F.col("vec")))
        return df.dropDuplicates(["id", "vec"]).withColumn("dim", F.size("vec"))

    packed, n = blocks(prepared(candidates), block_rows, "topk-candidates")
    asked, m = blocks(prepared(queries), query_block_rows, "topk-queries")
    # with few candidate blocks, each is dealt out several times, so that its query blocks go to several tasks
    salts = min(m, -(-candidates.sparkSession.sparkContext.defaultParallelism // n))
    to_all = asked.select("dim", F.col("ids").alias("query_ids"), F.col("cells").alias("query_cells"), (F.col("block") % salts).alias("salt"),
                          F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    dealt = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = to_all.join(dealt.hint("merge"), ["dim", "block", "salt"]).select("dim", "query_ids", "query_cells", "ids", "cells")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            for r in range(batch.num_rows):
                dim = batch.column(0)[r].as_py()
                query_ids, query_cells, ids, cells = (np.frombuffer(batch.column(c)[r].as_buffer(), kind) for c, kind in (
                    (1, np.int64), (2, np.float64), (3, np.int64), (4, np.float64)))
                found = search_block(query_ids, query_cells.reshape(dim, -1), ids, cells.reshape(dim, -1), k, block_dims)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[c] for f in found], kind) for c, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))],
                    names=["query_id", "id", "score"])

    found = pairs.mapInArrow(search, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
