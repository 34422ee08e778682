"""Embedding whitening by the polarisation covariance: principal components of integer vectors, unit variance.

Vectors become integers, x = floor(scale * c). The fit list holds each distinct vector once; everything about it is exact:

1. One pass sums the list per dimension: n and S.
2. The second pass sums exact squares of centred values, for every dimension and for every sum of two dimensions. By
   polarisation, 2 * cov(i, j) = var(i + j) - var(i) - var(j). Tasks centre by the integer next to the mean, y = x - m, so that
   squares stay small integers; with r = S - n * m (which is the sum of y), the square sum of n * x - S is n**2 * sum(y**2) - n * r**2, and
   the same for a sum of two dimensions. The driver does this in whole numbers and divides once per entry.
3. The covariance (dimensions squared, whatever the rows) is decomposed by ``eigh`` in the driver; a third pass measures
   the covariance of the whitened list.

The only shuffle of vectors is the distinct one, combined map-side, so a vector that a third of the rows hold costs one row per
task. Per task and dimension pair one partial sum leaves; none of the passes gathers rows.

Defined cases: rows whose vector is null, empty or holds null or non-finite components are left out; repeated rows count once in the fit
and each have their result; vectors of different lengths are lists of their own (n, S and components by length); a
component without variance (one vector, equal or dependent dimensions) has a null ``whitened``, and ``explained`` is null
where the list has no variance at all; ``deviation`` is null beyond 64 bits; a null id stays null; ties of eigenvalues keep the order
of ``eigh``; an empty table gives no rows. Only the two named columns are read, so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import bound_batches, emptied, stored

SCALE = 256
COMPONENTS = 4
SAFE = 1 << 61  # sums of magnitudes below this stay exact in 64 bits


@dataclass
class Whitening:
    """The fit of the vectors of one length."""
    n: int
    sums: list[int]  # S
    values: np.ndarray  # eigenvalues of the kept components, falling
    axes: np.ndarray  # dimensions x components
    usable: np.ndarray  # components with variance
    explained: list[float | None]
    identity_error: float = 0.0


def integer_vectors(df: DataFrame, vec: str, scale: int = SCALE) -> DataFrame:
    """``df`` with ``x``: floor(scale * c) of every component, without rows that cannot be used."""
    raw = F.transform(F.col(f"`{vec}`"), lambda c: c.cast("double"))
    usable = ~F.exists(raw, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform(raw, lambda c: F.floor(F.lit(float(scale)) * c).cast("long"))
    return df.where(F.coalesce(usable, F.lit(False)) & (F.size(raw) > 0)).withColumn("x", whole)


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows x dimensions) of a list column, one matrix per length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(sizes)])
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, flat[start[at][:, None] + np.arange(dim)]


def exact(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` as 64-bit integers where results up to ``bound`` fit, else as Python integers."""
    return x if bound < SAFE else x.astype(object)


def _partials(rows: list[tuple]) -> pa.RecordBatch:
    """(dim, at, limb, sum): whole numbers of any size in limbs of 60 bits, so that adding them up stays exact."""
    out = [(d, at, limb, part) for d, at, v in rows for limb, part in ((0, v & LIMB), (1, v >> 60)) if part or not limb]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(4)],
                                      names=["dim", "at", "limb", "sum"])


def _summed(parts: DataFrame) -> dict[int, dict[int, int]]:
    """The sums by length and place; rows by dimensions squared, not by vectors."""
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("dim", "at", "limb").agg(F.sum("sum").alias("sum")).collect():
        of = found.setdefault(r["dim"], {})
        of[r["at"]] = of.get(r["at"], 0) + (int(r["sum"]) << 60 * r["limb"])
    return found


LIMB = (1 << 60) - 1
PARTIAL = "dim int, at long, limb int, sum decimal(38,0)"


def list_sums(vectors: DataFrame) -> dict[int, dict[int, int]]:
    """Per length: the number of vectors at place -1, the sum of dimension i at place i."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in emptied(batches):
            for _, m in matrices(batch.column(0)):
                have = held.setdefault(m.shape[1], [0, [0] * m.shape[1]])
                top = int(np.abs(m.astype(float)).max())
                have[0] += len(m)
                have[1] = [a + int(b) for a, b in zip(have[1], exact(m, top * len(m)).sum(axis=0))]
        rows = [(d, i, s) for d, (n, sums) in held.items() for i, s in [(-1, n), *enumerate(sums)]]
        if rows:
            yield _partials(rows)

    return _summed(vectors.select("x").mapInArrow(run, PARTIAL))


def pair_squares(vectors: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, dict[int, int]]:
    """Per length: the sums of (y_i + y_j)**2 at place i * dim + j for i < j, of y_i**2 at i * dim + i."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in emptied(batches):
            for _, m in matrices(batch.column(0)):
                dim = m.shape[1]
                centre = centres[dim]
                top = int(np.abs(m.astype(float)).max()) + max(abs(int(c)) for c in centre)
                y = exact(m, 2 * top) - centre
                y = exact(y, 4 * top * top * len(y))
                have = held.setdefault(dim, [0] * dim)
                for i in range(dim):
                    pairs = y[:, i:] + y[:, i:i + 1]
                    pairs[:, 0] = y[:, i]
                    got = (pairs * pairs).sum(axis=0).astype(object)
                    have[i] = got if isinstance(have[i], int) else have[i] + got
        for dim, sums in held.items():  # a batch per dimension, so that long vectors need no more memory
            for i, row in enumerate(sums):
                yield _partials([(dim, i * dim + i + k, int(s)) for k, s in enumerate(row)])

    return _summed(vectors.select("x").mapInArrow(run, PARTIAL))


def covariance(n: int, sums: list[int], squares: dict[int, int], centre: list[int]) -> np.ndarray:
    """The covariance from the polarised square sums, each entry divided once."""
    dim = len(sums)
    left = [s - n * m for s, m in zip(sums, centre)]  # sums of y

    def centred(i: int, j: int) -> int:
        """Sum of the squared n * x - S of dimension i, or of the sum of two dimensions."""
        r = left[i] if i == j else left[i] + left[j]
        return n * n * squares[i * dim + j] - n * r * r

    var = [centred(i, i) for i in range(dim)]
    out = np.empty((dim, dim))
    for i in range(dim):
        out[i, i] = float(Fraction(var[i], n ** 3))
        for j in range(i + 1, dim):
            out[i, j] = out[j, i] = float(Fraction(centred(i, j) - var[i] - var[j], 2 * n ** 3))
    return out


def decompose(n: int, sums: list[int], cov: np.ndarray, components: int) -> Whitening:
    """The leading components, by falling eigenvalue."""
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(np.trace(cov))
    usable = values > len(cov) * np.finfo(float).eps * trace
    return Whitening(n, sums, values, axes, usable, [float(v) / trace if trace > 0 else None for v in values])


def project(m: np.ndarray, fit: Whitening) -> tuple[list, np.ndarray]:
    """(deviation, whitened) of the rows of a matrix; components without variance are not a number."""
    top = int(np.abs(m.astype(float)).max())
    bound = max(2 * fit.n * top + 1, max(abs(s) for s in fit.sums))
    z = exact(m, bound) * fit.n - np.array(fit.sums, object if bound >= SAFE else np.int64)
    wide = max(int(np.abs(z.astype(float)).max()) + 1, 1)
    square = exact(z, wide * wide * m.shape[1])
    deviation = [d if d < 1 << 63 else None for d in map(int, (square * square).sum(axis=1))]
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = (z.astype(float) / fit.n) @ fit.axes / np.sqrt(np.where(fit.usable, fit.values, np.nan))
    return deviation, scaled


def identity_errors(vectors: DataFrame, fits: dict[int, Whitening]) -> dict[int, float]:
    """Largest entry of |covariance of the whitened list - identity|, per length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in emptied(batches):
            for _, m in matrices(batch.column(0)):
                dim = m.shape[1]
                w = project(m, fits[dim])[1][:, fits[dim].usable]
                k = w.shape[1]
                have = held.setdefault(dim, [np.zeros(k), np.zeros((k, k))])
                have[0] += w.sum(axis=0)
                have[1] += w.T @ w
        for dim, (s, q) in held.items():
            flat = np.concatenate([s, q.reshape(-1)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int64()), pa.array(flat)],
                names=["dim", "at", "sum"])

    found: dict[int, dict[int, float]] = {}
    parts = vectors.select("x").mapInArrow(run, "dim int, at long, sum double")
    for r in parts.groupBy("dim", "at").agg(F.sum("sum").alias("sum")).collect():
        found.setdefault(r["dim"], {})[r["at"]] = r["sum"]
    out = {}
    for dim, fit in fits.items():
        k = int(fit.usable.sum())
        flat = np.array([found.get(dim, {}).get(i, 0.0) for i in range(k + k * k)]) / fit.n
        mean = flat[:k]
        out[dim] = float(np.abs(flat[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0
    return out


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The fit per vector length, from ``x`` of ``vectors``."""
    listed = stored(vectors.select("x").distinct(), "whitening-list")
    fits = {}
    totals = list_sums(listed)
    n = {d: s[-1] for d, s in totals.items()}
    sums = {d: [s[i] for i in range(d)] for d, s in totals.items()}
    centre = {d: [(2 * s + n[d]) // (2 * n[d]) for s in sums[d]] for d in sums}  # the integer next to the mean
    squares = pair_squares(listed, {d: np.array(c, np.int64) for d, c in centre.items()})
    for d in sums:
        fits[d] = decompose(n[d], sums[d], covariance(n[d], sums[d], squares[d], centre[d]), components)
    for d, error in identity_errors(listed, fits).items():
        fits[d].identity_error = error
    return fits


RESULT = ("id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(df: DataFrame, id: str, vec: str, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row per usable vector and component, as the module says."""
    bound_batches(df.sparkSession)
    vectors = integer_vectors(df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vec}`").alias("vec")), "vec", scale)
    fits = fit_whitening(vectors, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emptied(batches):
            for at, m in matrices(batch.column(1)):
                fit = fits[m.shape[1]]
                k = len(fit.values)
                deviation, scaled = project(m, fit)
                ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                rows = len(at) * k
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), pa.array([fit.n] * rows, pa.int64()),
                     pa.array([d for d in deviation for _ in range(k)], pa.int64()), pa.array(scaled.reshape(-1), from_pandas=True),
                     pa.array(fit.explained * len(at), pa.float64()), pa.array([fit.identity_error] * rows, pa.float64())],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("id", "x").mapInArrow(run, RESULT)
