"""Classifier trained in epochs, evaluated after each, the best one kept.

A linear softmax over sub-word pieces, fitted by mini-batch gradient descent with adaptive moments and decoupled weight decay; the learning rate
rises over the first steps and then falls to zero. An epoch has a given number of steps; every training row belongs to one
of them by the hash of its key, so a step is one Spark job over its share of the rows, at any size. Tasks add up the gradient of
their rows, Spark adds the tasks' sums per piece, and the driver, which holds the weights (pieces x classes, bounded by the vocabulary),
moves them. After an epoch the test rows are scored, and weights, moments and metrics are stored: a run goes on from the last
stored epoch, and the epoch of the lowest evaluation loss is loaded for scoring.

A row's features are the square roots of its pieces' counts, scaled to length 1, and a constant.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.functions import draws as D
from cohortkit.session import scratch_path

EPOCHS = 3
STEPS = 8  # per epoch
WEIGHT_DECAY = 0.01
LEARNING_RATE = 0.05
WARM_UP = 0.1  # share of all steps over which the learning rate rises
BETAS = (0.9, 0.999)
EPSILON = 1e-8
TEST_STEP = -1


@dataclass
class State:
    """Weights (pieces and the constant x classes), their moments and the number of steps taken."""
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    @classmethod
    def zero(cls, n_pieces: int, n_classes: int) -> State:
        return cls(*(np.zeros((n_pieces + 1, n_classes)) for _ in range(3)))

    def move(self, gradient: np.ndarray, rate: float, decay: float) -> None:
        """One step; the constant's weights do not decay."""
        self.steps += 1
        b1, b2 = BETAS
        self.first = b1 * self.first + (1 - b1) * gradient
        self.second = b2 * self.second + (1 - b2) * gradient ** 2
        change = self.first / (1 - b1 ** self.steps) / (np.sqrt(self.second / (1 - b2 ** self.steps)) + EPSILON)
        change[:-1] += decay * self.weights[:-1]
        self.weights = self.weights - rate * change


def learning_rate(step: int, total: int, top: float = LEARNING_RATE, warm_up: float = WARM_UP) -> float:
    """The rate of the ``step``-th of ``total`` steps, from 0: linear up, then linear down to zero."""
    rising = max(1, int(np.ceil(warm_up * total)))
    return top * (step + 1) / rising if step < rising else top * (total - step) / max(1, total - rising)


def features(ids: np.ndarray, lengths: np.ndarray, n_pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, value) of the rows' features, from their ids in a row; other ids than pieces are left out."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    inside = ids < n_pieces
    key, counts = np.unique(row[inside] * n_pieces + ids[inside], return_counts=True)
    row, piece = key // n_pieces, key % n_pieces
    value = np.sqrt(counts)
    norm = np.sqrt(np.bincount(row, counts, len(lengths)))
    constant = np.arange(len(lengths))
    return (np.concatenate([row, constant]), np.concatenate([piece, np.full(len(lengths), n_pieces)]),
            np.concatenate([value / norm[row], np.ones(len(lengths))]))


def probabilities(row: np.ndarray, piece: np.ndarray, value: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Softmax per row."""
    score = np.stack([np.bincount(row, value * w, n) for w in weights.T[:, piece]], axis=1)
    score -= score.max(axis=1, keepdims=True)
    p = np.exp(score)
    return p / p.sum(axis=1, keepdims=True)


def _rows(batch: pa.RecordBatch, n_pieces: int) -> tuple[np.ndarray, tuple]:
    """(label, features) of a batch of (label, ids)."""
    lengths = batch.column(1).value_lengths().to_numpy()
    ids = batch.column(1).flatten().to_numpy().astype(np.int64)
    return batch.column(0).to_numpy().astype(np.int64), features(ids, lengths, n_pieces)


def deal(encoded: DataFrame, steps: int = STEPS, key: str = "sample_id", seed=K.SEED) -> str:
    """Store (label, ids) of ``encoded`` (key, label, is_test, input_ids) by step, and give the folder. Rows without a label are left out."""
    spark = encoded.sparkSession
    path = scratch_path(spark, "epoch-rows")
    step = F.when(F.col("is_test"), F.lit(TEST_STEP)).otherwise(
        (D.slot(D.key_md5(seed, F.col(key), "step"), 0) % steps).cast("int"))
    encoded.where("label IS NOT NULL").select(F.col("label").cast("int").alias("label"), F.col("input_ids").alias("ids"), step.alias("step")).write.partitionBy(
        "step").parquet(path)
    return path


def _of_step(spark: SparkSession, path: str, step: int) -> DataFrame:
    return spark.read.schema("label int, ids array<int>, step int").parquet(path).where(F.col("step") == step).select("label", "ids")


def gradient(rows: DataFrame, state: State) -> tuple[np.ndarray, float, int]:
    """(gradient summed over the rows, loss summed, rows)."""
    weights = state.weights
    n_pieces, n_classes = weights.shape[0] - 1, weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros_like(weights), 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            label, (row, piece, value) = _rows(batch, n_pieces)
            p = probabilities(row, piece, value, weights, len(label))
            loss -= float(np.log(np.maximum(p[np.arange(len(label)), label], 1e-300)).sum())
            n += len(label)
            p[np.arange(len(label)), label] -= 1
            for c in range(n_classes):
                total[:, c] += np.bincount(piece, value * p[row, c], n_pieces + 1)
        if n:
            used = np.flatnonzero(total.any(axis=1))
            at = np.concatenate([[-1], used])
            sums = np.concatenate([[[loss, n] + [0.0] * (n_classes - 2)], total[used]])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32())] + [pa.array(sums[:, c]) for c in range(n_classes)],
                                             names=["piece"] + [f"g{c}" for c in range(n_classes)])

    names = [f"g{c}" for c in range(n_classes)]
    found = rows.mapInArrow(run, "piece int, " + ", ".join(f"{c} double" for c in names)).groupBy("piece").agg(
        *[F.sum(c).alias(c) for c in names]).toArrow()  # a row per piece at most
    at = found.column("piece").to_numpy()
    sums = np.stack([found.column(c).to_numpy() for c in names], axis=1)
    out = np.zeros_like(weights)
    out[at[at >= 0]] = sums[at >= 0]
    head = sums[at < 0]
    return out, float(head[0, 0]) if len(head) else 0.0, int(head[0, 1]) if len(head) else 0


def evaluate(rows: DataFrame, state: State) -> dict:
    """n, loss (mean), accuracy and F1 weighted by label of labelled rows."""
    weights = state.weights
    n_pieces, n_classes = weights.shape[0] - 1, weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, loss = np.zeros((n_classes, n_classes), np.int64), np.zeros((n_classes, n_classes))
        for batch in batches:
            if batch.num_rows:
                label, (row, piece, value) = _rows(batch, n_pieces)
                p = probabilities(row, piece, value, weights, len(label))
                np.add.at(counts, (label, p.argmax(axis=1)), 1)
                np.add.at(loss, (label, p.argmax(axis=1)), -np.log(np.maximum(p[np.arange(len(label)), label], 1e-300)))
        at = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(counts[tuple(at.T)]),
                                          pa.array(loss[tuple(at.T)])], names=["label", "predicted", "n", "loss"])

    table = np.zeros((n_classes, n_classes))
    lost = 0.0
    for r in rows.mapInArrow(run, "label int, predicted int, n long, loss double").groupBy("label", "predicted").agg(
            F.sum("n").alias("n"), F.sum("loss").alias("loss")).collect():  # classes squared
        table[r["label"], r["predicted"]] = r["n"]
        lost += r["loss"]
    n = table.sum()
    hit, of, said = np.diag(table), table.sum(axis=1), table.sum(axis=0)
    f1 = 2 * hit / np.maximum(of + said, 1)
    return {"n": int(n), "loss": float(lost / max(n, 1)), "accuracy": float(hit.sum() / max(n, 1)), "weighted_f1": float((f1 * of).sum() / max(n, 1))}


REPORT = "epoch int, n_train long, n_test long, train_loss double, eval_loss double, accuracy double, weighted_f1 double, steps int"


def save_state(spark: SparkSession, state: State, path: str, report: tuple) -> None:
    """Store an epoch: weights and moments by piece, then its line of the report, which marks it as complete."""
    n = len(state.weights)
    table = pa.table({"piece": pa.array(range(n), pa.int32())} | {
        name: pa.array(list(a), pa.list_(pa.float64())) for name, a in (("w", state.weights), ("m", state.first), ("v", state.second))})
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{path}/state/epoch_{report[0]}")
    spark.createDataFrame([report], REPORT).coalesce(1).write.mode("append").parquet(f"{path}/report")


def load_state(spark: SparkSession, path: str, epoch: int) -> State:
    """A stored epoch."""
    table = spark.read.parquet(f"{path}/state/epoch_{epoch}").orderBy("piece").toArrow()
    steps = read_report(spark, path).where(F.col("epoch") == epoch).first()["steps"]
    return State(*(np.array(table.column(c).to_pylist()) for c in ("w", "m", "v")), steps)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A line per stored epoch, with ``is_best``: the lowest evaluation loss, the earlier one of equals."""
    report = spark.read.schema(REPORT).parquet(f"{path}/report")
    best = report.agg(F.min_by("epoch", F.struct("eval_loss", "epoch"))).scalar()
    return report.withColumn("is_best", F.col("epoch") == best)


def _stored_epochs(spark: SparkSession, path: str) -> int:
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(REPORT).parquet(f"{path}/report").agg(F.coalesce(F.max("epoch"), F.lit(0))).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def fit_epochs(spark: SparkSession, rows_path: str, path: str, n_pieces: int, n_classes: int, epochs: int = EPOCHS, steps: int = STEPS,
               until: int | None = None, decay: float = WEIGHT_DECAY, rate: float = LEARNING_RATE) -> DataFrame:
    """Train over the rows that :func:`deal` stored with the same ``steps``; the report of the epochs stored under ``path``.

    A run goes on behind the last stored epoch; ``until`` ends it before ``epochs`` is reached. The order of the steps differs by epoch.
    """
    done = _stored_epochs(spark, path)
    state = load_state(spark, path, done) if done else State.zero(n_pieces, n_classes)
    total = epochs * steps
    for epoch in range(done + 1, (until or epochs) + 1):
        lost, seen = 0.0, 0
        for k, step in enumerate(step_order(epoch, steps)):
            grad, loss, n = gradient(_of_step(spark, rows_path, step), state)
            lost, seen = lost + loss, seen + n
            if n:  # few rows may leave a step empty
                state.move(grad / n, learning_rate((epoch - 1) * steps + k, total, rate), decay)
        found = evaluate(_of_step(spark, rows_path, TEST_STEP), state)
        save_state(spark, state, path, (epoch, seen, found["n"], lost / max(seen, 1), found["loss"], found["accuracy"], found["weighted_f1"], state.steps))
    return read_report(spark, path)


def step_order(epoch: int, steps: int) -> list[int]:
    """The steps of an epoch in an order of its own."""
    return np.random.default_rng(epoch).permutation(steps).tolist()


def predict(encoded: DataFrame, state: State, key: str = "sample_id") -> DataFrame:
    """(key, predicted, probability) for (key, input_ids)."""
    weights = state.weights
    n_pieces = weights.shape[0] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lengths = batch.column(1).value_lengths().to_numpy()
                p = probabilities(*features(batch.column(1).flatten().to_numpy().astype(np.int64), lengths, n_pieces), weights, len(lengths))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.argmax(axis=1), pa.int32()), pa.array(p.max(axis=1))],
                                                 names=[key, "predicted", "probability"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "input_ids").mapInArrow(run, f"{key} {kind}, predicted int, probability double")
