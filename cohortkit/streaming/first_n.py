"""First n accepted responses of a stream (L1, G4 on a stream).

The batch rule takes the first ``n`` accepted attempts, in attempt order, among attempts 1 .. 3n. On a stream attempts come in any order: the
state of each stream is the ``n`` smallest accepted attempts so far. An attempt that enters is written with ``kept`` true; a late
attempt with a smaller number pushes the largest one out, which is written again with ``kept`` false. So the last row of each
attempt says whether it is among the first n of all that has come, which equals the batch result over the same attempts.

Only accepted attempts within the budget reach the state, whatever the volume of the rest; the state holds ``n`` numbers per stream. Repeated
attempts (a file delivered twice) count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cohortkit import constants as K
from cohortkit.operators import validate as V

CHANGES = "stream string, attempt long, kept boolean"
STATE = "attempts array<long>"


def changes(held: list[int], new: list[int], n: int) -> tuple[list[int], list[int], list[int]]:
    """(the ``n`` smallest of both, those that entered, those that left), each ascending."""
    kept = sorted({*held, *new})[:n]
    return kept, sorted(set(kept) - set(held)), sorted(set(held) - set(kept))


def accepted_attempts(responses: DataFrame, n: int, stream: str = "stream") -> DataFrame:
    """(stream, attempt) of the accepted responses within the budget of 3n attempts; ``responses``: (stream, attempt, raw)."""
    within = responses.where(F.col("attempt").between(1, n * K.MAX_ATTEMPTS_PER_RECEIPT))
    keyed = within.select(F.col(stream).alias("_stream"), F.col("attempt").alias("_attempt"), F.struct(F.col(stream).alias("s"), F.col("attempt").alias("a")).alias("attempt"), "raw")
    parsed = V.parse_responses(keyed.select("attempt", "raw"))
    return parsed.where(F.col("reason").isNull()).select(F.col("attempt")["s"].alias("stream"), F.col("attempt")["a"].alias("attempt"))


def first_n_changes(accepted: DataFrame, n: int) -> DataFrame:
    """(stream, attempt, kept) as a stream of changes, from a stream of (stream, attempt)."""
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        new: list[int] = []
        for frame in frames:
            # of any number of rows only the n smallest can count
            new = sorted({*new, *frame["attempt"].tolist()})[:n]
        kept, entered, left = changes(held, new, n)
        state.update((kept,))
        rows = [(key[0], a, True) for a in entered] + [(key[0], a, False) for a in left]
        yield pd.DataFrame(rows, columns=["stream", "attempt", "kept"]).astype({"attempt": "int64", "kept": "bool"})

    return accepted.groupBy("stream").applyInPandasWithState(update, CHANGES, STATE, "update", GroupStateTimeout.NoTimeout)


def first_n_stream(responses: DataFrame, n: int, sink: str, checkpoint: str, available_now: bool = True):
    """Start a query that writes the changes of the first n accepted responses of each stream to ``sink``, a folder per batch, which a
    repeated batch overwrites. ``checkpoint`` has to be a shared folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={batch_id}")

    writer = first_n_changes(accepted_attempts(responses, n), n).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def settled(written: DataFrame) -> DataFrame:
    """(stream, attempt) of the first n so far, from the written changes (with ``batch``)."""
    last = written.groupBy("stream", "attempt").agg(F.max_by("kept", "batch").alias("kept"))
    return last.where("kept").select("stream", "attempt")
