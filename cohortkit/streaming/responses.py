"""Streaming validation of model responses (G3 on a stream).

Validation is stateless per row, so the same expressions run on a streaming source. Each
micro-batch writes the outcome, the accepted receipts and their lines; a batch folder is
overwritten on replay, so a retried batch does not duplicate rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortkit.operators import validate as V
from cohortkit.session import materialize

RESPONSE_SCHEMA = "attempt long, raw string"


def _write_batch(sink: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = materialize(V.parse_responses(batch))  # parsed once for the three outputs
        for name, df in (("outcome", V.validation_outcome(parsed)), ("receipts", V.accepted_receipts(parsed)),
                         ("items", V.accepted_items(parsed))):
            df.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/{name}/batch={batch_id}")
    return write


def validate_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, fmt: str = "json",
                    available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start a streaming query that validates every new response file under ``source``.

    ``checkpoint`` must be a shared folder (the query's progress and offsets live there).
    With ``available_now`` the query processes what is there and stops.
    """
    reader = spark.readStream.schema(RESPONSE_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.load(source)
    writer = stream.writeStream.foreachBatch(_write_batch(sink)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
