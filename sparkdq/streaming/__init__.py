"""Structured Streaming entry points for the stateless operators.

The reference has no streaming; masking, repairs of single columns, validity
checks and query-log statistics are per-row expressions, so they run on a
streaming DataFrame unchanged.  The profile is computed per micro-batch with
``foreachBatch`` and kept in a table with one folder per batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.batches import ProfileHistory
from ..operators.masks import apply_masks
from ..operators.profile import profile


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def mask_stream(stream: DataFrame, actions: Iterable[Mapping], sink_path: str, checkpoint_path: str,
                fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Mask a stream with an action list and append it to ``sink_path`` (exactly-once file sink)."""
    out = apply_masks(stream, list(actions))
    w = out.writeStream.format(fmt).option("path", sink_path).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.outputMode("append").start()


def profile_stream(stream: DataFrame, sink_path: str, checkpoint_path: str, available_now: bool = True,
                   **profile_args) -> StreamingQuery:
    """Write the long profile of every micro-batch to ``sink_path``, in a folder ``batch_id=<n>`` of its own.

    ``foreachBatch`` may give a batch again after a failure: its folder is then replaced, so nothing is stored twice.
    """

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        profile(batch, **profile_args).write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def profile_history_stream(stream: DataFrame, path: str, checkpoint_path: str, available_now: bool = True,
                           **history_args) -> StreamingQuery:
    """Add every micro-batch to the ``ProfileHistory`` at ``path``: one profile of the whole stream so far, duplicates
    across micro-batches counted, without reading earlier ones.  A repeated micro-batch replaces itself."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()  # states and digests both read it
        try:
            ProfileHistory(batch.sparkSession, path, **history_args).add(kept, str(batch_id))
        finally:
            kept.unpersist()

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
