"""Incremental processing by key as a stream: each trigger handles what is new, once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..sources import writers
from ..sources.ledger import Gate, Ledger


def bounded_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """A file stream; run it with ``available_now`` to read what is there and stop."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(kind).load(path)


def process_once(stream: DataFrame, out: str, checkpoint: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Runs ``work`` on each batch and appends rows with new keys; a repeated batch adds nothing."""
    query = (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, _: writers.append_new(work(df), out, keys) and None).start()
    )
    query.awaitTermination()


def append_exactly_once(stream: DataFrame, ledger: Ledger, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df, gates: Sequence[Gate] = (), name: str = "stream") -> None:
    """Runs ``work`` on each batch and publishes its rows under the batch's number (ST3).

    A batch that was published before the checkpoint knew of it is skipped; one that was only staged is staged anew.
    """
    query = (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, i: ledger.append(work(df), gates, f"{name}/{i}") and None).start()
    )
    query.awaitTermination()
