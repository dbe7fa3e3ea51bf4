"""Run start and end signals, folded per batch as they arrive and merged when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from govspark.operators.lineage import finish_runs, merge_runs, partial_runs
from govspark.streaming.storage import overwrite_batch


def stream_runs(
    spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Fold the signals of each batch per run and write what they say.

    Partial rows of a run merge in any order, so nothing is kept between batches: neither a run without an end nor one that is
    heard of again after years holds state, and a batch that is run again replaces its own rows.
    """
    signals = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(source)
    return (
        signals.writeStream.foreachBatch(lambda batch, batch_id: overwrite_batch(partial_runs(batch), out, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def latest_runs(updates: DataFrame) -> DataFrame:
    """Current state of every run from the table that ``stream_runs`` writes.

    ``merge_runs`` of older batches may stand for them, and may overlap with them.
    """
    return finish_runs(merge_runs(updates))
