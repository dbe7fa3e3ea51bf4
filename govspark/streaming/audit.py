"""Audit events as a stream of JSON files, one directory per project.

Every sink writes into a ``batch_id`` partition and overwrites it, so a batch that is run again after
a failure replaces its own output and nothing is stored twice.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from govspark.operators.ledger import entry_hash, seal
from govspark.sources.audit import append_audit, canonicalize_audit, first_per_id, parse_audit_stream
from govspark.streaming.storage import overwrite_batch, read_or_none


def _start(writer, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    options = trigger or {"processingTime": "1 second"}
    return writer.option("checkpointLocation", checkpoint).trigger(**options).start()


def read_messages(spark: SparkSession, source: str, max_files: int | None = None) -> DataFrame:
    """Text lines below ``source``; directories that appear later are picked up as well."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(source)


def ingest_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """Decode, hash and append the new entries of one micro-batch.

    An id is stored once, whatever the day it is delivered again. Of the log, only its ids are read.
    """
    spark = batch.sparkSession
    parsed = parse_audit_stream(batch).persist()
    try:
        bad = parsed.filter(F.col("status") != "good").select("value", "status")
        overwrite_batch(bad, f"{out}/quarantine", batch_id)
        good = parsed.filter(F.col("status") == "good").drop("value", "status").withColumn("day", F.to_date("timestamp"))
        known = read_or_none(spark, f"{out}/log")
        if known is None:
            fresh = first_per_id(good)
        else:
            fresh = append_audit(known.filter(F.col("batch_id") != batch_id), good)
        overwrite_batch(entry_hash(canonicalize_audit(fresh)).withColumn("day", F.to_date("timestamp")), f"{out}/log", batch_id, ["day"])
    finally:
        parsed.unpersist()


def stream_ingest(
    spark: SparkSession, source: str, out: str, checkpoint: str, trigger: dict | None = None, max_files: int | None = 1000
) -> StreamingQuery:
    """Read all project directories, quarantine bad messages, hash and append each id once."""
    writer = read_messages(spark, source, max_files).writeStream.foreachBatch(
        lambda batch, batch_id: ingest_batch(batch, batch_id, out)
    )
    return _start(writer, checkpoint, trigger)


_SEALED = ["project_id", "id", "timestamp", "entry_hash"]


def seal_batch(batch: DataFrame, batch_id: int, out: str, as_of: datetime, **limits: int) -> None:
    """Seal what is due among the entries left open so far and the new ones.

    Only open entries and the head of each chain are carried from batch to batch, so the cost follows
    the new entries and not the length of the log.
    """
    spark = batch.sparkSession
    entries = batch.select(*_SEALED).filter(F.col("id").isNotNull())
    # Every batch writes both, so only the first may find nothing: a lost head would start its chain anew.
    before = lambda name: spark.read.parquet(f"{out}/{name}/batch_id={batch_id - 1}") if batch_id else None
    left_open, heads = before("open"), before("heads")
    if left_open is not None:
        entries = entries.unionByName(left_open.select(*entries.columns))
    if heads is None:
        heads = spark.createDataFrame([], "project_id string, sequence_index bigint, merkle_root string")
    entries = entries.persist()
    try:
        blocks, links = seal(entries, heads, as_of, **limits)
        overwrite_batch(links.drop("entry_hash"), f"{out}/links", batch_id)
        overwrite_batch(blocks, f"{out}/blocks", batch_id)
        done = spark.read.parquet(f"{out}/links/batch_id={batch_id}").select(F.col("log_id").alias("id"))
        overwrite_batch(entries.join(done, "id", "left_anti").select(*entries.columns), f"{out}/open", batch_id)
        newest = spark.read.parquet(f"{out}/blocks/batch_id={batch_id}").select(*heads.columns)
        head = heads.unionByName(newest).groupBy("project_id").agg(
            F.max("sequence_index").alias("sequence_index"), F.max_by("merkle_root", "sequence_index").alias("merkle_root")
        )
        overwrite_batch(head, f"{out}/heads", batch_id)
    finally:
        entries.unpersist()


def stream_seal(
    spark: SparkSession,
    log: str,
    out: str,
    checkpoint: str,
    clock: Callable[[], datetime],
    trigger: dict | None = None,
    **limits: int,
) -> StreamingQuery:
    """Seal blocks as entries arrive in the log directory. ``clock`` gives the time for the age rule.

    A beat of rows without an id makes batches while no file arrives, so that entries of an idle project are sealed by age.
    """
    schema = spark.read.parquet(log).schema
    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    beat = beat.select(*[F.lit(None).cast(schema[c].dataType).alias(c) for c in _SEALED])
    stream = spark.readStream.schema(schema).parquet(log).select(*_SEALED).unionByName(beat)
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: seal_batch(batch, batch_id, out, clock(), **limits))
    return _start(writer, checkpoint, trigger or {"processingTime": "10 seconds"})


def traffic(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Allowed and denied events per project and hour; late rows count up to ``delay``."""
    return (
        events.withWatermark("timestamp", delay)
        .groupBy("project_id", F.window("timestamp", "1 hour"))
        .agg(
            F.count_if(F.col("decision") == "ALLOW").alias("allowed"),
            F.count_if(F.col("decision") == "DENY").alias("denied"),
        )
        .select("project_id", F.col("window.start").alias("hour"), "allowed", "denied")
    )


def stream_traffic(
    spark: SparkSession, source: str, out: str, checkpoint: str, delay: str = "1 hour", trigger: dict | None = None
) -> StreamingQuery:
    """Hourly traffic, written once an hour is past the watermark."""
    parsed = parse_audit_stream(read_messages(spark, source)).filter(F.col("status") == "good")
    writer = traffic(parsed, delay).writeStream.outputMode("append").format("parquet").option("path", out)
    return _start(writer, checkpoint, trigger)


def tail_batch(batch: DataFrame, batch_id: int, out: str, limit: int) -> None:
    spark = batch.sparkSession
    before = read_or_none(spark, f"{out}/batch_id={batch_id - 1}")
    rows = batch if before is None else batch.unionByName(before.select(*batch.columns))
    overwrite_batch(rows.orderBy(F.col("timestamp").desc(), "id").limit(limit), out, batch_id)


def live_tail(
    spark: SparkSession, source: str, out: str, checkpoint: str, limit: int = 50, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the newest ``limit`` events; the partition with the highest batch_id is current."""
    parsed = parse_audit_stream(read_messages(spark, source)).filter(F.col("status") == "good").drop("value", "status")
    writer = parsed.writeStream.foreachBatch(lambda batch, batch_id: tail_batch(batch, batch_id, out, limit))
    return _start(writer, checkpoint, trigger or {"processingTime": "3 seconds"})
