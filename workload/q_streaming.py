"""Streams over the audit events: written as messages, read to the end, compared with the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.schemas import RUN_SIGNAL
from govspark.session import ensure_checkpoint_dir
from govspark.streaming import latest_runs, live_tail, stream_ingest, stream_runs, stream_seal, stream_traffic
from workload.q_ledger import BLOCKS, CAPACITY, ENTRIES, hashed
from workload.q_lineage import RUNS
from workload.registry import query
from workload.tables import Tables, as_of

TO_THE_END = {"availableNow": True}


def _folder(t: Tables) -> str:
    """A new folder in the shared place of the cluster."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _deliver(events: DataFrame, folder: str) -> None:
    """Append the events as messages, a directory per project."""
    message = F.to_json(F.struct(*events.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    events.select("project_id", message.alias("value")).write.mode("append").partitionBy("project_id").text(f"{folder}/in")


@query("t1_stream_ingest", "SELECT id, project_id, actor_id, action FROM v_audit_log")
def t1_stream_ingest(t: Tables) -> DataFrame:
    folder, log = _folder(t), t.audit_log()
    # Two thirds arrive first; then every event is delivered, those for the second time.
    for events in (log.filter(F.col("id").cast("bigint") % 3 != 0), log):
        _deliver(events, folder)
        stream_ingest(t.spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", TO_THE_END).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out/log").select("id", "project_id", "actor.id", "action").toDF("id", "project_id", "actor_id", "action")


@query("t3_late_folders", "SELECT id, project_id, CASE WHEN project_id = 'p1' THEN 'first' ELSE 'later' END AS run FROM v_audit_log")
def t3_late_folders(t: Tables) -> DataFrame:
    """Folders of other projects appear after the first run; two files are read at a time."""
    folder, log = _folder(t), t.audit_log()
    ends = []
    for events in (log.filter("project_id = 'p1'"), log.filter("project_id <> 'p1'")):
        _deliver(events, folder)
        stream_ingest(t.spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", TO_THE_END, max_files=2).awaitTermination()
        ends.append(t.spark.read.parquet(f"{folder}/out/log").agg(F.max("batch_id")).first()[0])
    run = F.when(F.col("batch_id") <= ends[0], F.lit("first")).otherwise(F.lit("later"))
    return t.spark.read.parquet(f"{folder}/out/log").select("id", "project_id", run.alias("run"))


@query("t4_stream_seal", f"WITH {ENTRIES}, {BLOCKS} SELECT project_id, sequence_index, prev_block_hash, merkle_root, log_count, leaf_sum FROM blocks")
def t4_stream_seal(t: Tables) -> DataFrame:
    """The older half of the entries fills whole blocks; its rest waits and is sealed with the newer half, by age."""
    folder = _folder(t)
    log = hashed(t).select("project_id", "id", "timestamp", "entry_hash")
    middle = t.audit_log().agg(F.timestamp_micros(F.percentile_approx(F.unix_micros("timestamp"), 0.5))).first()[0]
    parts = [(F.col("timestamp") < middle, {"min_entries": CAPACITY, "max_age_s": 10**9}), (F.col("timestamp") >= middle, {})]
    for part, limits in parts:
        log.filter(part).write.mode("append").parquet(f"{folder}/log")
        stream_seal(
            t.spark, f"{folder}/log", f"{folder}/out", f"{folder}/state", as_of, TO_THE_END, capacity=CAPACITY, **limits
        ).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out/blocks").select(
        "project_id", "sequence_index", "prev_block_hash", "merkle_root", "log_count", "leaf_sum"
    )


@query("t5_run_state", f"WITH {RUNS} SELECT * FROM runs")
def t5_run_state(t: Tables) -> DataFrame:
    """Signals of a run arrive in two deliveries, the later ones by number first."""
    folder, signals = _folder(t), t.run_signals().select(*RUN_SIGNAL.names)
    stamp = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    for odd in (1, 0):
        signals.filter(F.pmod("seq", F.lit(2)) == odd).write.mode("append").options(**stamp).json(f"{folder}/in")
        stream_runs(t.spark, f"{folder}/in", RUN_SIGNAL, f"{folder}/out", f"{folder}/state", TO_THE_END).awaitTermination()
    return latest_runs(t.spark.read.parquet(f"{folder}/out"))


@query("t6_stream_traffic", """WITH hours AS (SELECT project_id, date_trunc('hour', timestamp_) AS hour, count(*) FILTER (WHERE decision = 'ALLOW') AS allowed,
  count(*) FILTER (WHERE decision = 'DENY') AS denied FROM v_audit_log GROUP BY 1, 2)
SELECT * FROM hours WHERE hour + INTERVAL 2 HOUR <= (SELECT max(timestamp_) FROM v_audit_log)""")
def t6_stream_traffic(t: Tables) -> DataFrame:
    """Hours that the watermark of one hour has passed; the newest ones are still open at the end."""
    folder = _folder(t)
    _deliver(t.audit_log(), folder)
    stream_traffic(t.spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", trigger=TO_THE_END).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")


@query("t7_live_tail", "SELECT * FROM (SELECT id, project_id, action FROM v_audit_log ORDER BY timestamp_ DESC, id LIMIT 50)")
def t7_live_tail(t: Tables) -> DataFrame:
    folder, log = _folder(t), t.audit_log()
    for part in (0, 1):
        _deliver(log.filter(F.col("id").cast("bigint") % 2 == part), folder)
        live_tail(t.spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", trigger=TO_THE_END).awaitTermination()
    tail = t.spark.read.parquet(f"{folder}/out")
    newest = tail.agg(F.max("batch_id").alias("batch_id"))
    return tail.join(newest, "batch_id").select("id", "project_id", "action")
