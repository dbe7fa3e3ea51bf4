"""Streams give what the batch operators give on the same files, also after a restart."""

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from govspark.operators.ledger import entry_hash, seal
from govspark.operators.lineage import collapse_runs, merge_runs
from govspark.schemas import RUN_SIGNAL
from govspark.sources.audit import append_audit, canonicalize_audit, split_audit_stream
from govspark.streaming import latest_runs, live_tail, stream_ingest, stream_runs, stream_seal, stream_traffic

START = datetime(2024, 1, 1)
ONCE = {"availableNow": True}


def event(i, project):
    at = START + timedelta(minutes=7 * i)
    return {
        "id": f"{project}-{i}", "project_id": project, "timestamp": at.isoformat() + "Z", "actor_id": f"u{i % 5}", "resource_urn": "urn:x", "action": "read",
        "decision": "DENY" if i % 4 == 0 else "ALLOW", "reason_trace": json.dumps({"decision_reason": "geo"}), "request_context": '{"b":1,"a":2}',
    }


def drop(path, project, name, rows):
    folder = path / f"project_id={project}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None


@pytest.fixture()
def source(tmp_path):
    src = tmp_path / "in"
    drop(src, "a", "1.json", [event(i, "a") for i in range(40)] + ["{broken", json.dumps({"id": "x"})])
    return src


def test_ingest_restart_and_seal(spark, tmp_path, source):
    out, ckpt, ledger = str(tmp_path / "out"), str(tmp_path / "ckpt"), str(tmp_path / "ledger")
    finish(stream_ingest(spark, str(source), out, ckpt, ONCE))
    clock = lambda: START + timedelta(days=9)
    limits = {"min_entries": 30, "max_age_s": 10**9, "capacity": 50}
    finish(stream_seal(spark, f"{out}/log", ledger, str(tmp_path / "ckpt2"), clock, ONCE, **limits))
    # A new project appears, and old messages are delivered again.
    drop(source, "b", "1.json", [event(i, "b") for i in range(20)])
    drop(source, "a", "2.json", [event(i, "a") for i in range(30, 60)])
    finish(stream_ingest(spark, str(source), out, ckpt, ONCE))
    finish(stream_seal(spark, f"{out}/log", ledger, str(tmp_path / "ckpt2"), clock, ONCE, **limits))

    log = spark.read.parquet(f"{out}/log")
    lines = spark.read.option("recursiveFileLookup", "true").text(str(source))
    good, bad = split_audit_stream(lines)
    want = entry_hash(canonicalize_audit(append_audit(good.limit(0), good)))
    pairs = lambda df: sorted((r.id, r.entry_hash) for r in df.collect())
    assert pairs(log) == pairs(want) and log.count() == 80
    assert spark.read.parquet(f"{out}/quarantine").count() == bad.count() == 2

    blocks = {(r.project_id, r.sequence_index): r for r in spark.read.parquet(f"{ledger}/blocks").collect()}
    # Forty entries were sealed at once; twenty of each project wait for more.
    assert sorted(blocks) == [("a", 0)]
    first = want.filter("project_id = 'a' AND CAST(substring(id, 3) AS INT) < 40")
    alone, _ = seal(first, spark.createDataFrame([], "project_id string, sequence_index bigint, merkle_root string"), clock(), 30, 10**9, 50)
    assert blocks["a", 0].merkle_root == alone.first().merkle_root
    newest = spark.read.parquet(f"{ledger}/open").agg(F.max("batch_id")).first()[0]
    assert spark.read.parquet(f"{ledger}/open/batch_id={newest}").count() == 40


def test_idle_project_is_sealed_by_age(spark, tmp_path, source):
    out, ledger, ckpt = str(tmp_path / "out"), str(tmp_path / "ledger"), str(tmp_path / "c2")
    finish(stream_ingest(spark, str(source), out, str(tmp_path / "c1"), ONCE))
    limits = {"min_entries": 1000, "max_age_s": 10**6, "capacity": 1000}
    finish(stream_seal(spark, f"{out}/log", ledger, ckpt, lambda: START + timedelta(hours=9), ONCE, **limits))
    assert spark.read.parquet(f"{ledger}/blocks").count() == 0
    time.sleep(2)
    finish(stream_seal(spark, f"{out}/log", ledger, ckpt, lambda: START + timedelta(days=30), ONCE, **limits))
    assert [(r.project_id, r.sequence_index) for r in spark.read.parquet(f"{ledger}/blocks").collect()] == [("a", 0)]


def test_traffic_and_tail(spark, tmp_path, source):
    finish(stream_traffic(spark, str(source), str(tmp_path / "traffic"), str(tmp_path / "c1"), trigger=ONCE))
    got = {r.hour: (r.allowed, r.denied) for r in spark.read.parquet(str(tmp_path / "traffic")).collect()}
    want = {}
    for i in range(40):
        hour = (START + timedelta(minutes=7 * i)).replace(minute=0)
        allowed, denied = want.get(hour, (0, 0))
        want[hour] = (allowed + (i % 4 != 0), denied + (i % 4 == 0))
    # Hours past the watermark are final and written; later ones wait.
    assert got and all(want[h] == v for h, v in got.items()) and len(got) >= len(want) - 2
    finish(live_tail(spark, str(source), str(tmp_path / "tail"), str(tmp_path / "c2"), limit=5, trigger=ONCE))
    drop(source, "a", "2.json", [event(i, "a") for i in range(40, 43)])
    finish(live_tail(spark, str(source), str(tmp_path / "tail"), str(tmp_path / "c2"), limit=5, trigger=ONCE))
    table = spark.read.parquet(str(tmp_path / "tail"))
    newest = table.filter(F.col("batch_id") == table.agg(F.max("batch_id")).first()[0])
    assert sorted(r.id for r in newest.collect()) == ["a-38", "a-39", "a-40", "a-41", "a-42"]


def test_runs(spark, tmp_path):
    src = tmp_path / "signals"
    src.mkdir()
    start = {"project_id": "p", "external_run_id": "r1", "seq": 1, "received_at": START.isoformat(), "run_type": "AI_TRAINING", "started_at": START.isoformat(), "triggered_by": "me"}
    end = {"project_id": "p", "external_run_id": "r1", "seq": 2, "received_at": START.isoformat(), "run_type": "UNSPECIFIED", "ended_at": START.isoformat(), "success": True, "triggered_by": "other"}
    out, ckpt = str(tmp_path / "runs"), str(tmp_path / "c")
    (src / "1.json").write_text(json.dumps(start) + "\n" + json.dumps({**start, "external_run_id": "r2"}) + "\n")
    finish(stream_runs(spark, str(src), RUN_SIGNAL, out, ckpt, ONCE))
    (src / "2.json").write_text(json.dumps(end) + "\n")
    finish(stream_runs(spark, str(src), RUN_SIGNAL, out, ckpt, ONCE))
    batch = collapse_runs(spark.read.schema(RUN_SIGNAL).json(str(src)))
    rows = lambda df: sorted(tuple(r.asDict().items()) for r in df.select(*batch.columns).collect())
    got = rows(latest_runs(spark.read.parquet(out)))
    assert got == rows(batch) and dict(got[0])["triggered_by"] == "me" and dict(got[0])["success"] is True


def test_late_signals_need_no_state(spark, tmp_path):
    """One file a batch; a run is heard of again after its end and after many others, and earlier numbers come late."""
    src, out, ckpt = tmp_path / "signals", str(tmp_path / "runs"), str(tmp_path / "c")
    src.mkdir()
    at = lambda n: (START + timedelta(hours=n)).isoformat()
    signal = lambda run, seq, **more: json.dumps({"project_id": "p", "external_run_id": run, "seq": seq, "received_at": at(seq or 0), **more})
    deliveries = [
        [signal("r", 5, ended_at=at(5), success=True, triggered_by="late")],
        [signal(f"x{i}", 1, run_type="ETL_TRANSFORM", started_at=at(1)) for i in range(20)],
        [signal("r", 2, run_type="AI_TRAINING", started_at=at(2), triggered_by="early"), signal("none", None)],
        [signal("r", 7, ended_at=at(7), success=False), signal("r", 5, ended_at=at(5), success=True, triggered_by="late")],
    ]
    for n, lines in enumerate(deliveries):
        (src / f"{n}.json").write_text("\n".join(lines) + "\n")
        query = stream_runs(spark, str(src), RUN_SIGNAL, out, ckpt, ONCE)
        finish(query)
        assert not any(p["stateOperators"] for p in query.recentProgress)
    updates = spark.read.parquet(out)
    batch = collapse_runs(spark.read.schema(RUN_SIGNAL).json(str(src)))
    rows = lambda df: sorted(str(r.asDict()) for r in df.select(*batch.columns).collect())
    assert rows(latest_runs(updates)) == rows(batch) and len(rows(batch)) == 22
    old = merge_runs(updates.filter("batch_id < 3"))
    assert rows(latest_runs(old.unionByName(updates.drop("batch_id")))) == rows(batch)
    r = batch.filter("external_run_id = 'r'").first()
    assert (r.run_type, r.started_at, r.ended_at, r.success, r.triggered_by) == ("AI_TRAINING", START + timedelta(hours=2), START + timedelta(hours=7), False, "early")


def test_files_per_batch_are_bounded(spark, tmp_path):
    """Three files, two at a time, then a project whose folder appears later."""
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    for n in range(3):
        drop(src, "a", f"{n}.json", [event(i, "a") for i in range(10 * n, 10 * n + 10)])
    finish(stream_ingest(spark, str(src), out, ckpt, ONCE, max_files=2))
    drop(src, "b", "0.json", [event(i, "b") for i in range(10)])
    finish(stream_ingest(spark, str(src), out, ckpt, ONCE, max_files=2))
    log = spark.read.parquet(f"{out}/log").groupBy("batch_id").agg(F.collect_set("project_id").alias("p"), F.count("*").alias("n"))
    assert sorted((r.batch_id, tuple(r.p), r.n) for r in log.collect()) == [(0, ("a",), 20), (1, ("a",), 10), (2, ("b",), 10)]
