"""Inputs that the benchmark views never produce."""

import hashlib
import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from govspark.functions.text import normalize_type
from govspark.operators.decide import evaluate_requests
from govspark.operators.ledger import seal
from govspark.operators.protect import retention_sweep
from govspark.operators.resolve import resolve_policies
from govspark.operators.stats import kpis, list_audit
from govspark.schemas import REQUESTS
from govspark.sources.policy_documents import check_documents, opa_documents, write_bundle
from govspark.streaming.audit import ingest_batch
from govspark.streaming.storage import read_or_none
from rules import obligation, obligations, privacy, resources, retention

NOW = datetime(2024, 2, 1, 12)
ALL = ["urn:*"]


def test_distinct_requests_keep_nulls(spark):
    rows = obligations(spark, obligation(0, None, ALL, retention=retention(30)))
    policies = resolve_policies(resources(spark, ("urn:x:a", {})), rows)
    known = {"request_id": 0, "project_id": "p", "resource_urn": "urn:x:a", "action": "read", "actor_id": "u", "context": {}}
    changed = [{"actor_id": None}, {"action": None}, {"context": None}, {}, {}, {"resource_urn": None}]
    full = [{**known, **c, "request_id": i} for i, c in enumerate(changed)]
    requests = spark.createDataFrame([tuple(r.get(n) for n in REQUESTS.names) for r in full], REQUESTS)
    found = lambda dedupe: {r.request_id: (r.allowed, r.reason) for r in evaluate_requests(requests, policies, NOW, dedupe=dedupe).collect()}
    assert found(True) == found(False) and len(found(True)) == len(full)


def test_both_forms_of_a_sweep_agree_on_dates(spark):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(5)] + [None]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for as_of in (datetime(2024, 2, 1, 12), datetime(2024, 2, 1)):
        fixed, _ = retention_sweep(df, "d", as_of, 30 * 86400)
        each, _ = retention_sweep(df, "d", as_of, F.lit(30 * 86400))
        assert sorted(r.d for r in fixed.collect()) == sorted(r.d for r in each.collect())


def test_a_block_without_hashes_leaves_no_gap(spark):
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    rows = [("p", f"{i:02d}", NOW - timedelta(seconds=5000 - i), None if i < 4 else digest(i)) for i in range(12)]
    log = spark.createDataFrame(rows, "project_id string, id string, timestamp timestamp, entry_hash string")
    heads = spark.createDataFrame([], "project_id string, sequence_index bigint, merkle_root string")
    blocks, links = seal(log, heads, NOW, capacity=4)
    assert [(b.sequence_index, b.prev_block_hash == "0" * 64) for b in blocks.orderBy("sequence_index").collect()] == [(0, True), (1, False)]
    assert {r.log_id for r in links.collect()} == {f"{i:02d}" for i in range(4, 12)}


@pytest.mark.parametrize(("settings", "conflict"), [([(1, "X"), (1, "Y"), (2, "Z")], True), ([(2, "Z"), (1, "X"), (1, "Y")], False), ([(1, "X"), (2, "Z"), (1, "Y")], False)])
def test_conflicts_are_met_in_order(spark, settings, conflict):
    rows = [obligation(i, None, ALL, privacy=privacy(m, algorithm=a)) for i, (m, a) in enumerate(settings)]
    (row,) = resolve_policies(resources(spark, ("urn:x:a", {})), obligations(spark, *rows)).collect()
    assert row.privacy.conflict is conflict and row.privacy.method == 2 and row.privacy.parameters == {"algorithm": "Z"}


def test_one_urn_in_two_projects(spark, tmp_path):
    rows = obligations(spark, obligation(0, None, ALL, project="p", retention=retention(1)), obligation(1, None, ALL, project="q", retention=retention(2)))
    one = resources(spark, ("urn:x:a", {}))
    policies = resolve_policies(one.unionByName(one.withColumn("project_id", F.lit("q"))), rows)
    write_bundle(policies, str(tmp_path / "bundle"))
    docs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "bundle/policies")).collect()]
    assert {(d["project_id"], d["retention"]["duration_s"]) for d in docs} == {("p", 86400), ("q", 2 * 86400)}
    opa = check_documents(opa_documents(policies), "opa").collect()
    assert {r.project_id for r in opa} == {"p", "q"} and all(r.errors == [] for r in opa)


def test_rules_without_a_project_count_for_each(spark):
    rows = obligations(spark, obligation(0, None, ALL, retention=retention(1)), obligation(1, None, ALL, project="p", retention=retention(1)))
    log = spark.createDataFrame([("q", NOW, "DENY", "1"), ("q", NOW, "ALLOW", "2")], "project_id string, timestamp timestamp, decision string, id string")
    found = {r.project_id: r.active_obligations for r in kpis(log, rows, resources(spark, ("urn:x:a", {})), NOW).collect()}
    assert found == {"p": 2, "q": 1}
    assert [r.id for r in list_audit(log, "q", limit=1, decision="ALLOW").collect()] == ["2"]


def test_types_of_any_depth(spark):
    cases = {
        "array<array<array<variant>>>": "ARRAY<ARRAY<ARRAY<STRING>>>", "array<array<array<array<json>>>>": "ARRAY<ARRAY<ARRAY<ARRAY<STRING>>>>",
        "array": "ARRAY<STRING>", "map": "MAP<STRING,STRING>", "map<variant,array<variant>>": "MAP<STRING,ARRAY<STRING>>", "": "STRING", "money": "MONEY",
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string").withColumn("got", normalize_type("t"))
    assert {r.t: r.got for r in df.collect()} == cases


def test_an_id_of_another_day_is_stored_once(spark, tmp_path):
    entry = lambda day: json.dumps({"id": "a", "project_id": "p", "timestamp": f"2024-01-0{day}T00:00:00Z", "actor_id": "u", "resource_urn": "urn:x", "action": "read", "decision": "DENY"})
    for batch in (0, 1):
        ingest_batch(spark.createDataFrame([(entry(batch + 1),)], "value string"), batch, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_a_damaged_table_is_not_an_empty_one(spark, tmp_path):
    assert read_or_none(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017
        read_or_none(spark, str(tmp_path / "bad"))


def test_addresses_of_both_families(spark):
    from govspark.functions.net import cidr_contains

    cases = [
        ("10.0.0.0/8", "10.255.0.1", True), ("10.0.0.0/8", "11.0.0.1", False), ("1.2.3.4", "1.2.3.4", True), ("0.0.0.0/0", "9.9.9.9", True),
        ("1.2.3.4/33", "1.2.3.4", False), ("1.2.3.4/x", "1.2.3.4", False), ("2001:db8::/32", "2001:DB8:0:1::9", True),
        ("2001:db8::/32", "2001:db9::1", False), ("::1", "0:0:0:0:0:0:0:1", True), ("::/0", "fe80::1", True), ("::/0", "1.2.3.4", False),
        ("0.0.0.0/0", "::1", False), ("fe80::/10", "febf::", True), ("fe80::/10", "fec0::", False), ("::/0", "1::2::3", False),
        ("::/0", "1:2:3:4:5:6:7", False), ("::/0", "12345::", False), ("::/0", ":1::", False), ("::/0", None, False), (None, "::1", False),
        ("64:ff9b::/96", "64:ff9b::10.1.2.3", True), ("64:ff9b::10.0.0.0/104", "64:ff9b::a01:203", True), ("::/0", "1:2:3:4:5:6:7:1.2.3.4", False),
        ("1:2:3:4:5:6:0.0.0.0/112", "1:2:3:4:5:6:0.0.9.9", True), ("::/0", "::1.2.3", False), ("::/0", "::1.2.3.256", False), ("::/0", "::1.2.3.4:5", False),
        ("10.0.0.0/8", "::ffff:10.9.9.9", True), ("::ffff:10.0.0.0/104", "10.9.9.9", True), ("::ffff:0:0/96", "8.8.8.8", True), ("::ffff:0:0/95", "8.8.8.8", False),
        ("::/0", "::ffff:1.2.3.4", False), ("0.0.0.0/0", "::ffff:102:304", True), ("10.0.0.0/8", "10.01.2.3", False), ("010.0.0.0/8", "10.1.2.3", False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, cidr string, ip string, want boolean")
    wrong = df.withColumn("got", cidr_contains(F.col("cidr"), F.col("ip"))).filter("got <> want").collect()
    assert wrong == []


def test_graph_carries_tags_and_edge_ids(spark):
    import hashlib
    from datetime import datetime

    from govspark.operators.lineage import lineage_graph

    at = datetime(2024, 1, 30)
    edges = spark.createDataFrame(
        [("p", "r1", "urn:a", "urn:b"), (None, "r2", "urn:a", "urn:model:c")], "project_id string, external_run_id string, source_urn string, target_urn string"
    )
    runs = spark.createDataFrame(
        [("p", "r1", "ETL", at, True, ""), (None, "r2", "ETL", at, True, "me")],
        "project_id string, external_run_id string, run_type string, started_at timestamp, success boolean, triggered_by string",
    )
    held = spark.createDataFrame(
        [("p", "urn:a", "lake", "A", {"env": "prod"}, 1, 1, True), (None, "urn:a", "lake", "N", None, 1, 1, False)],
        "project_id string, urn string, platform string, name string, tags map<string,string>, sensitivity int, risk_level int, ai_training_allowed boolean",
    )
    nodes, shown = lineage_graph(edges, runs, held, datetime(2024, 2, 1))
    got = {(r.project_id, r.id): (r.label, r.tags, r.is_ai_restricted) for r in nodes.collect()}
    assert got == {
        ("p", "urn:a"): ("A", {"env": "prod"}, False), ("p", "urn:b"): ("b", {}, False),
        (None, "urn:a"): ("N", {}, True), (None, "urn:model:c"): ("c", {}, False),
    }
    ids = {r.run_id: r.id for r in shown.collect()}
    assert ids["r1"] == hashlib.sha256(b"p|r1|urn:a|urn:b").hexdigest() and len(ids) == 2
    bare, _ = lineage_graph(edges, runs, held.drop("tags"), datetime(2024, 2, 1))
    assert {len(r.tags) for r in bare.collect()} == {0}
