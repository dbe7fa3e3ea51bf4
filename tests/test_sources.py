import json

from pyspark.sql import functions as F

from govspark import functions as G
from govspark.fixed_values import ENFORCEMENT_LEVEL
from govspark.operators.resolve import resolve_policies
from govspark.operators.protect import method_key, row_filter
from govspark.sources.audit import append_audit, split_audit_stream
from govspark.sources.policy_documents import check_documents, write_bundle
from rules import obligation, obligations, resources, retention


def test_bundle_holds_one_document_per_resource(spark, tmp_path):
    rows = obligations(spark, obligation(0, None, ["urn:a:*"], retention=retention(2)))
    found = resolve_policies(resources(spark, ("urn:a:1", {}), ("urn:b:1", {})), rows)
    write_bundle(found, str(tmp_path / "bundle"), "demo", {"git_hash": "abc"})
    docs = {d["resource_urn"]: d for d in (json.loads(r.value) for r in spark.read.text(str(tmp_path / "bundle/policies")).collect())}
    assert docs["urn:a:1"]["retention"]["duration_s"] == 2 * 86400
    assert "retention" not in docs["urn:b:1"]
    assert spark.read.json(str(tmp_path / "bundle/metadata")).first().git_hash == "abc"


def test_broken_documents_are_named(spark):
    docs = spark.createDataFrame(
        [
            ('{"Version":"1","Statement":[{"Sid":"ok1","Effect":"Deny","Action":"*","Resource":["a","b"]}]}',),
            ('{"Statement":[{"Sid":"not ok","Effect":"Maybe","NotAction":"*"}]}',),
            ("{nope",),
        ],
        "document string",
    )
    good, bad, unreadable = [r.errors for r in check_documents(docs).collect()]
    assert good == [] and unreadable == ["invalid JSON"]
    assert bad == ["missing Version", "Sid must be alphanumeric", "Effect must be Allow or Deny", "missing Resource"]


def test_poison_messages_are_kept_apart(spark):
    good = {"id": "1", "project_id": "p", "timestamp": "2024-01-01T00:00:00Z", "actor_id": "a", "resource_urn": "u", "action": "read", "decision": "allow"}
    lines = [json.dumps(good), json.dumps({**good, "actor_id": None}), json.dumps(good)[:-4], ""]
    ok, bad = split_audit_stream(spark.createDataFrame([(line,) for line in lines], "value string"))
    assert [r.id for r in ok.collect()] == ["1"]
    assert sorted(r.status for r in bad.collect()) == ["invalid", "undecodable", "undecodable"]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda column: one.select(column.alias("v")).first().v
    assert value(G.fuzzy_enum(F.lit("LEVEL_BLOCKING"), ENFORCEMENT_LEVEL)) == 1
    assert value(G.fuzzy_enum(F.lit("7"), ENFORCEMENT_LEVEL)) is None
    assert value(G.glob_match(F.lit("a]b"), F.lit("a[]]b"))) and not value(G.glob_match(F.lit("axb"), F.lit("a.b")))
    assert value(G.glob_match(F.lit("a*b"), F.lit("a[*]b"))) and not value(G.glob_match(F.lit("axb"), F.lit("a[*?]b")))
    assert value(G.parse_instant(F.lit("20240131"))).day == 31 and value(G.parse_instant(F.lit("2024"))) is None
    assert value(G.ip_in_cidrs(F.lit("10.1.2.3"), F.array(F.lit("10.1.0.0/16")))) and not value(G.ip_in_cidrs(F.lit("x"), F.array(F.lit("0.0.0.0/0"))))
    assert [method_key(m) for m in range(5)] == ["FULL", "HASH", "FULL", "NOISE_INT", "FULL"]


def test_row_filter_deny_list(spark):
    df = spark.createDataFrame([("US",), ("EU",)], "region string")
    mapping = {"US": ["us"]}
    seen = lambda groups, **kw: [r.region for r in row_filter(df, "mapping", groups, column="region", mapping=mapping, **kw).collect()]
    assert seen(["us"]) == ["US"] and seen(["admin"], denied=["admin"]) == ["US", "EU"]
    assert seen(["us", "temp"], denied=["temp"]) == []
    assert seen(["temp", "us"], denied=["temp"], compat=True) == ["US"] and seen(["guest"], denied=["temp"], compat=True) == ["US", "EU"]


def test_equal_ids_of_a_batch_keep_the_earliest(spark):
    rows = [("a", 5, "late"), ("a", 1, "z"), ("a", 1, "b"), ("b", 2, "known"), ("c", None, "no time")]
    batch = spark.createDataFrame(rows, "id string, timestamp int, note string")
    existing = spark.createDataFrame([("b",)], "id string")
    for parts in (1, 3, 5):
        assert sorted(tuple(r) for r in append_audit(existing, batch.repartition(parts)).collect()) == [("a", 1, "b"), ("c", None, "no time")]
