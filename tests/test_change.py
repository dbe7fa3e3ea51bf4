import random

import pytest
from pyspark.sql import functions as F

from govspark.operators.change import diff_markdown, diff_policies, diff_versions, risk_delta
from govspark.operators.resolve import resolve_policies
from govspark.schemas import RESOURCES
from rules import ai, geo, obligation, obligations, privacy, purpose, resources, retention

ASSETS = [("urn:lake:a", {}), ("urn:lake:b", {"env": "prod"}), ("urn:mart:c", {}), ("urn:none:d", {})]


def changed(df):
    return sorted((r.resource_urn, r.category, r.field, r.old_value, r.new_value, r.change_type, r.impact) for r in df.collect())


def test_named_changes(spark):
    old = obligations(
        spark,
        obligation(0, include=["urn:lake:*"], retention=retention(30)),
        obligation(1, include=["urn:lake:*"], geofencing=geo(["US", "DE"])),
        obligation(2, include=["urn:mart:*"], purpose=purpose(["ads", "ops"])),
        obligation(3, tags={"env": "prod"}, privacy=privacy(3, epsilon="0.5")),
    )
    new = obligations(
        spark,
        obligation(0, include=["urn:lake:*"], retention=retention(1)),
        obligation(1, include=["urn:lake:*"], geofencing=geo(["US", "DE"])),
        obligation(3, tags={"env": "prod"}, privacy=privacy(3, epsilon="0.1")),
        obligation(7, include=["urn:none:*"], ai_model=ai()),
    )
    changes = diff_versions(resources(spark, *ASSETS), old, new)
    loose, tight = "PERMISSIVE", "RESTRICTIVE"
    duration = ("Retention", "duration", "30 days, 0:00:00", "1 day, 0:00:00", "MODIFIED", tight)
    assert changed(changes) == [
        ("urn:lake:a", *duration),
        ("urn:lake:b", "Privacy", "parameters.epsilon", "0.5", "0.1", "MODIFIED", tight),
        ("urn:lake:b", *duration),
        ("urn:mart:c", "Purpose", "rule", "Restricted", "Open", "REMOVED", loose),
    ]
    assert {r.resource_urn: r.risk_delta for r in risk_delta(changes).collect()} == {"urn:lake:a": -1, "urn:lake:b": -2, "urn:mart:c": 1}
    named = resources(spark, *ASSETS).withColumnRenamed("urn", "resource_urn")
    reports = {r.resource_urn: r.report for r in diff_markdown(changes, named).collect()}
    assert len(reports) == 4 and "No Material Changes" in reports["urn:none:d"] and "Was: 3" in reports["urn:lake:b"]


@pytest.mark.parametrize("seed", [1, 2])
def test_versions_equal_snapshots(spark, seed):
    """One match over both versions says what two finished snapshots say, also for resources without a project."""
    draw = random.Random(seed)

    def rule(n):
        target = draw.choice([{"include": [f"urn:s{draw.randrange(4)}:*"]}, {"include": ["urn:*"], "exclude": [f"*:t{draw.randrange(6)}"]}])
        kind = draw.choice([
            {"retention": retention(draw.randrange(1, 5))}, {"geofencing": geo(draw.sample(["US", "DE", "FR"], 2), draw.sample(["CN", "FR"], 1))},
            {"purpose": purpose(draw.sample(["a", "b", "c"], 2))}, {"privacy": privacy(draw.choice([1, 2]))}, {"ai_model": ai(draw.random() < 0.5)},
        ])
        return obligation(n, project=draw.choice([None, "p", "q"]), **target, **kind)

    before = [rule(n) for n in range(20)]
    after = [row if draw.random() < 0.6 else rule(n) for n, row in enumerate(before) if draw.random() < 0.9] + [rule(30), rule(31)]
    assets = [
        (draw.choice(["p", "q", None]), f"urn:s{i % 5}:t{i % 7}:{i}", "lake", None, {}, 0, 0, True, None) for i in range(60)
    ]
    held = spark.createDataFrame(assets, RESOURCES)
    old, new = obligations(spark, *before), obligations(spark, *after)
    columns = ["project_id", "resource_urn", "old_obligations", "new_obligations", "position", "old_value", "new_value", "impact", "description"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    got = rows(diff_versions(held, old, new, strict=True))
    assert got and got == rows(diff_policies(resolve_policies(held, old), resolve_policies(held, new), strict=True))
    assert diff_versions(held, old, old).count() == 0
    assert diff_versions(held, old.limit(0), new.limit(0)).count() == 0
    only_new = diff_versions(held, old.limit(0), new)
    assert only_new.count() > 0 and only_new.filter(F.col("old_obligations") != 0).count() == 0
