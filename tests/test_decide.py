from datetime import datetime

import pytest

from govspark.operators.decide import evaluate_requests, explain_decisions
from govspark.operators.resolve import resolve_policies
from govspark.schemas import REQUESTS
from rules import ai, geo, obligation, obligations, privacy, purpose, resources, retention

NOW = datetime(2024, 2, 1)


@pytest.fixture(scope="module")
def policies(spark):
    rules = [
        obligation(0, None, ["urn:x:ban"], geofencing=geo(["US"])),
        obligation(1, None, ["urn:x:ban"], geofencing=geo(["DE"])),
        obligation(2, None, ["urn:x:geo"], geofencing=geo(["DE", "FR"], ["CN"])),
        obligation(3, None, ["urn:x:use"], purpose=purpose(["ANALYTICS"], ["SALES"])),
        obligation(4, None, ["urn:x:ai"], ai_model=ai(False, False, False)),
        obligation(5, None, ["urn:x:old"], retention=retention(30)),
        obligation(6, None, ["urn:x:mask"], privacy=privacy(2)),
        obligation(7, None, ["urn:x:lower"], geofencing=geo(["de"])),
    ]
    names = ["ban", "geo", "use", "ai", "old", "mask", "lower", "open"]
    return resolve_policies(resources(spark, *[(f"urn:x:{n}", {}) for n in names]), obligations(spark, *rules)).cache()


CASES = [
    ("ban", "read", {"region": "DE"}, False, "Global Data Ban active (Source: S1)"),
    ("geo", "read", {}, False, "Context missing 'region' attribute required for geofencing."),
    ("geo", "read", {"region": ""}, False, "Context missing 'region' attribute required for geofencing."),
    ("geo", "read", {"GEO": "cn"}, False, "Region 'CN' is explicitly blocked."),
    ("geo", "read", {"Country": "us"}, False, "Region 'US' is not in the allowed list."),
    ("geo", "read", {"region": "fr"}, True, "Access Allowed"),
    ("lower", "read", {"region": "de"}, False, "Region 'DE' is not in the allowed list."),
    ("use", "read", {}, False, "Context missing 'purpose' attribute."),
    ("use", "read", {"intent": "sales"}, False, "Purpose 'SALES' is forbidden."),
    ("use", "read", {"usage": "hr"}, False, "Purpose 'HR' is not explicitly allowed."),
    ("use", "read", {"purpose": "analytics"}, True, "Access Allowed"),
    ("ai", "MODEL_TRAINING", {}, False, "AI Training is prohibited by policy."),
    ("ai", "finetune", {}, False, "Model Fine-Tuning is prohibited by policy."),
    ("ai", "retrieval", {}, False, "RAG/Retrieval usage is prohibited by policy."),
    ("ai", "read", {}, True, "Access Allowed"),
    ("old", "read", {"created_at": "2023-12-01"}, False, "Data expired. Age 62d > Limit 30d."),
    ("old", "read", {"created_at": "2024-01-30T00:00:00Z"}, True, "Access Allowed"),
    ("old", "read", {"created_at": "soon"}, True, "Access Allowed"),
    ("old", "read", {}, True, "Access Allowed"),
    ("mask", "read", {"mode": " Raw "}, False, "Access Denied: Policy requires 'ANONYMIZATION', but 'raw' output was requested."),
    ("mask", "read", {"mode": "masked"}, True, "Access Allowed"),
    ("open", "train", {}, True, "Access Allowed"),
    ("nowhere", "read", {}, False, "No policy found for resource."),
]


def requests_of(spark):
    rows = [(i, "p", f"urn:x:{n}", action, "me", ctx) for i, (n, action, ctx, *_) in enumerate(CASES)]
    return spark.createDataFrame(rows, REQUESTS)


@pytest.mark.parametrize("dedupe", [False, True])
def test_truth_table(spark, policies, dedupe):
    found = {r.request_id: r for r in evaluate_requests(requests_of(spark), policies, NOW, "sdk", dedupe=dedupe).collect()}
    assert len(found) == len(CASES)
    for i, (*_, allowed, reason) in enumerate(CASES):
        assert (found[i].allowed, found[i].reason) == (allowed, reason), CASES[i]


def test_profiles_differ_as_documented(spark, policies):
    requests = requests_of(spark)
    by = lambda profile: {r.request_id: r for r in evaluate_requests(requests, policies, NOW, profile).collect()}
    sdk, server, every = by("sdk"), by("server"), by("all")
    nowhere, raw = len(CASES) - 1, 19
    assert server[nowhere].allowed and every[nowhere].allowed and not sdk[nowhere].allowed
    assert server[raw].allowed and not sdk[raw].allowed
    # A date without a zone is no date for the profile that lists all violations.
    assert every[15].allowed and not sdk[15].allowed
    assert explain_decisions(requests, policies, NOW).filter("request_id = 4").first().blocking_domain == "geofencing"


def test_poisoned_lineage_denies_training_only(spark, policies):
    lineage = spark.createDataFrame(
        [("p", "urn:x:open", 3, 2, ["urn:x:bad"])],
        "project_id string, urn string, inherited_risk int, inherited_sensitivity int, poison_sources array<string>",
    )
    requests = spark.createDataFrame([(1, "p", "urn:x:open", "Train", "me", {}), (2, "p", "urn:x:open", "read", "me", {})], REQUESTS)
    found = {r.request_id: r for r in evaluate_requests(requests, policies, NOW, "server", lineage).collect()}
    assert found[1].reason == "Blocked by upstream constraint propagation. Sources: ['urn:x:bad']"
    assert found[2].allowed


def test_contexts_are_read_once_and_not_shuffled(spark, policies):
    requests = requests_of(spark)
    for found in (evaluate_requests(requests, policies, NOW, "all"), explain_decisions(requests, policies, NOW)):
        plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        join = next(i for i, line in enumerate(plan) if "Join LeftOuter" in line)
        # Above the join no context is left; below it the keys are folded by one lambda.
        assert not any("context#" in line for line in plan[: join + 1])
        assert sum(line.count("lower(lambda") for line in plan) == 1


def test_keys_of_a_context_exact_before_folded_and_last_before_first(spark, policies):
    contexts = [
        {"REGION": "fr", "region": "cn"}, {"region": "cn", "REGION": "fr"}, {"Region": "cn", "REGION": "fr"}, {"GEO": "cn", "Region": "fr"},
        {"region": None, "geo": "fr"}, None,
    ]
    rows = [(i, "p", "urn:x:geo", "read", "me", ctx) for i, ctx in enumerate(contexts)]
    found = evaluate_requests(spark.createDataFrame(rows, REQUESTS), policies, NOW, "sdk").orderBy("request_id").collect()
    blocked, missing = "Region 'CN' is explicitly blocked.", "Context missing 'region' attribute required for geofencing."
    assert [r.reason for r in found] == [blocked, blocked, "Access Allowed", "Access Allowed", missing, missing]
