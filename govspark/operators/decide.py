"""Access requests evaluated in bulk against effective policies."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark import fixed_values as fixed
from govspark.functions import age_seconds, is_eu_region, parse_instant
from govspark.operators.joins import null_safe_join

# Differences between the three evaluators.
PROFILES = {
    "sdk": {
        "missing_policy_allows": False,
        "purpose_keys": ["purpose", "intent", "usage"],
        "date_keys": ["created_at", "creation_date", "date"],
        "privacy": True,
    },
    "server": {
        "missing_policy_allows": True,
        "purpose_keys": ["purpose", "usage", "intent"],
        "date_keys": ["created_at", "date"],
        "privacy": False,
    },
    "all": {
        "missing_policy_allows": True,
        "purpose_keys": ["purpose", "intent", "usage"],
        "date_keys": ["created_at", "creation_date", "date"],
        "privacy": True,
    },
}
_NO_POLICY = "No policy found for resource."


# The context's keys and values as they are, then once more from the last, the keys in small letters.
_FOLDED = {
    "_names": "concat(map_keys(context), reverse(transform(map_keys(context), k -> lower(k))))",
    "_values": "concat(map_values(context), reverse(map_values(context)))",
}


def ctx(keys: list[str]) -> str:
    """SQL for the value of the first key present, each tried exactly and then ignoring case; the keys are in small letters.

    Reads what ``_FOLDED`` adds. Short code: Java compiles no method as long as a test for each key and case would make it.
    """
    at = ", ".join(f"nullif(array_position(_names, '{key}'), 0L)" for key in keys)
    return f"try_element_at(_values, cast(coalesce({at}) AS int))"


def _asked(profile: str) -> dict[str, str]:
    """What a request says, read from its context once."""
    spec = PROFILES[profile]
    every = profile == "all"
    blank = (lambda value: value) if every else (lambda value: f"nullif({value}, '')")
    wanted = f"lower({ctx(fixed.FORMAT_KEYS)})"
    return {
        "_region": blank(f"upper({ctx(fixed.REGION_KEYS)})"),
        "_purpose": blank(f"upper({ctx(spec['purpose_keys'])})"),
        "_format": wanted if every else f"trim({wanted})",
        "_date": ctx(spec["date_keys"]),
        "_verb": "lower(action)",
    }


def _checks(profile: str) -> dict[str, list[tuple[str, str]]]:
    """(deny condition, message) pairs in SQL, in evaluation order."""
    terse, every = profile == "server", profile == "all"
    ban = "'Global Data Ban Active'" if terse else "concat('Global Data Ban active (Source: ', geofencing.reason.winning_source_id, ')')"
    no_region = (
        "'Missing ''region'' in context required for Geofencing.'"
        if terse
        else "'Context missing ''region'' attribute required for geofencing.'"
    )
    outside = "allowed list." if terse else "the allowed list."
    no_purpose = "'Missing ''purpose'' in context.'" if terse else "'Context missing ''purpose'' attribute.'"
    by_policy = "prohibited." if terse else "is prohibited by policy."
    days = "cast({}({} / 86400) AS bigint)".format("round" if every else "floor", "{}")
    method = "CASE privacy.method " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in fixed.PRIVACY_METHOD.items()) + " END"
    raw = ", ".join(f"'{f}'" for f in fixed.RAW_FORMATS)
    checks = {
        "geo": [
            ("geofencing.is_global_ban", ban),
            (
                "NOT geofencing.is_global_ban AND _region IS NULL "
                "AND (size(geofencing.allowed_regions) > 0 OR size(geofencing.blocked_regions) > 0)",
                no_region,
            ),
            ("array_contains(geofencing.blocked_regions, _region)", "concat('Region ''', _region, ''' is explicitly blocked.')"),
            (
                "size(geofencing.allowed_regions) > 0 AND NOT array_contains(geofencing.allowed_regions, _region)",
                f"concat('Region ''', _region, ''' is not in {outside}')",
            ),
        ],
        "purpose": [
            ("_purpose IS NULL AND (size(purpose.allowed_purposes) > 0 OR size(purpose.denied_purposes) > 0)", no_purpose),
            ("array_contains(purpose.denied_purposes, _purpose)", "concat('Purpose ''', _purpose, ''' is forbidden.')"),
            (
                "size(purpose.allowed_purposes) > 0 AND NOT array_contains(purpose.allowed_purposes, _purpose)",
                "concat('Purpose ''', _purpose, ''' is not explicitly allowed.')",
            ),
        ],
        "ai": [
            ("contains(_verb, 'train') AND NOT ai_rules.training_allowed", f"'AI Training {by_policy}'"),
            (
                "contains(_verb, 'fine') AND contains(_verb, 'tune') AND NOT ai_rules.fine_tuning_allowed",
                f"'{'Fine-tuning' if terse else 'Model Fine-Tuning'} {by_policy}'",
            ),
            (
                "(contains(_verb, 'rag') OR contains(_verb, 'retrieval')) AND NOT ai_rules.rag_allowed",
                f"'{'RAG' if terse else 'RAG/Retrieval'} usage {by_policy}'",
            ),
        ],
        "retention": [
            (
                "NOT retention.is_indefinite AND _age > retention.duration_s",
                f"concat('Data expired. Age ', {days.format('_age')}, 'd > Limit ', {days.format('retention.duration_s')}, 'd.')",
            ),
        ],
    }
    if PROFILES[profile]["privacy"]:
        checks["privacy"] = [
            (
                f"privacy.method <> 0 AND _format IN ({raw})",
                f"concat('Access Denied: Policy requires ''', {method}, ''', but ''', _format, ''' output was requested.')",
            )
        ]
    return checks


def _case(pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN {message}" for condition, message in pairs) + " END"


_DOMAINS = ["retention", "geofencing", "ai_rules", "purpose", "privacy"]


def _with_policy(requests: DataFrame, policies: DataFrame) -> DataFrame:
    keys = ["project_id", "resource_urn"]
    return null_safe_join(requests, policies.select(*keys, *_DOMAINS, F.lit(True).alias("has_policy")), keys, "left")


def _with_facts(requests: DataFrame, as_of: datetime, profile: str) -> DataFrame:
    """Add what the checks look at: the context values and the age of the data."""
    folded = requests.selectExpr("*", *[f"{sql} AS {name}" for name, sql in _FOLDED.items()])
    asked = folded.selectExpr("*", *[f"{sql} AS {name}" for name, sql in _asked(profile).items()])
    created = parse_instant(F.col("_date"), require_zone=profile == "all")
    return asked.withColumn("_age", age_seconds(created, F.lit(as_of).cast("timestamp"))).drop(*_FOLDED)


def evaluate_requests(
    requests: DataFrame,
    policies: DataFrame,
    as_of: datetime,
    profile: str = "sdk",
    lineage: DataFrame | None = None,
    dedupe: bool = False,
) -> DataFrame:
    """(request_id, project_id, resource_urn, allowed, reason[, violations]) for every request.

    ``sdk`` and ``server`` stop at the first failing check in the order geo, purpose, AI, retention,
    privacy; ``all`` also lists every violation. ``lineage`` is the output of ``analyze_lineage``:
    training on a resource with poisoned ancestors is denied before the policy is looked at, and the
    inherited values are put into the context. ``dedupe`` evaluates equal requests once.
    """
    if dedupe:
        # One key for all that a decision depends on, nulls included.
        identity = ["project_id", "resource_urn", "action", "actor_id"]
        content = F.struct(*identity, F.array_sort(F.map_entries("context")).alias("context"))
        keyed = requests.withColumn("_key", F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256))
        once = keyed.groupBy(F.col("_key").alias("request_id")).agg(*[F.first(c).alias(c) for c in (*identity, "context")])
        decided = evaluate_requests(once, policies, as_of, profile, lineage)
        outcome = [c for c in decided.columns if c not in ("request_id", "project_id", "resource_urn")]
        matched = keyed.select("request_id", "project_id", "resource_urn", "_key").join(
            decided.select(F.col("request_id").alias("_key"), *outcome), "_key"
        )
        return matched.select("request_id", "project_id", "resource_urn", *outcome)

    gate: list[tuple[str, str]] = []
    if lineage is None:
        # Read before the join, so that no contexts are shuffled for it.
        facts = _with_policy(_with_facts(requests, as_of, profile), policies)
    else:
        upstream = lineage.select(
            "project_id", F.col("urn").alias("resource_urn"), "inherited_risk", "inherited_sensitivity", "poison_sources"
        )
        joined = null_safe_join(_with_policy(requests, policies), upstream, ["project_id", "resource_urn"], "left").withColumn(
            "context",
            F.expr(
                "map_concat(map_filter(context, (k, v) -> k NOT IN ('inherited_risk', 'inherited_sensitivity')), "
                "map('inherited_risk', cast(coalesce(inherited_risk, 0) AS string), "
                "'inherited_sensitivity', cast(coalesce(inherited_sensitivity, 0) AS string)))"
            ),
        )
        listed = "array_join(transform(poison_sources, u -> concat('''', u, '''')), ', ')"
        gate = [
            (
                "size(poison_sources) > 0 AND contains(_verb, 'train')",
                f"concat('Blocked by upstream constraint propagation. Sources: [', {listed}, ']')",
            )
        ]
        facts = _with_facts(joined, as_of, profile)
    missing = [] if PROFILES[profile]["missing_policy_allows"] else [("has_policy IS NULL", f"'{_NO_POLICY}'")]
    checks = [*gate, *missing, *[check for pairs in _checks(profile).values() for check in pairs]]
    columns = ["request_id", "project_id", "resource_urn"]
    if profile == "all":
        messages = ", ".join(_case([check]) for check in checks)
        found = facts.selectExpr(*columns, f"array_sort(array_distinct(array_compact(array({messages})))) AS violations")
        return found.selectExpr(
            *columns, "size(violations) = 0 AS allowed", "coalesce(get(violations, 0), 'Access Allowed') AS reason", "violations"
        )
    decided = facts.selectExpr(*columns, f"{_case(checks)} AS denied")
    return decided.selectExpr(*columns, "denied IS NULL AS allowed", "coalesce(denied, 'Access Allowed') AS reason")


def explain_decisions(requests: DataFrame, policies: DataFrame, as_of: datetime, profile: str = "sdk") -> DataFrame:
    """Blocking domain per request, looked for in the order AI, geo, purpose, retention, and its winner."""
    checks = _checks(profile)
    order = [("ai_rules", "ai"), ("geofencing", "geo"), ("purpose", "purpose"), ("retention", "retention")]
    hits = [(" OR ".join(f"coalesce({condition}, false)" for condition, _ in checks[name]), domain) for domain, name in order]
    blocking = _case([(hit, f"'{domain}'") for hit, domain in hits])
    winner = _case([(hit, f"{domain}.reason.winning_obligation_id") for hit, domain in hits])
    return _with_policy(_with_facts(requests, as_of, profile), policies).selectExpr(
        "request_id", "project_id", "resource_urn", f"{blocking} AS blocking_domain", f"{winner} AS winning_obligation_id"
    )


def transfer_violations(transfers: DataFrame) -> DataFrame:
    """Restricted transfers of EU data.

    Input: dataset_region, destination_region, actor_location, actor_certifications (nullable). The
    target is the destination, else where the actor is, else UNKNOWN, which is restricted.
    """
    target = F.coalesce("destination_region", F.nullif(F.col("actor_location"), F.lit("")), F.lit("UNKNOWN"))
    certified = (F.col("target_region") == "US") & F.coalesce(
        F.col("actor_certifications").contains(fixed.DPF_CERTIFICATE), F.lit(False)
    )
    message = F.concat(
        F.lit("GDPR Art. 44 Violation: Restricted transfer of EU data ("), F.col("dataset_region"),
        F.lit(") to non-adequate jurisdiction ("), F.col("target_region"), F.lit(")."),
    )
    return (
        transfers.filter(is_eu_region(F.col("dataset_region")))
        .withColumn("target_region", target)
        .filter(~is_eu_region(F.col("target_region")) & ~F.col("target_region").isin(*fixed.ADEQUATE_COUNTRIES) & ~certified)
        .withColumn("violation", message)
    )


def decisions_to_audit(decisions: DataFrame, requests: DataFrame, as_of: datetime) -> DataFrame:
    """One audit event per decision, in the shape that ``canonicalize_audit`` reads."""
    trace = F.to_json(F.struct(F.col("reason").alias("decision_reason"), F.lit(False).alias("cache_hit")))
    context = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("context"))))
    asked = requests.select("request_id", "project_id", "action", "actor_id", "context")
    return decisions.join(asked, ["project_id", "request_id"]).select(
        F.col("request_id").cast("string").alias("id"),
        "project_id",
        F.lit(as_of).cast("timestamp").alias("timestamp"),
        "actor_id",
        "resource_urn",
        "action",
        F.when(F.col("allowed"), F.lit("ALLOW")).otherwise(F.lit("DENY")).alias("decision"),
        trace.alias("reason_trace"),
        context.alias("request_context"),
    )
