"""Access decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark import fixed_values as fixed
from govspark.operators.decide import decisions_to_audit, evaluate_requests, explain_decisions, transfer_violations
from govspark.operators.lineage import analyze_lineage
from govspark.sources.audit import canonicalize_audit
from workload.q_policies import ALL_DOMAINS, METHOD_NAME, policies
from workload.registry import query
from workload.tables import Tables, as_of
from workload.views import AS_OF, project_of, urn_of

POLICY = f"""
pol AS (
  SELECT r.project_id, r.urn AS resource_urn, t.duration_s, t.winner AS t_winner, g.allowed AS g_allow, g.denied AS g_deny, g.is_global_ban, g.source AS g_source,
    g.winner AS g_winner, u.allowed AS u_allow, u.denied AS u_deny, u.winner AS u_winner, a.training, a.tuning, a.rag, a.winner AS a_winner, p.method, {METHOD_NAME} AS method_name
  FROM v_resources r LEFT JOIN retention t USING (project_id, urn) LEFT JOIN geofencing g USING (project_id, urn)
  LEFT JOIN purpose u USING (project_id, urn) LEFT JOIN ai a USING (project_id, urn) LEFT JOIN privacy p USING (project_id, urn)),
asked AS (
  SELECT q.*, p.* EXCLUDE (project_id, resource_urn), p.resource_urn IS NOT NULL AS known, upper(region) AS reg, upper(purpose) AS pur, lower(action) AS act,
    try_cast(rtrim(date_text, 'Z') AS TIMESTAMP) AS created
  FROM v_requests q LEFT JOIN pol p ON p.project_id = q.project_id AND p.resource_urn = q.resource_urn)"""


def _in(value: str, csv: str) -> str:
    return f"list_contains(string_split({csv}, ','), {value})"


def _rules(profile: str) -> dict[str, list[tuple[str, str]]]:
    """Condition and message of every check of a profile."""
    terse, every = profile == "server", profile == "all"
    age = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created)) / 1000000.0"
    dated = {"sdk": "TRUE", "server": "TRUE", "all": "right(date_text, 1) = 'Z'"}[profile]
    days = "CAST(round({0} / 86400) AS BIGINT)" if every else "CAST(floor({0} / 86400) AS BIGINT)"
    fmt = "lower(format)" if every else "trim(lower(format))"
    by = "prohibited." if terse else "is prohibited by policy."
    return {
        "geo": [
            ("is_global_ban", "'Global Data Ban Active'" if terse else "'Global Data Ban active (Source: ' || g_source || ')'"),
            ("NOT is_global_ban AND reg IS NULL AND (g_allow <> '' OR g_deny <> '')",
             "'Missing ''region'' in context required for Geofencing.'" if terse else "'Context missing ''region'' attribute required for geofencing.'"),
            (f"reg IS NOT NULL AND {_in('reg', 'g_deny')}", "'Region ''' || reg || ''' is explicitly blocked.'"),
            (f"reg IS NOT NULL AND g_allow <> '' AND NOT {_in('reg', 'g_allow')}",
             "'Region ''' || reg || ''' is not in " + ("allowed list.'" if terse else "the allowed list.'")),
        ],
        "purpose": [
            ("pur IS NULL AND (u_allow <> '' OR u_deny <> '')", "'Missing ''purpose'' in context.'" if terse else "'Context missing ''purpose'' attribute.'"),
            (f"pur IS NOT NULL AND {_in('pur', 'u_deny')}", "'Purpose ''' || pur || ''' is forbidden.'"),
            (f"pur IS NOT NULL AND u_allow <> '' AND NOT {_in('pur', 'u_allow')}", "'Purpose ''' || pur || ''' is not explicitly allowed.'"),
        ],
        "ai": [
            ("act LIKE '%train%' AND NOT training", f"'AI Training {by}'"),
            ("act LIKE '%fine%' AND act LIKE '%tune%' AND NOT tuning", f"'{'Fine-tuning' if terse else 'Model Fine-Tuning'} {by}'"),
            ("(act LIKE '%rag%' OR act LIKE '%retrieval%') AND NOT rag", f"'{'RAG' if terse else 'RAG/Retrieval'} usage {by}'"),
        ],
        "retention": [
            (f"{dated} AND {age} > duration_s",
             f"'Data expired. Age ' || {days.format(age)} || 'd > Limit ' || {days.format('duration_s')} || 'd.'"),
        ],
        "privacy": [] if terse else [
            (f"method <> 0 AND {fmt} IN ('raw', 'cleartext', 'unmasked', 'decrypt')",
             f"'Access Denied: Policy requires ''' || method_name || ''', but ''' || {fmt} || ''' output was requested.'"),
        ],
    }


def _first(profile: str, before: list[tuple[str, str]] = ()) -> str:
    arms = [*before, *[rule for rules in _rules(profile).values() for rule in rules]]
    return "CASE " + " ".join(f"WHEN {c} THEN {m}" for c, m in arms) + " END"


def _decision_sql(profile: str, before: list[tuple[str, str]] = (), extra: str = "", source: str = "asked") -> str:
    return f"""WITH {ALL_DOMAINS}, {POLICY}{extra}, decided AS (SELECT *, {_first(profile, before)} AS denied FROM {source})
    SELECT request_id, project_id, resource_urn, denied IS NULL AS allowed, coalesce(denied, 'Access Allowed') AS reason FROM decided"""


SDK_SQL = _decision_sql("sdk", [("NOT known", "'No policy found for resource.'")])


@query("a1_decisions_sdk", SDK_SQL)
def a1_decisions_sdk(t: Tables) -> DataFrame:
    return evaluate_requests(t.requests(), policies(t), as_of(), "sdk")


@query("a1_decisions_server", _decision_sql("server"))
def a1_decisions_server(t: Tables) -> DataFrame:
    return evaluate_requests(t.requests(), policies(t), as_of(), "server")


_EVERY = [rule for rules in _rules("all").values() for rule in rules]
_ALL_SQL = f"""WITH {ALL_DOMAINS}, {POLICY}, broken AS (
  {' UNION ALL '.join(f'SELECT request_id, {m} AS msg FROM asked WHERE {c}' for c, m in _EVERY)})
SELECT q.request_id, q.project_id, q.resource_urn, count(msg) = 0 AS allowed, coalesce(string_agg(DISTINCT msg, ' / ' ORDER BY msg), '') AS violations
FROM v_requests q LEFT JOIN broken b USING (request_id) GROUP BY ALL"""


@query("a8_all_violations", _ALL_SQL)
def a8_all_violations(t: Tables) -> DataFrame:
    decided = evaluate_requests(t.requests(), policies(t), as_of(), "all")
    return decided.select("request_id", "project_id", "resource_urn", "allowed", F.array_join("violations", " / ").alias("violations"))


# Lineage among the resources themselves: resource k feeds 10k to 10k + 9, across the projects of each.
_EDGE = f"""
  SELECT {project_of('p_partkey')} AS project_id, {urn_of('p_partkey // 10')} AS source_urn, {urn_of('p_partkey')} AS target_urn FROM part WHERE p_partkey > 0"""


def resource_edges(t: Tables) -> DataFrame:
    t.base("part")
    return t.spark.sql(_EDGE.replace("p_partkey // 10", "CAST(floor(p_partkey / 10) AS BIGINT)"))


_POISON = f""",
graph_edges AS ({_EDGE}),
up AS (SELECT project_id, target_urn AS urn, source_urn AS ancestor FROM graph_edges
  UNION SELECT e.project_id, u.urn, e.source_urn FROM up u JOIN graph_edges e ON e.project_id = u.project_id AND e.target_urn = u.ancestor),
poison AS (SELECT u.project_id, u.urn AS resource_urn, string_agg('''' || u.ancestor || '''', ', ' ORDER BY u.ancestor) AS sources
  FROM up u JOIN v_resources r ON r.project_id = u.project_id AND r.urn = u.ancestor WHERE NOT r.ai_training_allowed AND u.ancestor <> u.urn GROUP BY ALL),
traced AS (SELECT a.*, p.sources FROM asked a LEFT JOIN poison p USING (project_id, resource_urn))"""
_GATE = [("sources IS NOT NULL AND act LIKE '%train%'", "'Blocked by upstream constraint propagation. Sources: [' || sources || ']'")]


@query("a9_lineage_decisions", _decision_sql("server", _GATE, _POISON, "traced"))
def a9_lineage_decisions(t: Tables) -> DataFrame:
    requests, resources = t.requests(), t.resources()
    asked = requests.select("project_id", F.col("resource_urn").alias("urn"))
    lineage = analyze_lineage(resource_edges(t), resources, asked)
    return evaluate_requests(requests, policies(t), as_of(), "server", lineage)


_TRANSFER = """
  SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'DE' WHEN 1 THEN 'FR' WHEN 2 THEN 'US' WHEN 3 THEN 'IE' WHEN 4 THEN 'GB' ELSE 'PL' END AS dataset_region,
    CASE user_id % 7 WHEN 0 THEN 'US' WHEN 1 THEN 'JP' WHEN 2 THEN 'CN' WHEN 3 THEN 'DE' END AS destination_region,
    CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'US' WHEN 2 THEN 'IN' WHEN 3 THEN 'CH' END AS actor_location,
    CASE WHEN event_id % 4 = 0 THEN 'ISO27001,EU_US_DPF' WHEN event_id % 4 = 1 THEN 'SOC2' END AS actor_certifications
  FROM events"""
_LIST = lambda values: ", ".join(f"'{v}'" for v in values)


@query("a10_transfers", f"""WITH t AS ({_TRANSFER}), x AS (SELECT *, coalesce(destination_region, nullif(actor_location, ''), 'UNKNOWN') AS target_region FROM t)
SELECT event_id, dataset_region, target_region,
  'GDPR Art. 44 Violation: Restricted transfer of EU data (' || dataset_region || ') to non-adequate jurisdiction (' || target_region || ').' AS violation
FROM x WHERE dataset_region IN ({_LIST(fixed.EU_REGIONS)}) AND target_region NOT IN ({_LIST(fixed.EU_REGIONS + fixed.ADEQUATE_COUNTRIES)})
  AND NOT (target_region = 'US' AND coalesce(contains(actor_certifications, 'EU_US_DPF'), FALSE))""")
def a10_transfers(t: Tables) -> DataFrame:
    t.base("events")
    return transfer_violations(t.spark.sql(_TRANSFER)).select("event_id", "dataset_region", "target_region", "violation")


_AUDIT_SQL = SDK_SQL.replace(
    "SELECT request_id, project_id, resource_urn, denied IS NULL AS allowed, coalesce(denied, 'Access Allowed') AS reason FROM decided",
    """SELECT CAST(request_id AS VARCHAR) AS id, project_id, resource_urn, action, actor_id, CASE WHEN denied IS NULL THEN 1 ELSE 2 END AS decision,
       coalesce(denied, 'Access Allowed') AS reason_summary FROM decided""",
)


@query("a11_decision_audit", _AUDIT_SQL)
def a11_decision_audit(t: Tables) -> DataFrame:
    requests = t.requests()
    events = decisions_to_audit(evaluate_requests(requests, policies(t), as_of(), "sdk"), requests, as_of())
    return canonicalize_audit(events).select(
        "id", "project_id", "resource_urn", "action", F.col("actor.id").alias("actor_id"), "decision", "evaluation_trace.reason_summary"
    )


@query("a12_distinct_requests", SDK_SQL)
def a12_distinct_requests(t: Tables) -> DataFrame:
    return evaluate_requests(t.requests(), policies(t), as_of(), "sdk", dedupe=True)


_BLOCKING = [("ai_rules", "ai", "a_winner"), ("geofencing", "geo", "g_winner"), ("purpose", "purpose", "u_winner"), ("retention", "retention", "t_winner")]
_ANY = {name: " OR ".join(f"coalesce({c}, FALSE)" for c, _ in rules) for name, rules in _rules("sdk").items()}
_DOMAIN_CASE = "CASE " + " ".join(f"WHEN {_ANY[n]} THEN '{d}'" for d, n, _ in _BLOCKING) + " END"
_WINNER_CASE = "CASE " + " ".join(f"WHEN {_ANY[n]} THEN {w}" for _, n, w in _BLOCKING) + " END"


@query("c7_why_denied", f"""WITH {ALL_DOMAINS}, {POLICY}
SELECT request_id, project_id, resource_urn, {_DOMAIN_CASE} AS blocking_domain, {_WINNER_CASE} AS winning_obligation_id FROM asked""")
def c7_why_denied(t: Tables) -> DataFrame:
    return explain_decisions(t.requests(), policies(t), as_of())
