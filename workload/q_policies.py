"""Matching and conflict resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark import fixed_values as fixed
from govspark.operators.match import match_obligations, resolve_groups
from govspark.operators.resolve import explain_policies, resolve_policies
from workload.registry import query
from workload.tables import Tables

# --- shared SQL --------------------------------------------------------------

# All pairs tested directly, against the routed joins of the operator.
MATCHES = """
matches AS (
  SELECT r.project_id, r.urn, o.ord FROM v_resources r JOIN v_obligations o
    ON o.is_active AND (o.project_id IS NULL OR o.project_id = r.project_id)
   AND (o.include <> '' OR o.req_brand IS NOT NULL OR o.req_env IS NOT NULL OR o.req_vendor IS NOT NULL)
   AND NOT (o.exclude <> '' AND r.urn GLOB o.exclude)
   AND (o.req_brand IS NULL OR coalesce(r.brand, '') = o.req_brand)
   AND (o.req_env IS NULL OR coalesce(r.env, '') = o.req_env)
   AND (o.req_vendor IS NULL OR coalesce(r.vendor, '') = o.req_vendor)
   AND (o.include = '' OR r.urn GLOB o.include OR (o.include2 <> '' AND r.urn GLOB o.include2))
),
hits AS (SELECT m.project_id, m.urn, o.* EXCLUDE (project_id) FROM matches m JOIN v_obligations o USING (ord))"""


def names_sql(table: dict[str, int], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in table.items()) + " END"


METHOD_NAME = names_sql(fixed.PRIVACY_METHOD, "method")

RETENTION = """
retention AS (
  SELECT project_id, urn, duration_s, trigger_ AS trigger_, id AS winner, source_id AS source, n,
    'Applied strictest retention limit from ''' || title || '''. Calculated shortest duration among ' || n || ' competing rules.' AS description
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id, urn ORDER BY duration_s, ord) AS rn,
          count(*) OVER (PARTITION BY project_id, urn) AS n FROM hits WHERE d = 0) WHERE rn = 1)"""


def _set_domain(name: str, d: int, allow: str, deny: str, extra_wins: str) -> str:
    """Set algebra by counting: a value survives when every rule with an allow list names it."""
    return f"""
{name}_rules AS (SELECT project_id, urn, ord, id, source_id, {allow} AS allow, {deny} AS deny FROM hits WHERE d = {d}),
{name}_allow AS (SELECT DISTINCT project_id, urn, ord, unnest(string_split(allow, ',')) AS v FROM {name}_rules WHERE allow <> ''),
{name}_deny AS (SELECT project_id, urn, ord, unnest(string_split(deny, ',')) AS v FROM {name}_rules WHERE deny <> ''),
{name}_n AS (SELECT project_id, urn, count(DISTINCT ord) AS n, min(ord) AS first_ord FROM {name}_allow GROUP BY ALL),
{name}_kept AS (SELECT a.project_id, a.urn, a.v FROM {name}_allow a JOIN {name}_n USING (project_id, urn) GROUP BY a.project_id, a.urn, a.v, n HAVING count(*) = n),
{name}_final AS (SELECT * FROM {name}_kept EXCEPT SELECT project_id, urn, v FROM {name}_deny),
{name}_death AS (
  SELECT f.project_id, f.urn, f.v, min(r.ord) AS died FROM {name}_allow f JOIN {name}_n n ON f.project_id = n.project_id AND f.urn = n.urn AND f.ord = n.first_ord
  LEFT JOIN {name}_rules r ON r.project_id = f.project_id AND r.urn = f.urn AND r.allow <> '' AND r.ord > f.ord
   AND NOT list_contains(string_split(r.allow, ','), f.v) GROUP BY ALL),
{name}_end AS (SELECT project_id, urn, max(died) AS last_shrink, CASE WHEN count(*) = count(died) THEN max(died) END AS emptied FROM {name}_death GROUP BY ALL),
{name}_win AS (
  SELECT r.project_id, r.urn, coalesce(greatest(max(e.last_shrink), max(n.first_ord){extra_wins}), min(r.ord)) AS win_ord, count(*) AS n_rules
  FROM {name}_rules r LEFT JOIN {name}_n n USING (project_id, urn) LEFT JOIN {name}_end e USING (project_id, urn) GROUP BY r.project_id, r.urn),
{name}_lists AS (
  SELECT w.*, r.id AS winner, r.source_id AS source,
    coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM {name}_final f WHERE f.project_id = w.project_id AND f.urn = w.urn), '') AS allowed,
    coalesce((SELECT string_agg(DISTINCT v, ',' ORDER BY v) FROM {name}_deny x WHERE x.project_id = w.project_id AND x.urn = w.urn), '') AS denied,
    EXISTS (SELECT 1 FROM {name}_n n WHERE n.project_id = w.project_id AND n.urn = w.urn) AS has_list
  FROM {name}_win w JOIN {name}_rules r ON r.project_id = w.project_id AND r.urn = w.urn AND r.ord = w.win_ord)"""


_COUNT = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, ',')) END"
GEO = _set_domain("geo", 1, "allowed_regions", "denied_regions", "") + f""",
geofencing AS (SELECT project_id, urn, allowed, denied, has_list AND allowed = '' AS is_global_ban, winner, source,
  'Calculated intersection of ' || n_rules || ' geofencing rules. ' || ({_COUNT.format('denied')}) || ' regions explicitly denied.'
  || CASE WHEN has_list AND allowed = '' THEN ' RESULT: GLOBAL BAN (Intersection is empty).' ELSE '' END AS description FROM geo_lists)"""
_DENY_WINS = ", max(CASE WHEN r.deny <> '' AND (n.first_ord IS NULL OR r.ord <= n.first_ord OR r.ord > e.emptied) THEN r.ord END)"
PURPOSE = _set_domain("use", 2, "allowed_purposes", "denied_purposes", _DENY_WINS) + f""",
purpose AS (SELECT project_id, urn, allowed, denied, winner, source,
  'Applied purpose intersection from ''' || source || '''. Result: ' || ({_COUNT.format('allowed')}) || ' allowed, ' || ({_COUNT.format('denied')}) || ' denied.' AS description
  FROM use_lists)"""
AI = """
ai_rules AS (SELECT *, row_number() OVER (PARTITION BY project_id, urn ORDER BY ord) AS pos_ FROM hits WHERE d = 4),
ai_sum AS (
  SELECT project_id, urn, bool_and(training) AS training, bool_and(tuning) AS tuning, bool_and(rag) AS rag,
    coalesce(string_agg(credit, '; ' ORDER BY ord) FILTER (WHERE credit <> ''), '') AS credit,
    coalesce(min(ord) FILTER (WHERE NOT training), min(ord) FILTER (WHERE credit <> '' AND pos_ > 1), min(ord)) AS win_ord
  FROM ai_rules GROUP BY ALL),
ai AS (
  SELECT s.*, r.id AS winner, r.source_id AS source, s.credit <> '' AS attribution,
    'AI Constraint: ' || CASE WHEN s.training AND s.tuning AND s.credit = '' THEN 'All AI actions permitted' ELSE
      concat_ws(', ', CASE WHEN NOT s.training THEN 'Training Blocked' END, CASE WHEN NOT s.tuning THEN 'Fine-Tuning Blocked' END,
        CASE WHEN s.credit <> '' THEN 'Attribution Required' END) END || '. Defined by source ''' || r.source_id || '''.' AS description
  FROM ai_sum s JOIN ai_rules r ON r.project_id = s.project_id AND r.urn = s.urn AND r.ord = s.win_ord)"""
PRIVACY = f"""
top_method AS (SELECT project_id, urn, max(method) AS best FROM hits WHERE d = 3 GROUP BY ALL),
peers AS (SELECT h.*, row_number() OVER (PARTITION BY h.project_id, h.urn ORDER BY ord) AS pos_, count(*) OVER (PARTITION BY h.project_id, h.urn) AS n
  FROM hits h JOIN top_method t USING (project_id, urn) WHERE h.d = 3 AND h.method = t.best),
privacy AS (
  SELECT project_id, urn, method, n,
    CASE WHEN n = 1 THEN max(p_algorithm) ELSE arg_min(p_algorithm, ord) END AS p_algorithm,
    CASE WHEN n = 1 THEN CAST(max(CAST(p_epsilon AS DOUBLE)) AS VARCHAR) WHEN method = 3 THEN CAST(min(coalesce(CAST(p_epsilon AS DOUBLE), 10.0)) AS VARCHAR) END AS p_epsilon,
    CASE WHEN count(p_delta) > 0 THEN CAST(min(coalesce(CAST(p_delta AS DOUBLE), 1.0)) AS VARCHAR) END AS p_delta,
    CASE WHEN count(p_k) > 0 THEN CAST(max(coalesce(CAST(p_k AS BIGINT), 0)) AS VARCHAR) END AS p_k,
    n > 1 AND method NOT IN (2, 3) AND count(DISTINCT p_algorithm) > 1 AS conflict,
    arg_min(id, ord) AS winner, arg_min(source_id, ord) AS source
  FROM peers GROUP BY project_id, urn, method, n),
privacy_text AS (
  SELECT *, {METHOD_NAME} AS method_name,
    concat_ws(';', 'algorithm=' || p_algorithm, 'delta=' || p_delta, 'epsilon=' || p_epsilon, 'k=' || p_k) AS parameters
  FROM privacy)"""

ALL_DOMAINS = ",".join([MATCHES, RETENTION, GEO, PURPOSE, AI, PRIVACY])

# --- Spark helpers -----------------------------------------------------------


def joined(column: str):
    return F.array_join(column, ",")


def params_text(column: str):
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def policies(t: Tables, domains: list[str] | None = None, version: str = "v_obligations") -> DataFrame:
    return resolve_policies(t.resources(), t.obligations(version), domains)


def _reason(domain: str, description: bool = True):
    columns = [
        F.col(f"{domain}.reason.winning_obligation_id").alias("winner"),
        F.col(f"{domain}.reason.winning_source_id").alias("source"),
    ]
    return [*columns, F.col(f"{domain}.reason.description").alias("description")] if description else columns


@query("j1_match", f"WITH {MATCHES} SELECT project_id, urn, ord FROM matches")
def j1_match(t: Tables) -> DataFrame:
    return match_obligations(t.resources(), t.obligations())


_GLOB_RULES = "CASE WHEN pk % 8 = 0 THEN '*:' || pk || '?' WHEN pk % 8 = 4 THEN '*[a-l]?:' || (pk % 1000) || '*' ELSE '?rn:*' || pk END"


@query("j1_match_globs", f"""SELECT r.project_id, r.urn, o.pk AS ord FROM v_resources r JOIN (SELECT pk, {_GLOB_RULES} AS pattern FROM v_resources WHERE pk % 4 = 0 OR pk % 8 = 7) o
  ON r.urn GLOB o.pattern AND NOT r.urn GLOB '*:prod:s*'""")
def j1_match_globs(t: Tables) -> DataFrame:
    """Rules whose globs, one for three resources in eight, have no prefix to be found by."""
    target = F.struct(
        F.array(F.expr(_GLOB_RULES)).alias("include_patterns"), F.array(F.lit("*:prod:s*")).alias("exclude_patterns"),
        F.lit(None).cast("map<string,string>").alias("match_tags"),
    )
    rules = t.view("v_resources").filter("pk % 4 = 0 OR pk % 8 = 7").select(F.lit(None).cast("string").alias("project_id"), F.col("pk").alias("ord"), target.alias("target"))
    return match_obligations(t.resources(), rules)


@query("c1_retention", f"WITH {MATCHES}, {RETENTION} SELECT project_id, urn, duration_s, trigger_, winner, source, description FROM retention")
def c1_retention(t: Tables) -> DataFrame:
    return policies(t, ["retention"]).filter("retention IS NOT NULL").select(
        "project_id", F.col("resource_urn").alias("urn"), "retention.duration_s", F.col("retention.trigger").alias("trigger_"), *_reason("retention")
    )


@query("c2_geofencing", f"WITH {MATCHES}, {GEO} SELECT * FROM geofencing")
def c2_geofencing(t: Tables) -> DataFrame:
    return policies(t, ["geofencing"]).filter("geofencing IS NOT NULL").select(
        "project_id", F.col("resource_urn").alias("urn"), joined("geofencing.allowed_regions").alias("allowed"),
        joined("geofencing.blocked_regions").alias("denied"), "geofencing.is_global_ban", *_reason("geofencing"),
    )


@query("c3_purpose", f"WITH {MATCHES}, {PURPOSE} SELECT * FROM purpose")
def c3_purpose(t: Tables) -> DataFrame:
    return policies(t, ["purpose"]).filter("purpose IS NOT NULL").select(
        "project_id", F.col("resource_urn").alias("urn"), joined("purpose.allowed_purposes").alias("allowed"),
        joined("purpose.denied_purposes").alias("denied"), *_reason("purpose"),
    )


@query("c4_ai", f"WITH {MATCHES}, {AI} SELECT project_id, urn, training, tuning, rag, attribution, credit, winner, source, description FROM ai")
def c4_ai(t: Tables) -> DataFrame:
    return policies(t, ["ai_rules"]).filter("ai_rules IS NOT NULL").select(
        "project_id", F.col("resource_urn").alias("urn"), F.col("ai_rules.training_allowed").alias("training"),
        F.col("ai_rules.fine_tuning_allowed").alias("tuning"), F.col("ai_rules.rag_allowed").alias("rag"),
        F.col("ai_rules.attribution_required").alias("attribution"), F.col("ai_rules.attribution_text").alias("credit"), *_reason("ai_rules"),
    )


@query("c5_privacy", f"WITH {MATCHES}, {PRIVACY} SELECT project_id, urn, method, method_name, parameters, conflict, winner, source FROM privacy_text")
def c5_privacy(t: Tables) -> DataFrame:
    from govspark.functions import enum_name

    return policies(t, ["privacy"]).filter("privacy IS NOT NULL").select(
        "project_id", F.col("resource_urn").alias("urn"), "privacy.method", enum_name(F.col("privacy.method"), fixed.PRIVACY_METHOD).alias("method_name"),
        params_text("privacy.parameters").alias("parameters"), "privacy.conflict", *_reason("privacy", description=False),
    )


C6 = f"""WITH {ALL_DOMAINS},
ids AS (SELECT project_id, urn, string_agg(id, ',' ORDER BY ord) AS ids FROM hits GROUP BY ALL)
SELECT r.project_id, r.urn AS resource_urn, t.duration_s, g.allowed AS allowed_regions, g.denied AS blocked_regions, g.is_global_ban,
  u.allowed AS allowed_purposes, u.denied AS denied_purposes, a.training, a.credit, p.method, p.parameters, coalesce(i.ids, '') AS obligation_ids
FROM v_resources r LEFT JOIN retention t USING (project_id, urn) LEFT JOIN geofencing g USING (project_id, urn) LEFT JOIN purpose u USING (project_id, urn)
LEFT JOIN ai a USING (project_id, urn) LEFT JOIN privacy_text p USING (project_id, urn) LEFT JOIN ids i USING (project_id, urn)"""


def shown_policies(effective: DataFrame) -> DataFrame:
    return effective.select(
        "project_id", "resource_urn", "retention.duration_s", joined("geofencing.allowed_regions").alias("allowed_regions"),
        joined("geofencing.blocked_regions").alias("blocked_regions"), "geofencing.is_global_ban",
        joined("purpose.allowed_purposes").alias("allowed_purposes"), joined("purpose.denied_purposes").alias("denied_purposes"),
        F.col("ai_rules.training_allowed").alias("training"), F.col("ai_rules.attribution_text").alias("credit"), "privacy.method",
        params_text("privacy.parameters").alias("parameters"), joined("contributing_obligation_ids").alias("obligation_ids"),
    )


@query("c6_policies", C6)
def c6_policies(t: Tables) -> DataFrame:
    return shown_policies(policies(t))


C7 = f"""WITH {ALL_DOMAINS}
SELECT project_id, urn AS resource_urn, 'retention' AS domain, winner, source FROM retention UNION ALL
SELECT project_id, urn, 'geofencing', winner, source FROM geofencing UNION ALL SELECT project_id, urn, 'purpose', winner, source FROM purpose UNION ALL
SELECT project_id, urn, 'ai_rules', winner, source FROM ai UNION ALL SELECT project_id, urn, 'privacy', winner, source FROM privacy"""


@query("c7_explain", C7)
def c7_explain(t: Tables) -> DataFrame:
    return explain_policies(policies(t)).select(
        "project_id", "resource_urn", "domain", F.col("winning_obligation_id").alias("winner"), F.col("winning_source_id").alias("source")
    )


# --- purposes to groups ------------------------------------------------------

GROUPS = {
    "MARKETING": ["segment-building", "segment-automobile"],
    "ANALYTICS": ["desk-one", "desk-two", "desk-three"],
    "FINANCE": ["order-clerks"],
    "HR_ADMIN": ["region-stewards", "nation-stewards"],
    " debugging ": ["part-makers"],
}
DEFAULT_GROUPS = ["warehouse-owner", "supplier-office"]


def group_mapping(t: Tables) -> DataFrame:
    rows = [(purpose, group) for purpose, groups in GROUPS.items() for group in groups]
    return t.spark.createDataFrame(rows, "purpose string, `group` string")


_MAPPING = " UNION ALL ".join(f"SELECT '{p.strip().upper()}' AS purpose, '{g}' AS grp" for p, gs in GROUPS.items() for g in gs)
GROUPS_SQL = f"""
mapping AS ({_MAPPING}), defaults AS (SELECT unnest({DEFAULT_GROUPS!r}) AS grp),
pairs AS (
  SELECT r.project_id, r.urn, m.grp FROM v_resources r JOIN purpose u USING (project_id, urn) JOIN mapping m ON list_contains(string_split(u.allowed, ','), m.purpose)
  UNION SELECT r.project_id, r.urn, d.grp FROM v_resources r, defaults d),
group_lists AS (SELECT project_id, urn, string_agg(grp, ',' ORDER BY grp) AS groups_ FROM pairs GROUP BY ALL)"""


@query("j6_groups", f"WITH {MATCHES}, {PURPOSE}, {GROUPS_SQL} SELECT project_id, urn AS resource_urn, groups_ FROM group_lists")
def j6_groups(t: Tables) -> DataFrame:
    found = resolve_groups(policies(t, ["purpose"]), group_mapping(t), DEFAULT_GROUPS)
    return found.select("project_id", "resource_urn", joined("groups").alias("groups_"))
