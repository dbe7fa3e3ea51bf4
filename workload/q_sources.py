"""Loading, normalising and writing out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark import fixed_values as fixed
from govspark.functions import glob_match
from govspark.session import ensure_checkpoint_dir
from govspark.sources.audit import append_audit, canonicalize_audit, parse_audit_stream
from govspark.sources.inventory import build_inventory, normalize_resources, scope_filter, upsert_resources
from govspark.sources.obligations import normalize_obligations
from govspark.sources.policy_documents import (
    check_documents,
    iam_statements,
    opa_documents,
    s3_statements,
    statement_documents,
    write_bundle,
)
from govspark.sources.warehouse_lineage import extract_lineage
from workload.q_policies import ALL_DOMAINS, C6, joined, policies, shown_policies
from workload.registry import query
from workload.tables import Tables, as_of
from workload.views import AS_OF, case_of, quoted

# --- raw policies ------------------------------------------------------------

_HEAD = """'{"id":"c' || s_suppkey || '","title":"' || s_name || '","provenance":{"source_id":"S' || s_nationkey || '"},' """
_BODIES = [
    "'\"retention\":{\"duration\":\"' || (s_suppkey % 40) || 'd\",\"trigger\":\"event_date\"},\"privacy\":{\"method\":\"anonymization\"}}'",
    "'\"geofencing\":{\"allowed_regions\":[\"DE\",\"FR\"]},\"enforcement_level\":\"blocking\"}'",
    "'\"purpose\":{\"denied_purposes\":[\"SALES\"]},\"enforcement_level\":3}'",
    "'\"constraint\":{\"type\":\"privacy_enhancement\",\"method\":\"2\",\"parameters\":{\"k\":\"7\"}}}'",
    "'\"ai_model\":{\"rag_usage_allowed\":true}}'",
    "'\"retention\":{\"duration\":\"10w\"}}'",
    "'\"description\":\"none\"}'",
    "'\"constraint\":{\"method\":\"2\"}}'",
    "'\"purpose\":{},\"enforcement_level\":\"never\"}'",
    "'\"constraint\":{\"type\":\"mystery\"}}'",
    "'\"retention\":{\"trigger\":\"LAST_ACCESS\"}'",
]
_RAW_POLICY = f"SELECT s_suppkey, {_HEAD} || {case_of(f's_suppkey % {len(_BODIES)}', *_BODIES)} AS body FROM supplier"


def _normalized(t: Tables) -> tuple[DataFrame, DataFrame]:
    t.base("supplier")
    return normalize_obligations(t.spark.sql(_RAW_POLICY))


_N = len(_BODIES)


@query("s1_obligations", f"""SELECT s_suppkey, 'c' || s_suppkey AS id, s_name AS title, 'S' || s_nationkey AS source_id,
  CASE s_suppkey % {_N} WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 2 END AS enforcement_level, CASE WHEN s_suppkey % {_N} = 0 THEN s_suppkey % 40 * 86400 END AS duration_s,
  CASE WHEN s_suppkey % {_N} = 0 THEN 3 END AS trigger_, CASE WHEN s_suppkey % {_N} = 1 THEN 'DE,FR' END AS allowed_regions,
  CASE WHEN s_suppkey % {_N} = 2 THEN 'SALES' END AS denied_purposes, CASE WHEN s_suppkey % {_N} = 3 THEN 2 END AS method,
  CASE WHEN s_suppkey % {_N} = 3 THEN '7' END AS k, CASE WHEN s_suppkey % {_N} = 4 THEN FALSE END AS training, CASE WHEN s_suppkey % {_N} = 4 THEN TRUE END AS rag
FROM supplier WHERE s_suppkey % {_N} < 5""")
def s1_obligations(t: Tables) -> DataFrame:
    return _normalized(t)[0].select(
        "s_suppkey", "id", "title", "provenance.source_id", "enforcement_level", "retention.duration_s", F.col("retention.trigger").alias("trigger_"),
        joined("geofencing.allowed_regions").alias("allowed_regions"), joined("purpose.denied_purposes").alias("denied_purposes"), "privacy.method",
        F.col("privacy.parameters")["k"].alias("k"), F.col("ai_model.training_allowed").alias("training"), F.col("ai_model.rag_usage_allowed").alias("rag"),
    )


_REASON = case_of(f"s_suppkey % {_N} - 5", *quoted("invalid duration", "missing constraint", "constraint block has no type", "invalid enforcement level", "unknown constraint type", "not a JSON object"))


@query("s1_rejects", f"SELECT s_suppkey, {_REASON} AS reason FROM supplier WHERE s_suppkey % {_N} >= 5")
def s1_rejects(t: Tables) -> DataFrame:
    return _normalized(t)[1].select("s_suppkey", "reason")


# --- inventory ---------------------------------------------------------------


@query("s2_resources", """SELECT project_id, urn, brand, env, coalesce(vendor, '') AS vendor, sensitivity, risk_level, ai_training_allowed, owner FROM v_resources""")
def s2_resources(t: Tables) -> DataFrame:
    tag = lambda k: F.try_element_at("tags", F.lit(k)).alias(k)
    return normalize_resources(t.view("v_resources_raw")).select(
        "project_id", "urn", tag("brand"), tag("env"), F.coalesce(F.try_element_at("tags", F.lit("vendor")), F.lit("")).alias("vendor"),
        "sensitivity", "risk_level", "ai_training_allowed", "owner",
    )


_NAME = "catalog_ || '.' || schema_ || '.' || table_"
_COLUMN_TEXT = """column_name || '|' || type_ || '|' || coalesce(comment_, '-') || '|' || concat_ws(',', 'governance.is_sensitive=' || tag_sensitive,
  'governance.pii_category=' || tag_pii, 'governance.rls_key=' || tag_rls)"""
INVENTORY_SQL = f"""
inv AS (SELECT lower('urn:lake:ws1:' || {_NAME}) AS urn, table_ AS name, max(owner) AS owner, string_agg({_COLUMN_TEXT}, ';' ORDER BY position) AS columns_
  FROM v_catalog_columns GROUP BY catalog_, schema_, table_),
tag_lists AS (SELECT lower('urn:lake:ws1:' || {_NAME}) AS urn, string_agg(key_ || '=' || value_, ',' ORDER BY key_) AS tags_ FROM v_table_tags WHERE value_ IS NOT NULL GROUP BY ALL)"""


@query("s3_inventory", f"WITH {INVENTORY_SQL} SELECT urn, name, owner, coalesce(tags_, '') AS tags_, columns_ FROM inv LEFT JOIN tag_lists USING (urn)")
def s3_inventory(t: Tables) -> DataFrame:
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    column = lambda c: F.concat_ws("|", c["name"], c["type"], F.coalesce(c["comment"], F.lit("-")), F.coalesce(text(c["tags"]), F.lit("")))
    return build_inventory(t.catalog_columns(), t.table_tags(), "lake", "ws1").select(
        "urn", "name", "owner", text(F.col("tags")).alias("tags_"), F.array_join(F.transform("columns", column), ";").alias("columns_")
    )


@query("s4_scope", "SELECT DISTINCT catalog_, schema_, table_ FROM v_catalog_columns WHERE catalog_ <> 'system' AND catalog_ LIKE 'Brand%' AND schema_ NOT LIKE '\\_\\_%' ESCAPE '\\' AND schema_ <> 'information_schema'")
def s4_scope(t: Tables) -> DataFrame:
    names = t.view("v_table_tags").select("catalog_", "schema_", "table_").distinct()
    catalogs = scope_filter(names, "catalog_", ["Brand*"], fixed.EXCLUDED_CATALOGS)
    return scope_filter(catalogs, "schema_", ["*"], fixed.EXCLUDED_SCHEMAS)


_CURRENT = "SELECT project_id, urn, platform, name, attributes, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS updated_at FROM v_resources_raw WHERE pk % 3 <> 0"
_BATCH = """SELECT project_id, urn, 'other' AS platform, name || '-new' AS name, '{"n":1}' AS attributes, pk AS seq FROM v_resources_raw WHERE pk % 5 < 2
  UNION ALL SELECT project_id, urn, 'late', name || '-newest', '{"n":2}', pk + 1000000000 FROM v_resources_raw WHERE pk % 10 = 0"""


@query("s5_upsert", f"""WITH c AS ({_CURRENT}), b AS ({_BATCH}), l AS (SELECT project_id, urn, arg_min(platform, seq) AS p, arg_max(name, seq) AS n, arg_max(attributes, seq) AS a FROM b GROUP BY ALL)
SELECT project_id, urn, coalesce(c.platform, l.p) AS platform, coalesce(l.n, c.name) AS name, coalesce(l.a, c.attributes) AS attributes,
  CASE WHEN l.n IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE c.updated_at END AS updated_at FROM c FULL JOIN l USING (project_id, urn)""")
def s5_upsert(t: Tables) -> DataFrame:
    t.view("v_resources_raw")
    return upsert_resources(t.spark.sql(_CURRENT), t.spark.sql(_BATCH), F.lit(as_of()).cast("timestamp"))


_ISO = "strftime(event_time, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(event_time) % 1000000 = 0 THEN '' ELSE strftime(event_time, '.%f') END || '+00:00'"
LINEAGE_SQL = f"""WITH w AS (SELECT *, coalesce(source_table, 'unknown') AS s, coalesce(target_table, 'unknown') AS g, coalesce(created_by, 'unknown') AS u FROM v_warehouse_lineage
  WHERE event_time >= TIMESTAMP '{AS_OF}' - INTERVAL 1200 HOUR),
k AS (SELECT *, sha1(unhex('{fixed.UUID_NAMESPACE_DNS}') || encode(s || '|' || g || '|' || {_ISO} || '|' || u)) AS h FROM w ORDER BY event_time DESC, s, g, u LIMIT {{limit}})
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1)
    || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS external_run_id,
  CASE WHEN entity_type LIKE 'DASHBOARD%' THEN 'HUMAN_DOWNLOAD' ELSE 'ETL_TRANSFORM' END AS run_type, u AS triggered_by,
  CASE WHEN u = 'System' THEN 3 WHEN u LIKE '%@%' OR u NOT LIKE '%-%' THEN 1 ELSE 2 END AS actor_type, event_time AS started_at,
  lower('urn:lake:ws1:' || s) AS source_urn, lower('urn:lake:ws1:' || g) AS target_urn FROM k"""


def _extract(t: Tables, cap: int | None) -> DataFrame:
    raw = t.view("v_warehouse_lineage").withColumnsRenamed(
        {"source_table": "source_table_full_name", "target_table": "target_table_full_name"}
    ).withColumn("event_time", F.col("event_time").cast("timestamp"))
    found = extract_lineage(raw, as_of(), "lake", "ws1", lookback_hours=1200, cap=cap)
    return found.select(
        "external_run_id", "run_type", "triggered_by", "actor_type", "started_at", F.get("inputs", F.lit(0)).alias("source_urn"), F.get("outputs", F.lit(0)).alias("target_urn")
    )


@query("s6_lineage_extract", LINEAGE_SQL.format(limit=100))
def s6_lineage_extract(t: Tables) -> DataFrame:
    return _extract(t, 100)


@query("s6_lineage_extract_all", LINEAGE_SQL.format(limit="ALL").replace(" LIMIT ALL", ""))
def s6_lineage_extract_all(t: Tables) -> DataFrame:
    return _extract(t, None)


# --- audit -------------------------------------------------------------------


@query("s7_canonical_audit", """SELECT id, project_id, actor_id, resource_urn, action, CASE decision WHEN 'ALLOW' THEN 1 WHEN 'DENY' THEN 2 ELSE 0 END AS decision,
  CASE WHEN event_id % 5 <> 4 THEN reason END AS reason_summary, CASE WHEN event_id % 5 <> 4 THEN coalesce(obligation_id, '') END AS obligation_ids,
  CASE WHEN event_id % 5 <> 4 THEN cache_hit END AS cache_hit, replace(request_context, ' ', '') AS request_context FROM v_audit_log""")
def s7_canonical_audit(t: Tables) -> DataFrame:
    return canonicalize_audit(t.audit_log()).select(
        "id", "project_id", F.col("actor.id").alias("actor_id"), "resource_urn", "action", "decision", "evaluation_trace.reason_summary",
        joined("evaluation_trace.contributing_obligation_ids").alias("obligation_ids"), "evaluation_trace.cache_hit", "request_context",
    )


@query("s8_append", "SELECT id, project_id FROM v_audit_log WHERE event_id % 4 <> 0")
def s8_append(t: Tables) -> DataFrame:
    log = t.audit_log()
    number = F.col("id").cast("bigint")
    # Every event is delivered, a third of them twice; a quarter is in the log already.
    batch = log.unionByName(log.filter(number % 3 == 0))
    return append_audit(log.filter(number % 4 == 0), batch).select("id", "project_id")


_STATUS = "CASE WHEN event_id % 11 = 0 THEN 'undecodable' WHEN event_id % 11 = 1 THEN 'invalid' ELSE 'good' END"


@query("s9_poison_messages", f"SELECT {_STATUS} AS status, count(*) AS messages FROM v_audit_log GROUP BY 1")
def s9_poison_messages(t: Tables) -> DataFrame:
    number = F.col("id").cast("bigint") % 11
    log = t.audit_log()
    message = F.to_json(F.struct(*[F.when(number == 1, F.lit(None)).otherwise(F.col(c)).alias(c) if c == "action" else F.col(c) for c in log.columns]))
    lines = log.select(F.when(number == 0, message.substr(F.lit(1), F.length(message) - 5)).otherwise(message).alias("value"))
    return parse_audit_stream(lines).groupBy("status").agg(F.count("*").alias("messages"))


# --- policy documents --------------------------------------------------------

_ARN = "CASE WHEN platform = 'aws-s3' THEN 'arn:aws:s3:::bucket-' || pk || '/*' ELSE 'arn:aws:glue:table/' || pk END"
_LIST = lambda c: f"'[' || CASE WHEN {c} = '' THEN '' ELSE '\"' || replace({c}, ',', '\",\"') || '\"' END || ']'"
_FLAG = lambda c: f"CASE WHEN {c} THEN 'true' ELSE 'false' END"


@query("s10_policy_bundle", C6)
def s10_policy_bundle(t: Tables) -> DataFrame:
    """The bundle is written and its documents are read back."""
    ensure_checkpoint_dir(t.spark)
    folder = f"{t.spark.sparkContext.getCheckpointDir()}/bundle-{uuid.uuid4().hex}"
    built = policies(t)
    write_bundle(built, folder, "all")
    return shown_policies(t.spark.read.schema(built.schema).json(f"{folder}/policies"))


@query("s11_opa_documents", f"""WITH {ALL_DOMAINS}, ids AS (SELECT project_id, urn, string_agg(id, ',' ORDER BY ord) AS ids FROM hits GROUP BY ALL)
SELECT r.project_id, r.urn AS resource_urn, '{{"resource_urn":"' || r.urn || '","meta":{{"contributing_obligations":' || {_LIST("coalesce(i.ids, '')")} || '}}'
  || coalesce(',"retention":{{"max_seconds":' || t.duration_s || ',"is_indefinite":false,"reason_code":"' || t.source || '"}}', '')
  || coalesce(',"geofencing":{{"allowed_regions":' || {_LIST('g.allowed')} || ',"blocked_regions":' || {_LIST('g.denied')} || ',"is_global_ban":' || {_FLAG('g.is_global_ban')} || ',"reason_code":"' || g.source || '"}}', '')
  || coalesce(',"ai_rules":{{"training_allowed":' || {_FLAG('a.training')} || ',"fine_tuning_allowed":' || {_FLAG('a.tuning')} || ',"rag_allowed":' || {_FLAG('a.rag')}
     || ',"attribution_required":' || {_FLAG('a.attribution')} || ',"attribution_text":"' || a.credit || '","reason_code":"' || a.source || '"}}', '')
  || coalesce(',"purpose":{{"allowed_purposes":' || {_LIST('u.allowed')} || ',"denied_purposes":' || {_LIST('u.denied')} || ',"reason_code":"' || u.source || '"}}', '')
  || coalesce(',"privacy":{{"method":"' || p.method_name || '","parameters":{{' || concat_ws(',', '"algorithm":"' || p.p_algorithm || '"', '"delta":"' || p.p_delta || '"',
     '"epsilon":"' || p.p_epsilon || '"', '"k":"' || p.p_k || '"') || '}},"reason_code":"' || p.source || '"}}', '') || '}}' AS document
FROM v_resources r LEFT JOIN retention t USING (project_id, urn) LEFT JOIN geofencing g USING (project_id, urn) LEFT JOIN purpose u USING (project_id, urn)
LEFT JOIN ai a USING (project_id, urn) LEFT JOIN privacy_text p USING (project_id, urn) LEFT JOIN ids i USING (project_id, urn)""".replace("{{", "{").replace("}}", "}"))
def s11_opa_documents(t: Tables) -> DataFrame:
    return opa_documents(policies(t))


def _with_arn(t: Tables) -> DataFrame:
    arns = t.view("v_resources").selectExpr("project_id", "urn AS resource_urn", f"{_ARN} AS resource_arn")
    return policies(t).join(arns, ["project_id", "resource_urn"])


_POL = f"""pol AS (SELECT r.project_id, r.urn AS resource_urn, {_ARN} AS arn, g.is_global_ban AS ban, g.allowed AS g_allow, g.denied AS g_deny, a.training, u.allowed AS u_allow, u.denied AS u_deny, p.method
  FROM v_resources r LEFT JOIN geofencing g USING (project_id, urn) LEFT JOIN purpose u USING (project_id, urn) LEFT JOIN ai a USING (project_id, urn) LEFT JOIN privacy p USING (project_id, urn))"""


def _rows(rules: list[tuple[str, str, str, str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT project_id, resource_urn, '{sid}' AS sid, {actions} AS actions, {resources} AS resources, {key} AS condition_key, {values} AS condition_values FROM pol WHERE {where}"
        for sid, where, actions, resources, key, values in rules
    )


_AI = f"'{','.join(fixed.AI_ACTIONS)}'"
_INPUTS = "CASE WHEN arn LIKE 'arn:aws:s3:::%' THEN 's3://' || substr(arn, 14) || '/*,s3://' || substr(arn, 14) ELSE arn END"


@query("s12_iam_statements", f"WITH {ALL_DOMAINS}, {_POL} " + _rows([
    ("GovGeoGlobalBan", "ban", "'*'", "arn", "'gov:reason'", "'global_ban'"),
    ("GovGeoBlockDeniedRegions", "NOT ban AND g_deny <> ''", "'*'", "arn", "'aws:RequestedRegion'", "g_deny"),
    ("GovGeoEnforceAllowedRegions", "NOT ban AND g_allow <> ''", "'*'", "arn", "'aws:RequestedRegion'", "g_allow"),
    ("GovBlockAiTraining", "NOT training", _AI, "'*'", "'sagemaker:InputDataConfig'", _INPUTS),
    ("GovBlockDeniedPurposes", "u_deny <> ''", "'*'", "arn", "'aws:PrincipalTag/gov:purpose'", "u_deny"),
    ("GovEnforceAllowedPurposes", "u_allow <> ''", "'*'", "arn", "'aws:PrincipalTag/gov:purpose'", "u_allow"),
    ("GovEnforcePrivacyEncryption", "method IS NOT NULL", "'*'", "arn", "'aws:SecureTransport'", "'false'"),
]))
def s12_iam_statements(t: Tables) -> DataFrame:
    return _statement_rows(iam_statements(_with_arn(t)))


def _statement_rows(statements: DataFrame) -> DataFrame:
    return statements.select(
        "project_id", "resource_urn", "sid", joined("actions").alias("actions"), joined("resources").alias("resources"), "condition_key",
        joined("condition_values").alias("condition_values"),
    )


_BUCKET = "substr(arn, 1, length(arn) - 2)"
_BOTH = f"{_BUCKET} || ',' || {_BUCKET} || '/*'"
_S3 = "arn LIKE 'arn:aws:s3:::%'"
_READ = "'s3:GetObject,s3:ListBucket'"


@query("s13_s3_statements", f"WITH {ALL_DOMAINS}, {_POL} " + _rows([
    ("GovDenyAiServiceAccess", f"{_S3} AND NOT training", _READ, _BOTH, "'aws:ViaAWSService'", f"'{','.join(fixed.AI_SERVICES)}'"),
    ("GovDenyAiServicePrincipals", f"{_S3} AND NOT training", _READ, _BOTH, "NULL", "NULL"),
    ("GovEnforceTls", f"{_S3} AND method IS NOT NULL", "'s3:*'", _BOTH, "'aws:SecureTransport'", "'false'"),
    ("GovGlobalBanLockdown", f"{_S3} AND ban", "'s3:*'", _BOTH, "'aws:PrincipalTag/GovRole'", "'PlatformAdmin'"),
]))
def s13_s3_statements(t: Tables) -> DataFrame:
    return _statement_rows(s3_statements(_with_arn(t)))


@query("s14_document_checks", """SELECT kind, count(*) AS documents, 0 AS with_errors FROM (SELECT 'iam' AS kind FROM v_resources UNION ALL SELECT 'opa' FROM v_resources) GROUP BY kind""")
def s14_document_checks(t: Tables) -> DataFrame:
    found = _with_arn(t)
    iam = check_documents(statement_documents(found, iam_statements(found)), "iam").select(F.lit("iam").alias("kind"), "errors")
    opa = check_documents(opa_documents(found), "opa").select(F.lit("opa").alias("kind"), "errors")
    return iam.unionByName(opa).groupBy("kind").agg(
        F.count("*").alias("documents"), F.count_if(F.size("errors") > 0).alias("with_errors")
    )
