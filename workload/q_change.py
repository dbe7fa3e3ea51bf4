"""Sync plans, drift and diffs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.operators import change
from workload.q_policies import ALL_DOMAINS, METHOD_NAME, policies
from workload.registry import query
from workload.tables import Tables, as_of
from workload.views import AS_OF

# Definitions as JSON text; the incoming side writes its keys in another order.
_DOC = """'{{"days":' || (k % {mod}) || ',"title":"' || title || '"}}'"""
_CURRENT = f"""SELECT coalesce(project_id, 'all') AS project_id, id AS slug, title, {_DOC.format(mod=30)} AS definition, sha2_hex({_DOC.format(mod=30)}) AS source_hash,
  CAST(1 + k % 4 AS INT) AS version, is_active, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS updated_at FROM v_obligations"""
_INCOMING = """SELECT coalesce(project_id, 'all') AS project_id, id AS slug, title,
  '{ "title": "' || title || '", "days": ' || (k % CASE WHEN k % 3 = 0 THEN 7 ELSE 30 END) || ' }' AS definition FROM v_obligations_v2"""


def _texts(spark: bool) -> tuple[str, str]:
    fn = "sha2({}, 256)" if spark else "sha256({})"
    return _CURRENT.replace(f"sha2_hex({_DOC.format(mod=30)})", fn.format(_DOC.format(mod=30))), _INCOMING


_C, _I = _texts(False)
_PLAN = f"""c AS ({_C}), i AS (SELECT *, sha256('{{"days":' || regexp_extract(definition, 'days": (\\d+)', 1) || ',"title":"' || title || '"}}') AS new_hash FROM ({_I})),
plan AS (SELECT project_id, slug, coalesce(i.title, c.title) AS title,
  CASE WHEN c.slug IS NULL THEN 'CREATED' WHEN i.slug IS NULL THEN 'PRUNED' WHEN source_hash <> new_hash THEN 'UPDATED' ELSE 'UNCHANGED' END AS status,
  CASE WHEN c.slug IS NULL THEN 1 WHEN source_hash <> new_hash THEN version + 1 ELSE version END AS version
  FROM (SELECT * FROM c WHERE is_active) c FULL JOIN i USING (project_id, slug))"""


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    t.view("v_obligations"), t.view("v_obligations_v2")
    current, incoming = _texts(True)
    return t.spark.sql(current), t.spark.sql(incoming)


@query("g2_sync_plan", f"WITH {_PLAN} SELECT * FROM plan")
def g2_sync_plan(t: Tables) -> DataFrame:
    return change.plan_sync(*_sides(t), prune=True).drop("new_hash")


@query("g2_sync_apply", f"""WITH {_PLAN}, n AS (SELECT p.*, i.new_hash FROM plan p LEFT JOIN i USING (project_id, slug))
SELECT project_id, slug, coalesce(CASE WHEN w THEN new_hash END, source_hash) AS source_hash, CASE WHEN w THEN n_version ELSE version END AS version,
  CASE WHEN w THEN TRUE WHEN status = 'PRUNED' THEN FALSE ELSE is_active END AS is_active,
  CASE WHEN w OR status = 'PRUNED' THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at
FROM (SELECT project_id, slug, c.source_hash, c.version, c.is_active, c.updated_at, n.new_hash, n.status, n.version AS n_version,
    n.new_hash IS NOT NULL AND (c.slug IS NULL OR c.source_hash <> n.new_hash OR NOT c.is_active) AS w FROM c FULL JOIN n USING (project_id, slug))""")
def g2_sync_apply(t: Tables) -> DataFrame:
    return change.apply_sync(*_sides(t), F.lit(as_of()).cast("timestamp"), prune=True).drop("title", "definition")


@query("g3_pull_plan", f"""WITH {_PLAN} SELECT project_id, slug, title, CASE status WHEN 'CREATED' THEN 'NEW' WHEN 'PRUNED' THEN 'DELETED' ELSE status END AS status, version FROM plan""")
def g3_pull_plan(t: Tables) -> DataFrame:
    return change.plan_sync(*_sides(t), direction="pull").drop("new_hash")


_DESIRED = "SELECT 'mask_' || p_partkey AS object_name, 'gov:v1:' || substr(h, 1, 8) AS content_hash, 'f' || (p_partkey % 3) AS binding FROM (SELECT *, {hash} AS h FROM part) x"
_ACTUAL = """SELECT 'mask_' || p_partkey AS object_name, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'gov:v1:' || substr(h, 1, 8) || ' | note' WHEN 2 THEN 'manual' ELSE 'gov:v1:00000000' END AS comment,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'f' || (p_partkey % 4) END AS binding FROM (SELECT *, {hash} AS h FROM part) x WHERE p_partkey % 5 <> 0"""
_DH, _SH = "sha256(p_name || p_partkey)", "sha2(p_name || p_partkey, 256)"


@query("g4_drift", f"""WITH d AS ({_DESIRED.format(hash=_DH)}), a AS ({_ACTUAL.format(hash=_DH)}),
j AS (SELECT d.*, a.object_name IS NOT NULL AS there, a.comment, a.binding AS bound FROM d LEFT JOIN a USING (object_name))
SELECT object_name, CASE WHEN NOT there THEN 'missing' WHEN coalesce(comment, '') NOT LIKE 'gov:v%' THEN 'no hash' WHEN substr(comment, 1, 15) <> content_hash THEN 'changed' ELSE 'current' END AS cause,
  NOT there OR coalesce(comment, '') NOT LIKE 'gov:v%' OR substr(comment, 1, 15) <> content_hash AS needs_update, bound IS DISTINCT FROM binding AS needs_binding FROM j""")
def g4_drift(t: Tables) -> DataFrame:
    t.base("part")
    return change.drift(t.spark.sql(_DESIRED.format(hash=_SH)), t.spark.sql(_ACTUAL.format(hash=_SH)))


@query("g5_changed_only", f"WITH {_PLAN} SELECT i.slug AS name FROM i WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.slug = i.slug AND c.source_hash = i.new_hash)")
def g5_changed_only(t: Tables) -> DataFrame:
    current, incoming = _sides(t)
    seen = current.select(F.col("slug").alias("name"), F.col("source_hash").alias("definition_hash"))
    return change.changed_only(incoming.withColumnRenamed("slug", "name"), seen).select("name")


# --- semantic diff -----------------------------------------------------------


def _suffixed(sql: str) -> str:
    """The resolution statements once more, over the second version of the obligations."""
    names = set(re.findall(r"(?:^|[\s,])(\w+) AS \(", sql)) & {
        "matches", "hits", "retention", "geofencing", "purpose", "ai_rules", "ai_sum", "ai", "top_method", "peers", "privacy", "privacy_text",
        *[f"{p}_{s}" for p in ("geo", "use") for s in ("rules", "allow", "deny", "n", "kept", "final", "death", "end", "win", "lists")],
    }
    out = sql.replace("v_obligations", "v_obligations_v2")
    for name in names:
        out = re.sub(rf"(?<=FROM ){name}\b|(?<=JOIN ){name}\b|(?<![\w.]){name}(?= AS \()", f"{name}_v2", out)
    return out


_SIDE = """{side} AS (SELECT r.project_id, r.urn AS resource_urn, t.duration_s, g.urn IS NOT NULL AS has_geo, g.is_global_ban AS ban, g.allowed AS regions, a.urn IS NOT NULL AS has_ai,
  a.training, a.tuning, a.rag, a.attribution, a.credit, u.urn IS NOT NULL AS has_use, u.allowed AS uses, u.denied AS bad_uses, p.method, {name} AS method_name, p.p_epsilon, p.p_k,
  '{{' || concat_ws(',', '"algorithm":"' || p.p_algorithm || '"', '"delta":"' || p.p_delta || '"', '"epsilon":"' || p.p_epsilon || '"', '"k":"' || p.p_k || '"') || '}}' AS params
  FROM v_resources r LEFT JOIN retention{v} t USING (project_id, urn) LEFT JOIN geofencing{v} g USING (project_id, urn) LEFT JOIN purpose{v} u USING (project_id, urn)
  LEFT JOIN ai{v} a USING (project_id, urn) LEFT JOIN privacy{v} p USING (project_id, urn))"""
_MINUS = lambda a, b: f"(SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT unnest(string_split({a}, ',')) AS x EXCEPT SELECT unnest(string_split({b}, ','))) WHERE x <> '')"


def _clock(x: str) -> str:
    days, rest = f"({x} // 86400)", f"({x} % 86400)"
    named = f"CASE {days} WHEN 0 THEN '' WHEN 1 THEN '1 day, ' ELSE {days} || ' days, ' END"
    return f"({named} || ({rest} // 3600) || ':' || lpad(CAST({rest} % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({rest} % 60 AS VARCHAR), 2, '0'))"


def _change_rows() -> str:
    """SQL of every kind of change: category, field, condition, old value, new value, type, impact, description."""
    tight, loose, none = "'RESTRICTIVE'", "'PERMISSIVE'", "NULL"
    by = lambda c: f"CASE WHEN {c} THEN 'RESTRICTIVE' ELSE 'PERMISSIVE' END"
    shown = lambda c: f"CASE WHEN {c} THEN 'True' ELSE 'False' END"
    number = lambda c: f"CAST({c} AS DOUBLE)"

    def flag(name: str, label: str, field: str, tight_if: str):
        old, new = shown(f"o.{field}"), shown(f"n.{field}")
        return ("AI Rules", name, f"o.{field} <> n.{field}", old, new, "MODIFIED", by(tight_if), f"'{label} changed from ' || {old} || ' to ' || {new} || '.'")

    def gain(category: str, field: str, column: str, flag_: str, up: str, down: str, gained: str, lost: str):
        more, less = _MINUS(f"n.{column}", f"o.{column}"), _MINUS(f"o.{column}", f"n.{column}")
        both = f"o.{flag_} AND n.{flag_}"
        return [
            (category, field, f"{both} AND {more} IS NOT NULL", none, more, "MODIFIED", up, f"'{gained}: ' || {more}"),
            (category, field, f"{both} AND {less} IS NOT NULL", less, none, "MODIFIED", down, f"'{lost}: ' || {less}"),
        ]

    def setting(key: str, sign: str):
        old, new = number(f"o.p_{key}"), number(f"n.p_{key}")
        text = f"'Privacy parameter {key} changed from ' || {old} || ' to ' || {new} || '.'"
        return ("Privacy", f"parameters.{key}", f"{old} <> {new}", old, new, "MODIFIED", by(f"{new} {sign} {old}"), text)

    before, after = _clock("o.duration_s"), _clock("n.duration_s")
    stronger = "CASE WHEN n.method > o.method THEN 'Privacy method upgraded (stronger protection). ' ELSE 'Privacy method downgraded (weaker protection). ' END"
    rows = [
        ("Retention", "rule", "o.duration_s IS NOT NULL AND n.duration_s IS NULL", "'Defined'", "'None'", "REMOVED", loose, "'Retention rule removed. Data may be kept indefinitely.'"),
        ("Retention", "rule", "o.duration_s IS NULL AND n.duration_s IS NOT NULL", "'None'", after, "ADDED", tight, f"'Retention rule added. Max duration: ' || {after} || '.'"),
        ("Retention", "duration", "o.duration_s <> n.duration_s", before, after, "MODIFIED", by("n.duration_s < o.duration_s"), f"'Retention duration changed from ' || {before} || ' to ' || {after} || '.'"),
        ("Geofencing", "rule", "NOT o.has_geo AND n.has_geo", "'None'", "'Defined'", "ADDED", tight, "'Geofencing rules applied.'"),
        ("Geofencing", "is_global_ban", "o.ban <> n.ban", shown("o.ban"), shown("n.ban"), "MODIFIED", by("n.ban"), f"'Global Data Ban changed to ' || {shown('n.ban')} || '.'"),
        *gain("Geofencing", "allowed_regions", "regions", "has_geo", loose, tight, "Allowed regions added", "Allowed regions removed"),
        flag("training_allowed", "AI Training", "training", "NOT n.training"),
        flag("fine_tuning_allowed", "AI Fine-Tuning", "tuning", "NOT n.tuning"),
        flag("rag_allowed", "RAG Usage", "rag", "NOT n.rag"),
        flag("attribution_required", "Attribution Requirement", "attribution", "n.attribution"),
        ("AI Rules", "attribution_text", "o.credit <> n.credit", "o.credit", "n.credit", "MODIFIED", "'NEUTRAL'", "'Attribution text content updated.'"),
        ("Purpose", "rule", "NOT o.has_use AND n.has_use", "'Open'", "'Restricted'", "ADDED", tight, "'Purpose limitation rules applied.'"),
        ("Purpose", "rule", "o.has_use AND NOT n.has_use", "'Restricted'", "'Open'", "REMOVED", loose, "'Purpose limitation removed. Data can be used for any purpose.'"),
        *gain("Purpose", "allowed_purposes", "uses", "has_use", loose, tight, "Allowed purposes expanded", "Allowed purposes reduced"),
        *gain("Purpose", "denied_purposes", "bad_uses", "has_use", tight, loose, "Denied purposes added", "Denied purposes removed"),
        ("Privacy", "rule", "o.method IS NULL AND n.method IS NOT NULL", "'None'", "n.method_name", "ADDED", tight, "'Privacy method ' || n.method_name || ' applied.'"),
        ("Privacy", "rule", "o.method IS NOT NULL AND n.method IS NULL", "o.method_name", "'None'", "REMOVED", loose, "'Privacy method ' || o.method_name || ' removed. Data is now raw/unmasked.'"),
        ("Privacy", "method", "o.method <> n.method", "o.method_name", "n.method_name", "MODIFIED", by("n.method > o.method"), f"{stronger} || o.method_name || ' -> ' || n.method_name || '.'"),
        setting("epsilon", "<"),
        setting("k", ">"),
        ("Privacy", "parameters", "o.method IS NOT NULL AND n.method IS NOT NULL AND o.params <> n.params AND o.p_epsilon IS NULL AND o.p_k IS NULL", "o.params", "n.params", "MODIFIED", "'NEUTRAL'", "'Privacy configuration parameters updated.'"),
    ]
    return " UNION ALL ".join(
        f"SELECT o.project_id, o.resource_urn, {i} AS position, '{c}' AS category, '{f}' AS field, CAST({old} AS VARCHAR) AS old_value, CAST({new} AS VARCHAR) AS new_value, "
        f"'{kind}' AS change_type, {impact} AS impact, {text} AS description FROM o JOIN n USING (project_id, resource_urn) WHERE {where}"
        for i, (c, f, where, old, new, kind, impact, text) in enumerate(rows)
    )


DIFF = f"""WITH {ALL_DOMAINS}, {_suffixed(ALL_DOMAINS)}, {_SIDE.format(side='o', v='', name=METHOD_NAME)}, {_SIDE.format(side='n', v='_v2', name=METHOD_NAME)},
changes AS ({_change_rows()})"""
_SHOWN = ["project_id", "resource_urn", "category", "field", "old_value", "new_value", "change_type", "impact", "description"]


def _changes(t: Tables) -> DataFrame:
    return change.diff_versions(t.resources(), t.obligations(), t.obligations("v_obligations_v2"))


@query("g6_policy_diff", f"{DIFF} SELECT {', '.join(_SHOWN)} FROM changes")
def g6_policy_diff(t: Tables) -> DataFrame:
    return _changes(t).select(*_SHOWN)


@query("g6_snapshot_diff", f"{DIFF} SELECT {', '.join(_SHOWN)} FROM changes")
def g6_snapshot_diff(t: Tables) -> DataFrame:
    """The same changes from two finished snapshots, as they are read from bundles."""
    return change.diff_policies(policies(t), policies(t, version="v_obligations_v2")).select(*_SHOWN)


@query("g7_risk_delta", f"""{DIFF} SELECT project_id, resource_urn, sum(CASE impact WHEN 'PERMISSIVE' THEN 1 WHEN 'RESTRICTIVE' THEN -1 ELSE 0 END) AS risk_delta, count(*) AS changes FROM changes GROUP BY ALL""")
def g7_risk_delta(t: Tables) -> DataFrame:
    return change.risk_delta(_changes(t))


_ICON = "CASE impact " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in change._ICONS.items()) + " END"


@query("g8_diff_report", f"""{DIFF},
lines AS (SELECT project_id, resource_urn, sum(CASE impact WHEN 'PERMISSIVE' THEN 1 WHEN 'RESTRICTIVE' THEN -1 ELSE 0 END) AS score,
  string_agg('| **' || category || '** | ' || {_ICON} || ' | `' || field || '` | ' || description || ' |', chr(10) ORDER BY position) AS body FROM changes GROUP BY ALL),
was AS (SELECT project_id, urn AS resource_urn, count(*) AS n FROM hits GROUP BY ALL), became AS (SELECT project_id, urn AS resource_urn, count(*) AS n FROM hits_v2 GROUP BY ALL)
SELECT r.project_id, r.urn AS resource_urn, CASE WHEN body IS NULL THEN '{change._NO_CHANGE}' || r.urn || '`.' ELSE
  '{change._REPORT_TITLE}' || r.urn || '`' || chr(10) || CASE WHEN score > 0 THEN '{change._RISK_UP}' || CAST(score AS BIGINT) || ').' WHEN score < 0 THEN '{change._RISK_DOWN}' || CAST(score AS BIGINT) || ').'
  ELSE '{change._RISK_LEVEL}' END || chr(10) || chr(10) || '{change._TABLE_HEAD}' || chr(10) || body || chr(10) || chr(10) || '**Contributing Obligations:** ' || coalesce(b.n, 0) || ' (Was: ' || coalesce(w.n, 0) || ')' END AS report
FROM (SELECT project_id, urn, urn AS resource_urn FROM v_resources) r LEFT JOIN lines l USING (project_id, resource_urn) LEFT JOIN was w USING (project_id, resource_urn) LEFT JOIN became b USING (project_id, resource_urn)""")
def g8_diff_report(t: Tables) -> DataFrame:
    """A report for every resource, also of those without a change."""
    return change.diff_markdown(_changes(t), t.resources().withColumnRenamed("urn", "resource_urn"))
