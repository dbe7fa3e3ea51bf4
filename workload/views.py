"""Governance tables as projections of the benchmark tables.

Each view is one SQL text; only a few functions differ between the engines and come from ``Dialect``.
Lists travel as comma-separated text. Names that start with ``v_`` are views.
"""

from __future__ import annotations

import re

AS_OF = "2024-02-01 00:00:00"
SWEEP_AS_OF = "2001-08-01 00:00:00"


class Dialect:
    """SQL spellings that differ."""

    def __init__(self, name: str):
        self.spark = name == "spark"

    def iso_days_before(self, ts: str, days: str) -> str:
        if self.spark:
            return f"date_format(timestampadd(DAY, -CAST(floor({days}) AS INT), {ts}), \"yyyy-MM-dd'T'HH:mm:ss\")"
        return f"strftime({ts} - to_days(CAST(floor({days}) AS INTEGER)), '%Y-%m-%dT%H:%M:%S')"

    def iso(self, ts: str) -> str:
        return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss\")" if self.spark else f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"

    def hours_before(self, ts: str, hours: str) -> str:
        if self.spark:
            return f"timestampadd(HOUR, -CAST({hours} AS INT), {ts})"
        return f"({ts} - to_hours(CAST({hours} AS INTEGER)))"

    def lines(self, table: str, key: str, text: str) -> str:
        """(key, pos, line) of each line of a text column."""
        if self.spark:
            return f"SELECT {key}, CAST(pos AS BIGINT) AS pos, line FROM {table} LATERAL VIEW posexplode(split({text}, '\\\\n')) t AS pos, line"
        return (
            f"SELECT {key}, CAST(i - 1 AS BIGINT) AS pos, parts[i] AS line FROM (SELECT {key}, parts, "
            f"unnest(range(1, len(parts) + 1)) AS i FROM (SELECT {key}, string_split({text}, chr(10)) AS parts FROM {table}))"
        )

    def numbered(self, table: str, n: int) -> str:
        """Each row n times, with d = 0 .. n - 1."""
        if self.spark:
            return f"SELECT * FROM {table} LATERAL VIEW explode(sequence(0, {n - 1})) t AS d"
        return f"SELECT *, unnest({list(range(n))}) AS d FROM {table}"

    def int_div(self, a: str, b: int) -> str:
        return f"CAST(floor({a} / {b}) AS BIGINT)"


def case_of(value: str, *options: str) -> str:
    """CASE over a remainder, one option per value; options are SQL text."""
    arms = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE CAST({value} AS INT) {arms} END"


def quoted(*values: str) -> list[str]:
    return [f"'{v}'" for v in values]


def platform_of(k: str) -> str:
    return case_of(f"({k}) % 3", *quoted("snowflake", "databricks", "aws-s3"))


def type_of(k: str) -> str:
    return case_of(f"({k}) % 7", *quoted("economy", "large", "medium", "promo", "small", "standard", "custom"))


def urn_of(k: str) -> str:
    return f"'urn:' || {platform_of(k)} || ':prod:' || {type_of(k)} || ':' || ({k})"


def project_of(k: str) -> str:
    return f"'p' || ((({k}) % 11) % 3)"


def v_resources(d: Dialect) -> str:
    return f"""
    SELECT p_partkey AS pk, {project_of('p_partkey')} AS project_id, {urn_of('p_partkey')} AS urn,
           {platform_of('p_partkey')} AS platform, p_name AS name, p_brand AS brand,
           {type_of('p_partkey')} AS type_tag,
           CASE WHEN p_size % 2 = 0 THEN 'prod' ELSE 'dev' END AS env,
           CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 'v' || (p_partkey % 1000) END AS vendor,
           CAST(p_size % 5 AS INT) AS sensitivity, CAST(p_partkey % 5 AS INT) AS risk_level,
           p_partkey % 17 <> 0 AS ai_training_allowed, 'owner_' || (p_partkey % 11) AS owner
    FROM part"""


_SENS = ["UNSPECIFIED", "PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED"]


def v_resources_raw(d: Dialect) -> str:
    """The same resources with an open JSON column; some keep the sensitivity under tags only."""
    sens = case_of("sensitivity", *quoted(*_SENS))
    lower = case_of("sensitivity", *quoted(*[s.lower() for s in _SENS]))
    vendor = "CASE WHEN vendor IS NULL THEN '' ELSE ',\"vendor\":\"' || vendor || '\"' END"
    return f"""
    SELECT pk, project_id, urn, platform, CASE WHEN pk % 9 = 0 THEN '' ELSE name END AS name,
      '{{"owner":"' || owner || '","risk_level":' || risk_level
      || CASE WHEN pk % 4 = 0 THEN '' WHEN pk % 4 = 1 THEN ',"sensitivity":"UNSPECIFIED"' ELSE ',"sensitivity":"' || {sens} || '"' END
      || CASE WHEN ai_training_allowed THEN CASE WHEN pk % 2 = 0 THEN '' ELSE ',"ai_training_allowed":true' END
              ELSE ',"ai_training_allowed":false' END
      || ',"tags":{{"brand":"' || brand || '","env":"' || env || '","sensitivity":"' || {lower} || '","type":"' || type_tag || '"'
      || {vendor} || '}}}}' AS attributes
    FROM v_resources"""


def v_obligation_keys(d: Dialect) -> str:
    """One row per obligation: national rules (all projects) and one contract per supplier."""
    return f"""
    SELECT CAST(NULL AS STRING) AS project_id, 'ob-n' || n_nationkey || '-' || d AS id, CAST(n_nationkey * 5 + d AS BIGINT) AS ord,
      CAST(n_nationkey AS BIGINT) AS k, d, n_name AS source, 'n' AS src FROM ({d.numbered('nation', 5)}) x
    UNION ALL
    SELECT 'p' || (s_suppkey % 3), 'ob-s' || s_suppkey, 125 + s_suppkey, s_suppkey, CAST(s_suppkey % 5 AS INT), s_name, 's' FROM supplier"""


_DOMAIN_NAMES = ["Retention", "Geofencing", "Purpose", "Privacy", "AI"]


def _obligations(keys: str, halve: bool) -> str:
    n, s = "src = 'n'", "src = 's'"
    days = "30 * (1 + k % 25)"
    duration = f"CAST({days} * 86400 / CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS BIGINT)" if halve else f"CAST({days} * 86400 AS BIGINT)"
    shift = "(k + 1)" if halve else "k"
    method = "(k + k % 4) % 5" if halve else "k % 5"
    geo = case_of("k % 6", *quoted("DE,FR,IT,US", "DE,FR,GB,US", "", "DE,FR,JP,US", "DE,FR,FR", "BR,DE,FR,US"))
    geo_deny = case_of(f"{shift} % 5", *quoted("CN,RU", "RU", "", "FR", ""))
    allow = case_of("k % 4", *quoted("ANALYTICS,FINANCE,MARKETING", "", "AI_TRAINING,ANALYTICS,FINANCE", "ANALYTICS,DEBUGGING,FINANCE"))
    deny = case_of(f"{shift} % 6", *quoted("MARKETING", "", "SALES", "", "HR_ADMIN,SALES", ""))
    return f"""
    SELECT project_id, id, ord, k, d, src, {case_of('d', *quoted(*_DOMAIN_NAMES))} || ' rule of ' || source AS title,
      CAST(1 + k % 3 AS INT) AS enforcement_level, 'SRC-' || source AS source_id, k % 13 <> 12 AS is_active,
      CASE WHEN {n} AND k % 4 = 1 THEN 'urn:snowflake:prod:' || {type_of('k')} || ':*'
           WHEN {n} AND k % 4 = 2 THEN 'urn:*[!02468][13579]'
           WHEN {n} AND k % 8 = 3 THEN 'urn:databricks:*'
           WHEN {s} AND k % 20 = 3 THEN 'urn:aws-s3:prod:' || {type_of('k')} || ':' || (k % 100) || '*'
           WHEN {s} AND k % 20 = 11 THEN 'urn:snowflake:prod:small:1*'
           WHEN {s} AND k % 20 = 13 THEN {urn_of('k')}
           ELSE '' END AS include,
      CASE WHEN {s} AND k % 20 = 13 THEN 'urn:?atabricks:prod:c*:*7?' ELSE '' END AS include2,
      CASE WHEN {n} AND k % 4 = 2 THEN 'urn:aws-s3:*' WHEN {s} AND k % 7 = 0 THEN 'urn:*:*5' ELSE '' END AS exclude,
      CASE WHEN {n} AND k % 4 = 0 THEN 'Brand#' || (k + 1) END AS req_brand,
      CASE WHEN {n} AND k % 8 = 3 THEN 'prod' WHEN {s} AND k % 20 = 9 THEN 'dev' END AS req_env,
      CASE WHEN {s} AND k % 20 = 11 THEN '' WHEN {s} AND k % 20 NOT IN (3, 13) THEN 'v' || k END AS req_vendor,
      CASE WHEN d = 0 THEN {duration} END AS duration_s, CASE WHEN d = 0 THEN CAST(k % 5 AS INT) END AS trigger_,
      CASE WHEN d = 1 THEN CASE WHEN k % 24 = 23 THEN 'IN,JP' ELSE {geo} END END AS allowed_regions,
      CASE WHEN d = 1 THEN {geo_deny} END AS denied_regions,
      CASE WHEN d = 2 THEN CASE WHEN k % 23 = 22 THEN 'HR_ADMIN' ELSE {allow} END END AS allowed_purposes,
      CASE WHEN d = 2 THEN {deny} END AS denied_purposes,
      CASE WHEN d = 3 THEN CAST({method} AS INT) END AS method,
      CASE WHEN d = 3 AND {method} = 3 THEN {case_of('k % 4', *quoted('0.5', '1.0', '2.0'), 'NULL')} END AS p_epsilon,
      CASE WHEN d = 3 AND {method} = 3 AND k % 3 = 0 THEN '0.01' END AS p_delta,
      CASE WHEN d = 3 AND {method} = 2 THEN CAST(3 + k % 8 AS STRING) END AS p_k,
      CASE WHEN d = 3 AND {method} = 1 THEN CASE WHEN k % 3 = 0 THEN 'AES256' ELSE 'SHA256' END END AS p_algorithm,
      CASE WHEN d = 4 THEN {shift} % 3 <> 0 END AS training, CASE WHEN d = 4 THEN k % 4 <> 0 END AS tuning,
      CASE WHEN d = 4 THEN k % 5 <> 0 END AS rag,
      CASE WHEN d = 4 THEN CASE WHEN k % 4 = 1 THEN 'Credit ' || source ELSE '' END END AS credit
    FROM {keys}"""


def v_obligations(d: Dialect) -> str:
    return _obligations("v_obligation_keys", halve=False)


def v_obligations_v2(d: Dialect) -> str:
    """Even durations halved, some lists, methods and flags changed, some contracts gone and some new."""
    keys = """(SELECT * FROM v_obligation_keys WHERE NOT (src = 's' AND k % 50 = 49)
      UNION ALL SELECT project_id, 'ob-x' || k, 10000000000 + k, k, d, source, src FROM v_obligation_keys WHERE src = 's' AND k % 50 = 48) x"""
    return _obligations(keys, halve=True)


def v_requests(d: Dialect) -> str:
    region_key = case_of("event_id % 6", *quoted("region", "Region", "GEO"), "NULL", *quoted("country", "location"))
    region = case_of("event_id % 6", *quoted("de", "US", "fr"), "NULL", *quoted("CN", "JP"))
    purpose_key = case_of("event_id % 5", *quoted("purpose", "Intent"), "NULL", *quoted("usage", "purpose"))
    purpose = case_of("event_id % 5", *quoted("analytics", "marketing"), "NULL", *quoted("FINANCE", "SALES"))
    made = d.iso_days_before("ts", "value")
    # Dates: none, zoned, zone-less under another key, unreadable.
    return f"""
    SELECT event_id AS request_id, {project_of('pk')} AS project_id,
      CASE WHEN event_id % 50 = 0 THEN 'urn:unknown:' || event_id ELSE {urn_of('pk')} END AS resource_urn,
      CASE event_type WHEN 'view' THEN 'rag_query' WHEN 'click' THEN 'Fine_Tune' WHEN 'purchase' THEN 'ai_train'
           WHEN 'signup' THEN 'read' ELSE 'export' END AS action,
      'user_' || user_id AS actor_id,
      {region_key} AS region_key, {region} AS region, {purpose_key} AS purpose_key, {purpose} AS purpose,
      CASE WHEN event_id % 7 = 0 THEN 'output_format' WHEN event_id % 7 = 1 THEN 'mode' END AS format_key,
      CASE WHEN event_id % 7 = 0 THEN ' RAW ' WHEN event_id % 7 = 1 THEN 'decrypt' END AS format,
      CASE event_id % 4 WHEN 1 THEN 'created_at' WHEN 2 THEN 'date' WHEN 3 THEN 'created_at' END AS date_key,
      CASE event_id % 4 WHEN 1 THEN {made} || 'Z' WHEN 2 THEN {made} WHEN 3 THEN 'not-a-date' END AS date_text
    FROM (SELECT *, (user_id * 7 + event_id) % (SELECT count(*) FROM part) AS pk FROM events) e"""


def v_audit_log(d: Dialect) -> str:
    reason = case_of("event_id % 7", "NULL", *quoted("geo", "purpose", "ai", "retention", "privacy", "lineage"))
    return f"""
    SELECT CAST(event_id AS STRING) AS id, 'p' || (user_id % 3) AS project_id, ts AS timestamp_, 'user_' || user_id AS actor_id,
      {urn_of('event_id % 100')} AS resource_urn, event_type AS action,
      CASE WHEN event_id % 97 = 0 THEN 'UNSPECIFIED' WHEN event_type = 'error' THEN 'DENY' ELSE 'ALLOW' END AS decision,
      {reason} AS reason, CASE WHEN event_id % 3 = 0 THEN 'ob-n' || (event_id % 25) || '-0' END AS obligation_id,
      event_id % 2 = 0 AS cache_hit, props AS request_context, event_id
    FROM events"""


def v_lineage_events(d: Dialect) -> str:
    """One (input, output) per row: supplier -> part -> order -> customer model."""
    return """
    SELECT 'p' || (l_orderkey % 3) AS project_id, 'run-' || l_orderkey AS external_run_id,
           'urn:part:' || l_partkey AS source_urn, 'urn:order:' || l_orderkey AS target_urn FROM lineitem
    UNION ALL
    SELECT 'p' || (l_orderkey % 3), 'run-' || l_orderkey, 'urn:supplier:' || l_suppkey, 'urn:part:' || l_partkey FROM lineitem
    UNION ALL
    SELECT 'p' || (o_orderkey % 3), 'run-' || o_orderkey, 'urn:order:' || o_orderkey, 'urn:model:customer:' || o_custkey FROM orders
    UNION ALL
    SELECT 'p' || (o_orderkey % 3), 'ghost-' || o_orderkey, 'urn:order:' || o_orderkey, 'urn:lost:' || o_custkey
    FROM orders WHERE o_orderkey % 10 = 0"""


def v_run_signals(d: Dialect) -> str:
    kind = case_of("o_orderkey % 6", *quoted("UNSPECIFIED", "ETL_TRANSFORM", "AI_TRAINING", "AI_FINE_TUNING", "AI_RAG_QUERY", "HUMAN_DOWNLOAD"))
    return f"""
    SELECT 'p' || (o_orderkey % 3) AS project_id, 'run-' || o_orderkey AS external_run_id, CAST(o_orderkey * 10 AS BIGINT) AS seq,
      o_orderdate AS received_at, {kind} AS run_type,
      CASE WHEN o_orderkey % 9 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE CAST(o_orderdate AS TIMESTAMP) END AS started_at,
      CAST(NULL AS TIMESTAMP) AS ended_at, CAST(NULL AS BOOLEAN) AS success,
      CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'clerk_' || (o_custkey % 50) END AS triggered_by FROM orders
    UNION ALL
    SELECT 'p' || (o_orderkey % 3), 'run-' || o_orderkey, CAST(o_orderkey * 10 + 1 AS BIGINT), o_orderdate,
      CASE WHEN o_orderkey % 4 = 0 THEN 'AI_TRAINING' ELSE 'UNSPECIFIED' END,
      CASE WHEN o_orderkey % 8 = 1 THEN CAST({d.hours_before('o_orderdate', '5')} AS TIMESTAMP) END,
      CAST({d.hours_before('o_orderdate', '-3')} AS TIMESTAMP), o_orderkey % 11 <> 0, 'late' FROM orders WHERE o_orderkey % 5 <> 0"""


def v_lineage_resources(d: Dialect) -> str:
    rows = [
        f"SELECT 'p{p}' AS project_id, 'urn:part:' || p_partkey AS urn, 'warehouse' AS platform, p_name AS name, "
        "CAST(p_size % 5 AS INT) AS sensitivity, CAST(p_partkey % 4 AS INT) AS risk_level, p_partkey % 170 <> 0 AS ai_training_allowed, "
        "CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS tag_brand FROM part"
        for p in range(3)
    ] + [
        f"SELECT 'p{p}', 'urn:supplier:' || s_suppkey, 'vendor', '', CAST(s_suppkey % 3 AS INT), CAST(s_suppkey % 5 AS INT), s_suppkey % 40 <> 0, CAST(NULL AS VARCHAR(9)) FROM supplier"
        for p in range(3)
    ]
    return " UNION ALL ".join(rows)


def v_warehouse_lineage(d: Dialect) -> str:
    who = case_of("event_id % 4", "'user' || user_id || '@example.com'", "'a1-b2-' || user_id", "'System'", "NULL")
    kind = case_of("event_id % 3", *quoted("NOTEBOOK", "DASHBOARD_V3", "JOB"))
    return f"""
    SELECT CASE WHEN event_id % 23 = 0 THEN NULL ELSE 'Main.Raw.U' || user_id END AS source_table,
      CASE WHEN event_id % 29 = 0 THEN NULL ELSE 'main.mart.' || event_type END AS target_table,
      CASE WHEN event_id % 31 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE CAST(ts AS TIMESTAMP) END AS event_time,
      {who} AS created_by, {kind} AS entity_type, event_id FROM events"""


_COLUMNS = [
    ("email", "STRING"), ("region", "VARCHAR(10)"), ("ssn_last", "INT"), ("amount", "DECIMAL(10,2)"), ("note", "ARRAY<STRING>"), ("created_on", "TIMESTAMP_NTZ"),
]


def v_catalog_columns(d: Dialect) -> str:
    """Six columns per table, one table per part."""
    return " UNION ALL ".join(
        f"""SELECT CASE WHEN p_partkey % 40 = 39 THEN 'system' ELSE replace(p_brand, '#', '_') END AS catalog_,
        CASE WHEN p_partkey % 15 = 14 THEN '__tmp' ELSE {type_of('p_partkey')} END AS schema_, 'T' || p_partkey AS table_,
        CAST({i} AS BIGINT) AS position, '{name}' AS column_name, '{dtype}' AS type_, CASE WHEN p_partkey % 3 = {i % 3} THEN NULL ELSE 'c{i}' END AS comment_,
        CASE WHEN (p_partkey + {i}) % 19 = 0 THEN 'TRUE' WHEN (p_partkey + {i}) % 19 = 1 THEN 'false' END AS tag_sensitive,
        CASE WHEN (p_partkey + {i}) % 13 = 0 THEN 'name' END AS tag_pii,
        CASE WHEN (p_partkey + {i}) % 17 = 0 THEN 'true' END AS tag_rls,
        'owner_' || (p_partkey % 11) AS owner, p_partkey AS pk FROM part"""
        for i, (name, dtype) in enumerate(_COLUMNS)
    )


def v_table_tags(d: Dialect) -> str:
    name = """CASE WHEN p_partkey % 40 = 39 THEN 'system' ELSE replace(p_brand, '#', '_') END AS catalog_,
        CASE WHEN p_partkey % 15 = 14 THEN '__tmp' ELSE """ + type_of("p_partkey") + """ END AS schema_, 'T' || p_partkey AS table_"""
    return f"""
    SELECT {name}, 'env' AS key_, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'prod' ELSE 'dev' END AS value_, p_partkey AS pk FROM part
    UNION ALL SELECT {name}, 'governance.row_filter_column', CASE WHEN p_partkey % 2 = 0 THEN 'amount' ELSE 'absent' END, p_partkey FROM part WHERE p_partkey % 6 = 0"""


def v_elements(d: Dialect) -> str:
    return f"""
    SELECT doc_id, pos, CASE WHEN pos % 6 = 0 THEN 'Title' WHEN pos % 11 = 10 THEN 'Table' WHEN pos % 13 = 12 THEN 'Header' ELSE 'NarrativeText' END AS kind,
      CASE WHEN pos % 6 = 0 AND doc_id % 9 = 4 THEN 'Definitions ' || line ELSE line END AS text,
      {d.int_div('pos', 4)} + 1 AS page
    FROM ({d.lines('documents', 'doc_id', 'text')}) x"""


def v_constraints(d: Dialect) -> str:
    """Two extracted constraints per document; labels add mapped regulations."""
    subject = case_of(
        "doc_id % 9",
        *quoted("Personal Data of EEA users", "payment records", "Patient files", "usage logs", "Confidential material",
                "Source code (all branches), builds and", "graphics assets", "European staff", "Personal Data of EEA users "),
    )
    # Sixty characters from anywhere in the text.
    quote = "substr(text, CAST(x.doc_id * 7919 % greatest(length(text) - 60, 1) + 1 AS INT), 60)"
    rows = []
    for i in range(2):
        rows.append(f"""
        SELECT x.doc_id, CAST(x.doc_id * 2 + {i} AS BIGINT) AS ord, source || '.pdf' AS filename,
          {case_of(f'(x.doc_id + {i}) % 3', *quoted('RETENTION', 'PRIVACY', 'AI_RESTRICTION'))} AS category, {subject.replace('doc_id', 'x.doc_id')} AS subject,
          'Reason ' || (x.doc_id % 4) AS rationale, CASE WHEN x.doc_id % 5 = 0 THEN NULL ELSE 'Section ' || (x.doc_id % 5) END AS section,
          CASE WHEN coalesce(quality, 0) = 1 AND x.doc_id % 6 = 0 THEN 'REG-' || (x.doc_id % 2) || '::Art. ' || (x.doc_id % 3) END AS mapped_regulation_id,
          CASE WHEN (x.doc_id + {i}) % 3 = 0 THEN CAST((x.doc_id % 3) * 86400 AS BIGINT) END AS retention_s,
          CASE WHEN (x.doc_id + {i}) % 3 = 0 THEN '{{"duration":' || (x.doc_id % 3) || '}}' ELSE '{{"level":' || (x.doc_id % 2) || '}}' END AS rule_json,
          CASE WHEN x.doc_id % 2 = 1 THEN '"' || {quote} || '"' ELSE reverse({quote}) END AS quote, text
        FROM documents x LEFT JOIN labels l ON x.doc_id = l.doc_id""")
    return " UNION ALL ".join(rows)


def v_passages(d: Dialect) -> str:
    """Chunk-like rows: one per whole line, some with quoted terms, with a section name."""
    six, text = d.int_div("pos", 6), "line"
    return f"""
    SELECT doc_id, pos AS start_pos, doc_id || '-' || pos AS chunk_id, {d.int_div('pos', 4)} + 1 AS page,
      CASE WHEN doc_id % 9 = 4 AND {six} = 1 THEN '1. Definitions' ELSE 'Part ' || {six} END AS section,
      CASE (doc_id + pos) % 7 WHEN 0 THEN '"Customer Data" and "Provider" ' || {text} WHEN 1 THEN {text} || ' shall mean it'
        WHEN 2 THEN 'A definition of ' || {text} ELSE {text} END AS content
    FROM ({d.lines('documents', 'doc_id', 'text')}) x"""


VIEWS = {name: fn for name, fn in list(globals().items()) if name.startswith("v_")}
_SPARK, _DUCK = Dialect("spark"), Dialect("duckdb")


def needed(text: str) -> list[str]:
    """Views a statement uses, dependencies first."""
    found: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\bv_\w+", sql):
            if name in VIEWS and name not in found:
                visit(VIEWS[name](_DUCK))
                if name not in found:
                    found.append(name)

    visit(text)
    return found


def oracle_text(body: str) -> str:
    """A self-contained DuckDB statement: the views it uses, then the body with its own WITH list."""
    body = body.strip()
    ctes = [f"{name} AS ({VIEWS[name](_DUCK)})" for name in needed(body)]
    if body.upper().startswith("WITH "):
        return "WITH RECURSIVE " + ",\n".join(ctes + [body[5:]])
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body


def spark_text(name: str) -> str:
    return VIEWS[name](_SPARK)
