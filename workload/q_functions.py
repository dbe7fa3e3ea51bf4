"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark import fixed_values as fixed
from govspark import functions as G
from govspark.sources.warehouse_lineage import actor_type, run_type
from workload.registry import query
from workload.tables import Tables
from workload.views import case_of, quoted

_GLOBS = ["urn:snow*", "urn:*:prod:?????:*", "*[0-4]", "*:1[!0-5]*", "urn:aws-s3:prod:[lm]*:*", "urn.*", "[*"]
_PATTERN = case_of(f"pk % {len(_GLOBS)}", *quoted(*_GLOBS))


@query("x1_glob", f"SELECT urn, {_PATTERN} AS pattern, urn GLOB {_PATTERN} AS hit FROM v_resources WHERE pk % 7 <> 6 UNION ALL SELECT urn, '[*', FALSE FROM v_resources WHERE pk % 7 = 6")
def x1_glob(t: Tables) -> DataFrame:
    rows = t.view("v_resources").selectExpr("urn", f"{_PATTERN} AS pattern")
    return rows.withColumn("hit", G.glob_match(F.col("urn"), F.col("pattern")))


@query("x2_segment_glob", """SELECT urn, urn LIKE 'urn:%' AND len(string_split(urn, ':')) = 5 AS five, string_split(urn, ':')[2] = 'snowflake' AND len(string_split(urn, ':')) = 4 AS four FROM v_resources""")
def x2_segment_glob(t: Tables) -> DataFrame:
    urn = F.col("urn")
    return t.view("v_resources").select(
        "urn",
        G.segment_glob_match(urn, F.lit("urn:*:*:*:*")).alias("five"),
        G.segment_glob_match(urn, F.lit("urn:snowflake:*:*")).alias("four"),
    )


_DURATION = case_of("o_orderkey % 7", "(o_orderkey % 900) || 'd'", "(o_orderkey % 50) || 'H'", "(o_orderkey % 12) || 'm'", "(o_orderkey % 9) || 'y'", "'10w'", "''", "'d7'")


@query("x3_duration", f"""SELECT o_orderkey, {_DURATION} AS text,
  CASE o_orderkey % 7 WHEN 0 THEN o_orderkey % 900 * 86400 WHEN 1 THEN o_orderkey % 50 * 3600 WHEN 2 THEN o_orderkey % 12 * 2592000 WHEN 3 THEN o_orderkey % 9 * 31536000 END AS seconds FROM orders""")
def x3_duration(t: Tables) -> DataFrame:
    rows = t.base("orders").selectExpr("o_orderkey", f"{_DURATION} AS text")
    return rows.withColumn("seconds", G.duration_seconds(F.col("text")))


_LEVELS = quoted("blocking", "2", "ENFORCEMENT_LEVEL_NOTIFY_HUMAN", "human", " Audit_Only ", "9", "nothing", "ONLY")


@query("x4_fuzzy_enum", f"SELECT o_orderkey, {case_of('o_orderkey % 8', *_LEVELS)} AS text, {case_of('o_orderkey % 8', '1', '2', '3', '3', '2', 'NULL', 'NULL', '2')} AS level FROM orders")
def x4_fuzzy_enum(t: Tables) -> DataFrame:
    rows = t.base("orders").selectExpr("o_orderkey", f"{case_of('o_orderkey % 8', *_LEVELS)} AS text")
    return rows.withColumn("level", G.fuzzy_enum(F.col("text"), fixed.ENFORCEMENT_LEVEL))


_UUID5 = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


@query("x5_uuid5", f"WITH h AS (SELECT urn, sha1(unhex('{fixed.UUID_NAMESPACE_DNS}') || encode(urn)) AS h FROM v_resources) SELECT urn, {_UUID5} AS id FROM h")
def x5_uuid5(t: Tables) -> DataFrame:
    return t.view("v_resources").select("urn", G.uuid5_dns(F.col("urn")).alias("id"))


# Warehouse type names with the Spark name each one gets.
_TYPES = {
    "varchar(20)": "STRING", "bigint": "BIGINT", "INT4": "INT", "NUMBER(38,0)": "DECIMAL(38,0)", "numeric": "DECIMAL", "float8": "DOUBLE", "real": "FLOAT",
    "boolean": "BOOLEAN", "timestamp without time zone": "TIMESTAMP_NTZ", "timestamp_ltz": "TIMESTAMP", "date": "DATE", "time": "STRING", "bytea": "TINYINT",
    "varbinary": "BINARY", "array<variant>": "ARRAY<STRING>", "map<variant,uuid>": "MAP<STRING,UUID>", "struct<a:uuid>": "STRUCT<A:UUID>", "json": "STRING",
    "array<string>": "STRING", "interval": "INT", "smallint": "SMALLINT", "geography": "GEOGRAPHY",
}
_TYPE_IN = case_of(f"p_partkey % {len(_TYPES)}", *quoted(*_TYPES))
_TYPE_OUT = case_of(f"p_partkey % {len(_TYPES)}", *quoted(*_TYPES.values()))


@query("x6_type_names", f"SELECT p_partkey, {_TYPE_IN} AS type_name, {_TYPE_OUT} AS spark_type FROM part")
def x6_type_names(t: Tables) -> DataFrame:
    rows = t.base("part").selectExpr("p_partkey", f"{_TYPE_IN} AS type_name")
    return rows.withColumn("spark_type", G.normalize_type("type_name"))


@query("x7_content_hash", "SELECT event_id, 'gov:v1:' || substr(sha256(props), 1, 8) AS marker FROM (SELECT event_id, replace(props, ' ', '') AS props FROM events)")
def x7_content_hash(t: Tables) -> DataFrame:
    return t.base("events").select("event_id", G.content_hash(G.canonical_json_text(F.col("props"))).alias("marker"))


_HOST = case_of("pk % 4", "'https://ws-' || pk || '.cloud.example.com/'", "'ws-' || pk || '.example.com:443'", "'http://host' || pk || ':8080/a.b'", "'plain' || pk")


@query("x8_urns", f"""SELECT urn, string_split(urn, ':')[-1] AS last_part, string_split(urn, ':')[3] AS third, 'unknown' AS ninth, {_HOST} AS host,
  CASE pk % 4 WHEN 0 THEN 'ws-' || pk WHEN 1 THEN 'ws-' || pk WHEN 2 THEN 'host' || pk ELSE 'plain' || pk END AS workspace FROM v_resources""")
def x8_urns(t: Tables) -> DataFrame:
    urn = F.col("urn")
    return t.view("v_resources").select(
        "urn", G.urn_last(urn).alias("last_part"), G.urn_segment(urn, 2).alias("third"), G.urn_segment(urn, 9).alias("ninth"), F.expr(_HOST).alias("host")
    ).withColumn("workspace", G.workspace_id(F.col("host")))


@query("x9_actor_types", """SELECT event_id, CASE WHEN created_by NOT LIKE '%@%' AND created_by LIKE '%-%' THEN 2 WHEN created_by = 'System' THEN 3 ELSE 1 END AS actor_type,
  CASE WHEN entity_type LIKE '%DASHBOARD%' OR entity_type LIKE '%QUERY%' THEN 'HUMAN_DOWNLOAD' ELSE 'ETL_TRANSFORM' END AS run_type FROM v_warehouse_lineage""")
def x9_actor_types(t: Tables) -> DataFrame:
    return t.view("v_warehouse_lineage").select(
        "event_id", actor_type(F.coalesce("created_by", F.lit("unknown"))).alias("actor_type"), run_type(F.col("entity_type")).alias("run_type")
    )


@query("x10_age", """SELECT o_orderkey, (epoch_us(TIMESTAMP '2001-08-01') - epoch_us(o_orderdate)) / 86400000000.0 AS age_days,
  (epoch_us(TIMESTAMP '2001-08-01') - epoch_us(o_orderdate)) / 1000000 > o_custkey * 86400 AS expired FROM orders""")
def x10_age(t: Tables) -> DataFrame:
    now, made = F.lit("2001-08-01 00:00:00").cast("timestamp"), F.col("o_orderdate")
    return t.base("orders").select(
        "o_orderkey", G.age_days(made, now).alias("age_days"), G.is_expired(made, F.col("o_custkey") * 86400, now).alias("expired")
    )


@query("x11_business_hours", "SELECT event_id, isodow(ts) BETWEEN 1 AND 5 AND hour(ts) BETWEEN 9 AND 16 AS open FROM events")
def x11_business_hours(t: Tables) -> DataFrame:
    return t.base("events").select("event_id", G.is_business_hours(F.col("ts")).alias("open"))


_ROLES = case_of("event_id % 4", *quoted("ADMIN,VIEWER", "VIEWER", "EDITOR,OWNER,VIEWER", "OWNER"))
_NEED = case_of("user_id % 3", *quoted("VIEWER", "ADMIN,VIEWER", "OWNER,EDITOR"))


@query("x12_set_tests", f"""SELECT event_id, list_has_any(string_split({_ROLES}, ','), string_split({_NEED}, ',')) AS some_role,
  list_has_all(string_split({_ROLES}, ','), string_split({_NEED}, ',')) AS every_role FROM events""")
def x12_set_tests(t: Tables) -> DataFrame:
    have, need = F.split(F.expr(_ROLES), ","), F.split(F.expr(_NEED), ",")
    return t.base("events").select("event_id", G.has_any(have, need).alias("some_role"), G.has_all(have, need).alias("every_role"))


_IP = "(event_id % 3 * 5 + 10) || '.' || (user_id % 256) || '.' || (event_id % 256) || '.' || (user_id * 7 % 300)"


@query("x13_cidr", f"""SELECT event_id, {_IP} AS ip, user_id * 7 % 300 < 256 AND ((event_id % 3 = 0 AND user_id % 256 < 128) OR (event_id % 3 = 1 AND user_id % 256 = 7 AND event_id % 256 = 9)
  OR (event_id % 3 = 2 AND user_id % 256 = 1 AND event_id % 256 = 2 AND user_id * 7 % 300 = 7)) AS inside FROM events""")
def x13_cidr(t: Tables) -> DataFrame:
    blocks = F.array(F.lit("10.0.0.0/9"), F.lit("15.7.9.0/24"), F.lit("20.1.2.7"))
    return t.base("events").selectExpr("event_id", f"{_IP} AS ip").withColumn("inside", G.ip_in_cidrs(F.col("ip"), blocks))


_IP6 = f"CASE event_id % 2 WHEN 0 THEN '::ffff:' ELSE '64:ff9b::' END || {_IP}"


@query("x13_cidr_dotted", f"""SELECT event_id, {_IP6} AS ip, user_id * 7 % 300 < 256 AND ((event_id % 2 = 0 AND event_id % 3 = 0 AND user_id % 256 < 128)
  OR (event_id % 2 = 0 AND event_id % 3 = 1 AND user_id % 256 = 7) OR (event_id % 2 = 1 AND event_id % 3 = 2 AND user_id % 256 < 64)) AS inside FROM events""")
def x13_cidr_dotted(t: Tables) -> DataFrame:
    """IPv6 addresses that end like IPv4 ones, half of them mapped IPv4 addresses."""
    blocks = F.array(F.lit("10.0.0.0/9"), F.lit("::ffff:15.7.0.0/112"), F.lit("64:ff9b::20.0.0.0/106"))
    return t.base("events").selectExpr("event_id", f"{_IP6} AS ip").withColumn("inside", G.ip_in_cidrs(F.col("ip"), blocks))


_REGION = case_of("c_custkey % 6", *quoted("DE", "US", "fr", "HR", "GB"), "NULL")


@query("x14_eu_region", f"SELECT c_custkey, coalesce({_REGION} IN ({', '.join(quoted(*fixed.EU_REGIONS))}), FALSE) AS in_eu FROM customer")
def x14_eu_region(t: Tables) -> DataFrame:
    return t.base("customer").select("c_custkey", G.is_eu_region(F.expr(_REGION)).alias("in_eu"))


_LOOSE = """'{ "z" : ' || p_size || ', "a": {"y": "' || p_name || '", "b": [1, {"q": null, "c": true}]} }'"""


@query("x15_canonical_json", f"""SELECT p_partkey, '{{"a":{{"b":[1,{{"c":true,"q":null}}],"y":"' || p_name || '"}},"z":' || p_size || '}}' AS canonical FROM part""")
def x15_canonical_json(t: Tables) -> DataFrame:
    return t.base("part").selectExpr("p_partkey", f"{_LOOSE} AS doc").select("p_partkey", G.canonical_json_text(F.col("doc")).alias("canonical"))


@query("x16_json_text", """SELECT urn, json_extract_string(attributes, '$.owner') AS owner, json_extract_string(attributes, '$.tags.env') AS env,
  json_extract_string(attributes, '$.absent') AS absent FROM v_resources_raw""")
def x16_json_text(t: Tables) -> DataFrame:
    doc = F.col("attributes")
    return t.view("v_resources_raw").select(
        "urn", G.json_text(doc, "$.owner").alias("owner"), G.json_text(doc, "$.tags.env").alias("env"), G.json_text(doc, "$.absent").alias("absent")
    )
