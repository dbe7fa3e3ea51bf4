"""Masks, filters, bindings and retention on data tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.operators import protect as P
from govspark.operators.match import resolve_groups
from workload.q_policies import DEFAULT_GROUPS, GROUPS, group_mapping, joined
from workload.registry import query
from workload.tables import Tables, sweep_as_of
from workload.views import SWEEP_AS_OF

_PEOPLE = """SELECT c_custkey, c_name, 'user' || c_custkey || '@mail' || (c_nationkey % 3) || '.example.com' AS email,
  '123-45-' || (1000 + c_custkey % 9000) AS ssn, c_acctbal, c_mktsegment FROM customer"""


def _people(t: Tables) -> DataFrame:
    t.base("customer")
    return t.spark.sql(_PEOPLE)


def _mask(t: Tables, methods: dict[str, str], caller: list[str] = ["interns"]) -> DataFrame:
    out = _people(t)
    for column, method in methods.items():
        out = P.mask_column(out, column, method, ["finance-team"], caller)
    return out


@query("e1_mask_full", "SELECT o_orderkey, '**********' AS o_orderpriority, CAST(NULL AS DOUBLE) AS o_totalprice, TIMESTAMP '1970-01-01' AS o_orderdate FROM orders")
def e1_mask_full(t: Tables) -> DataFrame:
    out = t.base("orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    for column in out.columns[1:]:
        out = P.mask_column(out, column, "FULL", [], [])
    return out


@query("e1_mask_member", f"SELECT * FROM ({_PEOPLE})")
def e1_mask_member(t: Tables) -> DataFrame:
    return _mask(t, {"c_name": "FULL", "ssn": "HASH"}, ["finance-team"])


@query("e2_mask_hash", f"SELECT c_custkey, sha256(c_name) AS c_name, email, ssn, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment FROM ({_PEOPLE})")
def e2_mask_hash(t: Tables) -> DataFrame:
    return _mask(t, {"c_name": "HASH", "c_acctbal": "HASH"})


@query("e3_mask_email", f"SELECT c_custkey, c_name, 'u****@mail' || (string_split(email, '@mail')[2]) AS email, ssn, c_acctbal, c_mktsegment FROM ({_PEOPLE})")
def e3_mask_email(t: Tables) -> DataFrame:
    return _mask(t, {"email": "PARTIAL_EMAIL"})


@query("e4_mask_ssn", f"SELECT c_custkey, c_name, email, '***-**-' || right(ssn, 4) AS ssn, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment FROM ({_PEOPLE})")
def e4_mask_ssn(t: Tables) -> DataFrame:
    return _mask(t, {"ssn": "PARTIAL_SSN", "c_acctbal": "PARTIAL_SSN"})


@query("e5_mask_noise", f"""SELECT c_custkey, c_name, email, ssn, c_acctbal + (CAST('0x' || substr(sha256('7:' || c_custkey), 1, 7) AS BIGINT) / 268435456.0::DOUBLE * 10 - 5) AS c_acctbal, c_mktsegment
FROM ({_PEOPLE})""")
def e5_mask_noise(t: Tables) -> DataFrame:
    people = _people(t)
    return P.mask_column(people, "c_acctbal", "NOISE_INT", [], [], noise=P.repeatable_noise(F.col("c_custkey"), seed=7))


@query("e7_role_filter_denied", f"SELECT * FROM ({_PEOPLE}) WHERE FALSE")
def e7_role_filter_denied(t: Tables) -> DataFrame:
    return P.row_filter(_people(t), "case", role="ANALYST", allowed=["analyst"], session_text='{"purpose": "Marketing"}', denied_tags=["MARKETING"])


@query("e7_role_filter_allowed", f"SELECT * FROM ({_PEOPLE})")
def e7_role_filter_allowed(t: Tables) -> DataFrame:
    return P.row_filter(_people(t), "case", role="ANALYST", allowed=["analyst"], denied=["INTERN"], session_text="etl", denied_tags=["MARKETING"])


_SEGMENTS = {"BUILDING": ["builders", "sales"], "MACHINERY": ["sales"], "HOUSEHOLD": ["home"]}


@query("e8_value_filter", f"SELECT * FROM ({_PEOPLE}) WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def e8_value_filter(t: Tables) -> DataFrame:
    return P.row_filter(_people(t), "mapping", ["sales"], allowed=["bosses"], denied=["interns"], column="c_mktsegment", mapping=_SEGMENTS)


@query("e8_value_filter_table", f"SELECT * FROM ({_PEOPLE}) WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')")
def e8_value_filter_table(t: Tables) -> DataFrame:
    rows = [(value, group) for value, groups in _SEGMENTS.items() for group in groups]
    mapping = t.spark.createDataFrame(rows, "value string, `group` string")
    return P.row_filter(_people(t), "mapping", ["builders", "home"], column="c_mktsegment", mapping_table=mapping)


@query("e8_value_filter_compat", f"SELECT * FROM ({_PEOPLE})")
def e8_value_filter_compat(t: Tables) -> DataFrame:
    return P.row_filter(_people(t), "mapping", ["strangers"], denied=["interns"], column="c_mktsegment", mapping=_SEGMENTS, compat=True)


_URN = "lower('urn:lake:ws1:' || catalog_ || '.' || schema_ || '.' || table_)"
_SENSITIVE = f"""SELECT {_URN} AS urn, column_name, type_ AS type, CASE WHEN lower(tag_sensitive) = 'true' THEN 'is_sensitive' WHEN tag_pii IS NOT NULL THEN 'pii_category' ELSE 'name' END AS rule
  FROM v_catalog_columns WHERE lower(tag_sensitive) = 'true' OR tag_pii IS NOT NULL OR column_name IN ('email', 'ssn_last')"""
_RLS = f"""SELECT urn, column_name, type, rule FROM (
  SELECT {_URN} AS urn, c.column_name, type_ AS type, CASE WHEN t.value_ = column_name THEN 'table_tag' WHEN tag_rls = 'true' THEN 'column_tag' WHEN column_name = 'region' THEN 'name' END AS rule,
    row_number() OVER (PARTITION BY c.pk ORDER BY CASE WHEN t.value_ = column_name THEN 0 WHEN tag_rls = 'true' THEN 1 WHEN column_name = 'region' THEN 2 ELSE 3 END, position) AS rn
  FROM v_catalog_columns c LEFT JOIN (SELECT pk, value_ FROM v_table_tags WHERE key_ = 'governance.row_filter_column') t USING (pk)) WHERE rn = 1 AND rule IS NOT NULL"""


@query("e9_sensitive_columns", _SENSITIVE)
def e9_sensitive_columns(t: Tables) -> DataFrame:
    return P.sensitive_columns(t.inventory())


@query("e10_rls_column", _RLS)
def e10_rls_column(t: Tables) -> DataFrame:
    return P.rls_column(t.inventory())


# Policies for the catalog tables, straight from their number.
_TABLE_POLICY = """SELECT p_partkey AS pk, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 5 END AS method, p_partkey % 3 <> 1 AS has_purpose, p_partkey % 5 = 0 AS has_geo, p_partkey % 2 = 0 AS marketing FROM part"""


def _table_policies(t: Tables) -> DataFrame:
    keys = t.view("v_table_tags").filter("key_ = 'env'").selectExpr("pk", f"{_URN} AS resource_urn")
    purposes = F.when(F.col("marketing"), F.array(F.lit("MARKETING"))).otherwise(F.array(F.lit("UNKNOWN"), F.lit("FINANCE")))
    t.base("part")
    return t.spark.sql(_TABLE_POLICY).join(keys, "pk").select(
        F.lit("p0").alias("project_id"), "resource_urn",
        F.when(F.col("method").isNotNull(), F.struct(F.col("method").cast("int").alias("method"))).alias("privacy"),
        F.when(F.col("has_purpose"), F.struct(purposes.alias("allowed_purposes"))).alias("purpose"),
        F.when(F.col("has_geo"), F.struct(F.lit(False).alias("is_global_ban"))).alias("geofencing"),
    )


def _group_text(purpose: str | None) -> str:
    return ",".join(sorted({*DEFAULT_GROUPS, *GROUPS.get(purpose, [])}))


_GROUPS = (
    f"CASE WHEN NOT has_purpose THEN '{_group_text(None)}' WHEN marketing THEN '{_group_text('MARKETING')}' ELSE '{_group_text('FINANCE')}' END"
)
_KEYED = f"SELECT {_URN} AS urn, p.* FROM (SELECT DISTINCT catalog_, schema_, table_, pk FROM v_table_tags) JOIN ({_TABLE_POLICY}) p USING (pk)"
_KEY = "CASE method WHEN 1 THEN 'HASH' WHEN 3 THEN 'NOISE_INT' ELSE 'FULL' END"


@query("e11_binding_plan", f"""WITH s AS ({_SENSITIVE}), r AS ({_RLS}), p AS ({_KEYED})
SELECT urn, 'mask' AS kind, column_name, type, rule, {_KEY} AS method_key, {_GROUPS} AS groups_, 'mask_' || lower({_KEY}) || '_' || translate(type, '<>,', '___') AS function_name
FROM s JOIN p USING (urn) WHERE method IS NOT NULL UNION ALL
SELECT urn, 'row_filter', column_name, type, rule, NULL, {_GROUPS}, 'rf_' || substr(sha256(string_split(urn, ':')[-1]), 1, 8) FROM r JOIN p USING (urn) WHERE has_purpose OR has_geo""")
def e11_binding_plan(t: Tables) -> DataFrame:
    policies = _table_policies(t)
    groups = resolve_groups(policies, group_mapping(t), DEFAULT_GROUPS)
    inventory = t.inventory().withColumn("project_id", F.lit("p0"))
    plan = P.binding_plan(policies, inventory, groups)
    return plan.withColumn("groups_", joined("groups")).drop("groups", "project_id")


@query("e11_protected_table", f"""SELECT c_custkey, sha256(c_name) AS c_name, 'u****@mail' || (string_split(email, '@mail')[2]) AS email, '**********' AS ssn, c_acctbal, c_mktsegment
FROM ({_PEOPLE}) WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def e11_protected_table(t: Tables) -> DataFrame:
    masks = {"c_name": "HASH", "email": "PARTIAL_EMAIL", "ssn": "FULL"}
    return P.protect(_people(t), masks, ["bosses"], ["sales"], "c_mktsegment", _SEGMENTS)


_AGE = f"(epoch_us(TIMESTAMP '{SWEEP_AS_OF}') - epoch_us(o_orderdate)) / 1000000"
_TWO_YEARS = 730 * 86400


@query("e12_retention_sweep", f"SELECT 'expired' AS side, o_orderkey FROM orders WHERE {_AGE} > {_TWO_YEARS} UNION ALL SELECT 'kept', o_orderkey FROM orders WHERE {_AGE} <= {_TWO_YEARS}")
def e12_retention_sweep(t: Tables) -> DataFrame:
    expired, kept = P.retention_sweep(t.base("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", sweep_as_of(), _TWO_YEARS)
    side = lambda df, name: df.select(F.lit(name).alias("side"), "o_orderkey")
    return side(expired, "expired").unionByName(side(kept, "kept"))


@query("e12_retention_sweep_per_row", f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 0 AND {_AGE} > (o_custkey % 900) * 86400")
def e12_retention_sweep_per_row(t: Tables) -> DataFrame:
    orders = t.base("orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("o_orderdate")
    )
    expired, _ = P.retention_sweep(orders, "o_orderdate", sweep_as_of(), (F.col("o_custkey") % 900) * 86400, F.col("o_orderkey") % 13 == 0)
    return expired.drop("o_custkey")
