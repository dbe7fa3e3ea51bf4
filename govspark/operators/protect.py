"""Masks, row filters and retention applied to data tables."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType
from pyspark.sql import types as T

from govspark import fixed_values as fixed
from govspark.functions import age_seconds

MASK_KEYS = {
    fixed.PRIVACY_METHOD["PSEUDONYMIZATION"]: "HASH",
    fixed.PRIVACY_METHOD["ANONYMIZATION"]: "FULL",
    fixed.PRIVACY_METHOD["DIFFERENTIAL_PRIVACY"]: "NOISE_INT",
}


def method_key(method: int) -> str:
    """Mask of a privacy method; methods without one of their own are masked in full."""
    return MASK_KEYS.get(method, "FULL")


def method_key_column(method: Column) -> Column:
    key: Column = F.lit("FULL")
    for number, name in MASK_KEYS.items():
        key = F.when(method == number, F.lit(name)).otherwise(key)
    return key


def masked(value: Column, dtype: T.DataType, method: str, noise: Column | None = None) -> Column:
    """Masked form of a value of the given type; an unknown method gives null."""
    text, number = isinstance(dtype, T.StringType), isinstance(dtype, T.NumericType)
    null = F.lit(None).cast(dtype)
    if method == "FULL":
        if text:
            return F.lit("**********")
        if isinstance(dtype, T.DateType):
            return F.lit("1970-01-01").cast(dtype)
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return F.lit("1970-01-01 00:00:00").cast(dtype)
        return null
    if method == "HASH":
        return F.sha2(value, 256) if text else null
    if method == "PARTIAL_EMAIL":
        return F.regexp_replace(value, r"(^.).*@(.*$)", "$1****@$2") if text else null
    if method == "PARTIAL_SSN":
        return F.concat(F.lit("***-**-"), F.right(value, F.lit(4))) if text else null
    if method == "NOISE_INT":
        if not number:
            return value
        draw = noise if noise is not None else F.rand()
        return (value + (draw * 10 - 5).cast(dtype)).cast(dtype)
    return null


def repeatable_noise(key: Column, seed: int = 0) -> Column:
    """A draw in [0, 1) from the SHA-256 of seed and key alone: a retried task, or another engine, gives the same rows."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 7)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**7))


def is_member(caller_groups: list[str], allowed_groups: list[str], admins: list[str] = fixed.ADMIN_GROUPS) -> bool:
    return bool(set(caller_groups) & (set(allowed_groups) | set(admins)))


def mask_column(
    df: DataFrame,
    column: str,
    method: str,
    allowed_groups: list[str],
    caller_groups: list[str],
    noise: Column | None = None,
    seed: int | None = None,
) -> DataFrame:
    """The column as the caller may see it. Membership is decided once, when the plan is built."""
    if is_member(caller_groups, allowed_groups):
        return df
    dtype = df.schema[column].dataType
    if noise is None and seed is not None:
        noise = F.rand(seed)
    return df.withColumn(column, masked(F.col(column), dtype, method, noise))


def row_filter(
    df: DataFrame,
    mode: str,
    caller_groups: list[str] | None = None,
    allowed: list[str] | None = None,
    denied: list[str] | None = None,
    column: str | None = None,
    mapping: dict[str, list[str]] | None = None,
    mapping_table: DataFrame | None = None,
    role: str | None = None,
    session_text: str | None = None,
    denied_tags: list[str] | None = None,
    compat: bool = False,
) -> DataFrame:
    """Rows the caller may see.

    ``case``: admins pass; a denied tag found in the lower-cased session text, then a denied role,
    blocks; an allowed role passes; everyone else sees nothing.
    ``mapping``: admins and allowed groups see all; others see rows whose value maps to one of their
    groups, unless they are denied. With ``compat`` the deny list instead admits whoever is not on it.
    ``mapping_table`` (value, group) replaces the dict when the mapping is large.
    """
    allowed, denied, caller = allowed or [], denied or [], set(caller_groups or [])
    if mode == "case":
        session = (session_text or "").lower()
        if role in fixed.ADMIN_ROLES:
            return df
        if any(tag.lower() in session for tag in denied_tags or []):
            return df.filter(F.lit(False))
        if role in [r.upper() for r in denied] or role not in [r.upper() for r in allowed]:
            return df.filter(F.lit(False))
        return df
    if mode != "mapping":
        raise ValueError(f"unknown row filter mode: {mode}")

    admin = bool(caller & set(fixed.ADMIN_GROUPS))
    is_denied = bool(caller & set(denied))
    sees_all = admin or bool(caller & set(allowed))
    if compat:
        sees_all = sees_all or (bool(denied) and not is_denied)
    elif is_denied and not admin:
        return df.filter(F.lit(False))
    if sees_all:
        return df
    if mapping_table is not None:
        mine = mapping_table.filter(F.col("group").isin(*sorted(caller))).select(F.col("value").alias(column)).distinct()
        return df.join(mine, column, "left_semi").select(*df.columns)
    values = sorted(v for v, groups in (mapping or {}).items() if caller & set(groups))
    return df.filter(F.col(column).isin(*values)) if values else df.filter(F.lit(False))


# --- finding columns ---------------------------------------------------------

SENSITIVE_TAG, PII_TAG, RLS_TAG = "governance.is_sensitive", "governance.pii_category", "governance.rls_key"
ROW_FILTER_TAG = "governance.row_filter_column"


def _tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def sensitive_columns(inventory: DataFrame) -> DataFrame:
    """Columns to mask, with the rule that found them: is_sensitive tag, pii tag, or the name.

    ``inventory`` has urn and columns array<struct<name, type, comment, tags>>; extra keys are kept.
    """
    keys = [c for c in ("project_id", "urn") if c in inventory.columns]
    column = inventory.select(*keys, F.explode("columns").alias("c"))
    name, tags = F.lower("c.name"), F.col("c.tags")
    by_name = F.lit(False)
    for part in fixed.PII_NAME_PARTS:
        by_name = by_name | name.contains(part)
    rule = (
        F.when(F.lower(_tag(tags, SENSITIVE_TAG)) == "true", F.lit("is_sensitive"))
        .when(_tag(tags, PII_TAG).isNotNull(), F.lit("pii_category"))
        .when(by_name, F.lit("name"))
    )
    return column.select(*keys, F.col("c.name").alias("column_name"), F.col("c.type").alias("type"), rule.alias("rule")).filter(
        F.col("rule").isNotNull()
    )


def rls_column(inventory: DataFrame, table_tag: str = ROW_FILTER_TAG) -> DataFrame:
    """The column that row filters use: named by a table tag, else tagged, else known by name.

    Decided inside the row: the columns of one table are one array.
    """
    keys = [c for c in ("project_id", "urn") if c in inventory.columns]
    columns = F.coalesce("columns", F.array().cast(inventory.schema["columns"].dataType))
    first = lambda test: F.get(F.filter(columns, test), F.lit(0))
    named = first(lambda c: c["name"] == _tag(F.col("tags"), table_tag))
    tagged = first(lambda c: F.lower(_tag(c["tags"], RLS_TAG)) == "true")
    known = first(lambda c: F.lower(c["name"]).isin(*fixed.RLS_COLUMN_NAMES))
    rule = F.when(named.isNotNull(), "table_tag").when(tagged.isNotNull(), "column_tag").when(known.isNotNull(), "name")
    chosen = F.coalesce(named, tagged, known)
    return inventory.select(
        *keys, chosen["name"].alias("column_name"), chosen["type"].alias("type"), rule.alias("rule")
    ).filter(F.col("rule").isNotNull())


# --- applying policies -------------------------------------------------------


def binding_plan(policies: DataFrame, inventory: DataFrame, groups: DataFrame, table_tag: str = ROW_FILTER_TAG) -> DataFrame:
    """Mask and filter bindings of every table that has a policy.

    One row per (urn, kind, column_name): masks where the policy has a privacy rule, a row filter where
    it has a purpose or region rule. ``groups`` is the output of ``resolve_groups``.
    """
    keys = ["project_id", "urn"]
    policy = policies.select(
        "project_id",
        F.col("resource_urn").alias("urn"),
        F.col("privacy.method").alias("method"),
        (F.col("purpose").isNotNull() | F.col("geofencing").isNotNull()).alias("filters"),
    )
    masks = sensitive_columns(inventory).join(policy.filter(F.col("method").isNotNull()), keys).select(
        *keys, F.lit("mask").alias("kind"), "column_name", "type", "rule", method_key_column(F.col("method")).alias("method_key")
    )
    filters = rls_column(inventory, table_tag).join(policy.filter("filters"), keys).select(
        *keys, F.lit("row_filter").alias("kind"), "column_name", "type", "rule", F.lit(None).cast("string").alias("method_key")
    )
    allowed = groups.select("project_id", F.col("resource_urn").alias("urn"), "groups")
    short = lambda c: F.substring(F.sha2(c, 256), 1, 8)
    slug = F.translate("type", "<>,", "___")
    return masks.unionByName(filters).join(allowed, keys, "left").withColumn(
        "function_name",
        F.when(F.col("kind") == "mask", F.concat(F.lit("mask_"), F.lower("method_key"), F.lit("_"), slug)).otherwise(
            F.concat(F.lit("rf_"), short(F.substring_index("urn", ":", -1)))
        ),
    )


def protect(
    df: DataFrame,
    masks: dict[str, str],
    allowed_groups: list[str],
    caller_groups: list[str],
    filter_column: str | None = None,
    mapping: dict[str, list[str]] | None = None,
    denied_groups: list[str] | None = None,
    noise: Column | None = None,
) -> DataFrame:
    """A table as the caller may see it: filtered first, on the raw value, then masked."""
    out = df
    if filter_column is not None:
        out = row_filter(
            out, "mapping", caller_groups, allowed=allowed_groups, denied=denied_groups, column=filter_column, mapping=mapping
        )
    for column, method in masks.items():
        out = mask_column(out, column, method, allowed_groups, caller_groups, noise=noise)
    return out


def retention_sweep(
    df: DataFrame,
    ts_col: str,
    as_of: datetime,
    duration_s: int | Column | None = None,
    is_indefinite: bool | Column = False,
) -> tuple[DataFrame, DataFrame]:
    """(expired, kept). Rows without a date are kept, and so is everything under an indefinite hold.

    A fixed duration turns into one comparison of the raw column with a constant, which the scan can
    push down; a Column gives each row its own limit.
    """
    if isinstance(duration_s, Column) or isinstance(is_indefinite, Column):
        hold = is_indefinite if isinstance(is_indefinite, Column) else F.lit(is_indefinite)
        limit = duration_s if isinstance(duration_s, Column) else F.lit(duration_s)
        gone = (age_seconds(F.col(ts_col), F.lit(as_of)) > limit) & ~F.coalesce(hold, F.lit(False))
        gone = F.coalesce(gone, F.lit(False))
        return df.filter(gone), df.filter(~gone)
    if is_indefinite or duration_s is None:
        return df.filter(F.lit(False)), df
    limit = as_of - timedelta(seconds=duration_s)
    kind = df.schema[ts_col].dataType
    if isinstance(kind, DateType):
        # A date is its midnight: it lies before the limit up to and including the limit's own day, unless that is midnight.
        limit = limit.date() + timedelta(days=limit.time() != time.min)
    cutoff = F.lit(limit).cast(kind)
    return df.filter(F.col(ts_col) < cutoff), df.filter(F.col(ts_col).isNull() | (F.col(ts_col) >= cutoff))
