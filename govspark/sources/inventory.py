"""Inventory of data resources: normalise, build from column metadata, scope and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark import fixed_values as fixed
from govspark.functions import any_glob, enum_value, json_text
from govspark.schemas import COLUMN_META


def _ordinal(attributes: Column, field: str, table: dict[str, int]) -> Column:
    """Root attribute, or the same key under tags when the root is absent or UNSPECIFIED."""
    root = F.upper(json_text(attributes, f"$.{field}"))
    nested = F.upper(json_text(attributes, f"$.tags.{field}"))
    text = F.when(root.isNull() | root.isin("UNSPECIFIED", "0"), nested).otherwise(root)
    return enum_value(text, table)


def normalize_resources(raw: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Open JSON attributes to typed columns; other columns are kept."""
    doc = F.col(attributes)
    return raw.select(
        *[c for c in raw.columns if c != attributes],
        F.from_json(json_text(doc, "$.tags"), "map<string,string>").alias("tags"),
        _ordinal(doc, "sensitivity", fixed.SENSITIVITY).alias("sensitivity"),
        _ordinal(doc, "risk_level", fixed.RISK).alias("risk_level"),
        F.coalesce(json_text(doc, "$.ai_training_allowed") != "false", F.lit(True)).alias("ai_training_allowed"),
        json_text(doc, "$.owner").alias("owner"),
        F.from_json(json_text(doc, "$.columns"), COLUMN_META).alias("columns"),
        doc.alias(attributes),
    )


def _by_position(left: Column, right: Column) -> Column:
    return (left["position"] - right["position"]).cast("int")


def build_inventory(columns: DataFrame, table_tags: DataFrame, platform: str, workspace: str) -> DataFrame:
    """One resource per table from (catalog, schema, table, position, column_name, type, comment, tags, owner).

    ``table_tags`` holds (catalog, schema, table, key, value); null values are dropped.
    """
    keys = ["catalog", "schema", "table"]
    tags = F.map_filter("tags", lambda _, value: value.isNotNull())
    column = F.struct(
        F.col("position"),
        F.col("column_name").alias("name"),
        F.col("type"),
        F.col("comment"),
        F.when(F.size(tags) > 0, tags).alias("tags"),
    )
    tables = columns.groupBy(*keys).agg(
        F.max("owner").alias("owner"),
        F.array_sort(F.collect_list(column), _by_position).alias("columns"),
    )
    tables = tables.withColumn("columns", F.transform("columns", lambda c: c.dropFields("position")))
    tag_maps = (
        table_tags.filter(F.col("key").isNotNull() & F.col("value").isNotNull())
        .groupBy(*keys, "key")
        .agg(F.max("value").alias("value"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("tags"))
    )
    name = F.concat_ws(".", *keys)
    return tables.join(tag_maps, keys, "left").select(
        F.lower(F.concat(F.lit(f"urn:{platform}:{workspace}:"), name)).alias("urn"),
        F.lit(platform).alias("platform"),
        F.col("table").alias("name"),
        "owner",
        F.coalesce("tags", F.from_json(F.lit("{}"), "map<string,string>")).alias("tags"),
        F.struct("catalog", "schema").alias("hierarchy"),
        "columns",
    )


def scope_filter(df: DataFrame, column: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Keep rows whose value hits an include glob and no exclude glob."""
    value = F.col(column)
    return df.filter(~any_glob(value, exclude) & any_glob(value, include))


def upsert_resources(current: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """Latest row per (project_id, urn). An update overwrites name, attributes and time, not platform.

    ``batch`` carries ``seq``; inside the batch the highest seq wins, but the platform of a new
    resource is the one first seen.
    """
    keys = ["project_id", "urn"]
    latest = batch.groupBy(*keys).agg(
        F.min_by("platform", "seq").alias("new_platform"),
        F.max_by(F.struct("name", "attributes"), "seq").alias("new"),
    )
    return current.join(latest, keys, "full_outer").select(
        *keys,
        F.coalesce("platform", "new_platform").alias("platform"),
        F.when(F.col("new").isNotNull(), F.col("new.name")).otherwise(F.col("name")).alias("name"),
        F.when(F.col("new").isNotNull(), F.col("new.attributes")).otherwise(F.col("attributes")).alias("attributes"),
        F.when(F.col("new").isNotNull(), as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """All rows except those for which the condition is true."""
    return df.filter(~F.coalesce(condition, F.lit(False)))
