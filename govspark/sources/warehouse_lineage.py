"""Warehouse lineage rows to runs and events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark import fixed_values as fixed
from govspark.functions import iso_utc, uuid5_dns


def actor_type(actor: Column) -> Column:
    """Dashed ids without an @ are service accounts, `System` is internal, the rest are people."""
    service = ~actor.contains("@") & actor.contains("-")
    return (
        F.when(service, F.lit(fixed.ACTOR_TYPE["SERVICE_ACCOUNT"]))
        .when(actor == "System", F.lit(fixed.ACTOR_TYPE["SYSTEM_INTERNAL"]))
        .otherwise(F.lit(fixed.ACTOR_TYPE["HUMAN"]))
    )


def run_type(entity_type: Column) -> Column:
    kind = F.upper(F.coalesce(entity_type, F.lit("")))
    download = ~kind.contains("NOTEBOOK") & (kind.contains("DASHBOARD") | kind.contains("QUERY"))
    return F.when(download, F.lit("HUMAN_DOWNLOAD")).otherwise(F.lit("ETL_TRANSFORM"))


def extract_lineage(
    raw: DataFrame,
    as_of: datetime,
    platform: str,
    workspace: str,
    lookback_hours: int = 24,
    cap: int | None = None,
) -> DataFrame:
    """Rows inside the lookback as (run, event) rows, all of them, or the newest ``cap`` if that is given.

    Rows without a time are skipped. The run id is a function of source, target, time and user.
    """
    since = F.lit(as_of - timedelta(hours=lookback_hours)).cast("timestamp")
    rows = raw.filter(F.col("event_time").isNotNull() & (F.col("event_time") >= since))
    source = F.coalesce("source_table_full_name", F.lit("unknown"))
    target = F.coalesce("target_table_full_name", F.lit("unknown"))
    user = F.coalesce("created_by", F.lit("unknown"))
    urn = lambda table: F.lower(F.concat(F.lit(f"urn:{platform}:{workspace}:"), table))
    if cap is not None:
        rows = rows.orderBy(F.col("event_time").desc(), source, target, user).limit(cap)
    return rows.select(
        uuid5_dns(F.concat_ws("|", source, target, iso_utc(F.col("event_time")), user)).alias("external_run_id"),
        run_type(F.col("entity_type")).alias("run_type"),
        user.alias("triggered_by"),
        actor_type(user).alias("actor_type"),
        F.col("event_time").alias("started_at"),
        F.col("event_time").alias("ended_at"),
        F.lit(True).alias("success"),
        F.array(urn(source)).alias("inputs"),
        F.array(urn(target)).alias("outputs"),
    )
