"""Audit events: decode, canonicalise and append without duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark import fixed_values as fixed
from govspark.functions import canonical_json_text
from govspark.schemas import AUDIT_EVENT

_TRACE = (
    "decision_reason string, resolved_policy_hash string, cache_hit boolean, "
    "contributing_policies array<struct<obligation_id:string>>"
)
REQUIRED = ["id", "project_id", "timestamp", "actor_id", "resource_urn", "action"]


def parse_audit_stream(raw: DataFrame, value: str = "value") -> DataFrame:
    """Decode one JSON message per row and add ``status``: good, invalid or undecodable.

    Works on batch and streaming inputs. Undecodable messages can be dropped for good;
    decodable messages that miss a required field are kept apart for a retry.
    """
    decoded = raw.withColumn("_e", F.from_json(value, AUDIT_EVENT, {"mode": "PERMISSIVE"}))
    broken = F.try_parse_json(F.col(value)).isNull()
    missing = F.lit(False)
    for field in REQUIRED:
        missing = missing | F.col(f"_e.{field}").isNull()
    status = F.when(broken, "undecodable").when(missing, "invalid").otherwise("good")
    fields = [F.col(f"_e.{name}").alias(name) for name in AUDIT_EVENT.names]
    return decoded.select(*raw.columns, status.alias("status"), *fields)


def split_audit_stream(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good events, quarantined messages with their status)."""
    parsed = parse_audit_stream(raw, value)
    good = parsed.filter(F.col("status") == "good").drop(value, "status")
    bad = parsed.filter(F.col("status") != "good").select(value, "status")
    return good, bad


def canonicalize_audit(events: DataFrame) -> DataFrame:
    """Ingest shape to the canonical entry: decision ordinal, renamed trace, actor of unknown type."""
    name = F.upper(F.trim(F.col("decision")))
    decision = F.lit(fixed.DECISION["UNSPECIFIED"])
    for member, number in fixed.DECISION.items():
        decision = F.when(name == member, F.lit(number)).otherwise(decision)
    # A column of its own, so that the JSON is parsed once per row.
    events = events.withColumn("_trace", F.from_json("reason_trace", _TRACE))
    trace = F.col("_trace")
    return events.select(
        "id",
        "project_id",
        "timestamp",
        F.struct(
            F.col("actor_id").alias("id"),
            F.lit(fixed.ACTOR_TYPE["UNSPECIFIED"]).alias("type"),
            F.array().cast("array<string>").alias("roles"),
            F.from_json(F.lit("{}"), "map<string,string>").alias("attributes"),
        ).alias("actor"),
        "resource_urn",
        "action",
        decision.alias("decision"),
        F.when(
            trace.isNotNull(),
            F.struct(
                trace["decision_reason"].alias("reason_summary"),
                F.coalesce(
                    F.transform(trace["contributing_policies"], lambda policy: policy["obligation_id"]),
                    F.array().cast("array<string>"),
                ).alias("contributing_obligation_ids"),
                F.coalesce(trace["resolved_policy_hash"], F.lit("")).alias("policy_version_hash"),
                F.coalesce(trace["cache_hit"], F.lit(False)).alias("cache_hit"),
            ),
        ).alias("evaluation_trace"),
        F.coalesce(canonical_json_text(F.col("request_context")), F.lit("{}")).alias("request_context"),
    )


def first_per_id(batch: DataFrame) -> DataFrame:
    """One row per id: the one with the earliest timestamp, and of those the least by content, so reruns agree."""
    instant = F.col("timestamp") if "timestamp" in batch.columns else F.lit(None)
    least = F.min_by(F.struct(*batch.columns), F.struct(instant, F.to_json(F.struct(*batch.columns))))
    return batch.groupBy(F.col("id").alias("_id")).agg(least.alias("_row")).select("_row.*")


def append_audit(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch whose id is new, one per id; the rows to append."""
    return first_per_id(batch).join(existing.select("id"), "id", "left_anti")
