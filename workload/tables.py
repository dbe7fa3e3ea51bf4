"""The governance tables as Spark DataFrames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark import fixed_values as fixed
from govspark.session import configure
from workload.views import AS_OF, SWEEP_AS_OF, VIEWS, needed, spark_text

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
_TEXTS = "array<string>"


def as_of() -> datetime:
    return datetime.fromisoformat(AS_OF)


def sweep_as_of() -> datetime:
    return datetime.fromisoformat(SWEEP_AS_OF)


def csv(column: str) -> Column:
    """Comma-separated text to an array; empty or null text is an empty array."""
    text = F.coalesce(F.col(column), F.lit(""))
    return F.when(text == "", F.array().cast(_TEXTS)).otherwise(F.split(text, ","))


def present_map(pairs: dict[str, Column]) -> Column:
    """Map of the entries whose value, a text, is not null. Lists joined, not filtered: that is compiled, a filter's lambda is not."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = [F.when(v.isNotNull(), F.array(F.struct(F.lit(k).alias("key"), v.alias("value")))).otherwise(none) for k, v in pairs.items()]
    return F.map_from_entries(F.concat(*entries))


class Tables:
    """Lazily built tables over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._seen = configure(spark), sf_dir.rstrip("/"), {}

    def base(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            self._seen[name].createOrReplaceTempView(name)
        return self._seen[name]

    def view(self, name: str) -> DataFrame:
        for view in needed(name):
            if view not in self._seen:
                text = spark_text(view)
                for base in BASE:
                    if base in text:
                        self.base(base)
                self._seen[view] = self.spark.sql(text)
                self._seen[view].createOrReplaceTempView(view)
        return self._seen[name]

    # --- governance shapes ---------------------------------------------------

    def resources(self) -> DataFrame:
        tags = present_map(
            {"brand": F.col("brand"), "type": F.col("type_tag"), "env": F.col("env"), "vendor": F.col("vendor")}
        )
        resources = self.view("v_resources").select(
            "project_id", "urn", "platform", "name", tags.alias("tags"), "sensitivity", "risk_level", "ai_training_allowed", "owner"
        )
        return resources

    def obligations(self, version: str = "v_obligations") -> DataFrame:
        d = lambda n: F.col("d") == n
        includes = F.filter(F.array("include", "include2"), lambda p: p != "")
        return self.view(version).select(
            "project_id",
            "id",
            "ord",
            "title",
            F.lit("").alias("description"),
            F.struct(
                F.col("source_id"), F.lit("REGULATION").alias("document_type"), F.lit(None).cast("string").alias("section_reference"),
                F.lit(None).cast("string").alias("document_uri"),
            ).alias("provenance"),
            "enforcement_level",
            F.struct(
                includes.alias("include_patterns"),
                F.filter(F.array("exclude"), lambda p: p != "").alias("exclude_patterns"),
                present_map({"brand": F.col("req_brand"), "env": F.col("req_env"), "vendor": F.col("req_vendor")}).alias("match_tags"),
            ).alias("target"),
            "is_active",
            F.when(d(0), F.struct("duration_s", F.col("trigger_").alias("trigger"), F.lit(False).alias("allow_legal_hold_override"))).alias("retention"),
            F.when(d(1), F.struct(
                csv("allowed_regions").alias("allowed_regions"), csv("denied_regions").alias("denied_regions"), F.lit(False).alias("strict_residency"),
            )).alias("geofencing"),
            F.when(d(2), F.struct(csv("allowed_purposes").alias("allowed_purposes"), csv("denied_purposes").alias("denied_purposes"))).alias("purpose"),
            F.when(d(3), F.struct("method", present_map({
                "epsilon": F.col("p_epsilon"), "delta": F.col("p_delta"), "k": F.col("p_k"), "algorithm": F.col("p_algorithm"),
            }).alias("parameters"))).alias("privacy"),
            F.when(d(4), F.struct(
                F.col("training").alias("training_allowed"), F.col("tuning").alias("fine_tuning_allowed"), F.col("rag").alias("rag_usage_allowed"),
                F.lit(False).alias("requires_open_source_release"), F.col("credit").alias("attribution_text_required"),
            )).alias("ai_model"),
        )

    def requests(self) -> DataFrame:
        entries = F.array(*[
            F.struct(F.col(f"{p}_key").alias("key"), F.col(v).alias("value"))
            for p, v in (("region", "region"), ("purpose", "purpose"), ("format", "format"), ("date", "date_text"))
        ])
        context = F.map_from_entries(F.filter(entries, lambda e: e["key"].isNotNull()))
        return self.view("v_requests").select(
            "request_id", "project_id", "resource_urn", "action", "actor_id", context.alias("context")
        )

    def audit_log(self) -> DataFrame:
        """Ingest shape of the audit events."""
        trace = F.to_json(F.struct(
            F.col("reason").alias("decision_reason"), F.lit("h1").alias("resolved_policy_hash"), "cache_hit",
            F.filter(F.array(F.struct("obligation_id")), lambda p: p["obligation_id"].isNotNull()).alias("contributing_policies"),
        ))
        log = self.view("v_audit_log").select(
            "id", "project_id", F.col("timestamp_").cast("timestamp").alias("timestamp"), "actor_id", "resource_urn", "action",
            "decision", F.when(F.col("event_id") % 5 != 4, trace).alias("reason_trace"), "request_context",
        )
        return log

    def run_signals(self) -> DataFrame:
        signals = self.view("v_run_signals")
        return signals.select(*[
            F.col(c).cast("timestamp").alias(c) if c in ("received_at", "started_at", "ended_at") else F.col(c) for c in signals.columns
        ])

    def lineage_events(self) -> DataFrame:
        return self.view("v_lineage_events").select(
            "project_id", "external_run_id", F.array("source_urn").alias("inputs"), F.array("target_urn").alias("outputs")
        )

    def edges(self) -> DataFrame:
        return self.view("v_lineage_events").select("project_id", "external_run_id", "source_urn", "target_urn")

    def lineage_resources(self) -> DataFrame:
        return self.view("v_lineage_resources").withColumn("tags", present_map({"brand": F.col("tag_brand")})).drop("tag_brand")

    def inventory(self) -> DataFrame:
        from govspark.sources.inventory import build_inventory

        return build_inventory(self.catalog_columns(), self.table_tags(), "lake", "ws1")

    def catalog_columns(self) -> DataFrame:
        tags = present_map({
            "governance.is_sensitive": F.col("tag_sensitive"), "governance.pii_category": F.col("tag_pii"), "governance.rls_key": F.col("tag_rls"),
        })
        return self.view("v_catalog_columns").select(
            F.col("catalog_").alias("catalog"), F.col("schema_").alias("schema"), F.col("table_").alias("table"), "position",
            "column_name", F.col("type_").alias("type"), F.col("comment_").alias("comment"), tags.alias("tags"), "owner",
        )

    def table_tags(self) -> DataFrame:
        return self.view("v_table_tags").select(
            F.col("catalog_").alias("catalog"), F.col("schema_").alias("schema"), F.col("table_").alias("table"),
            F.col("key_").alias("key"), F.col("value_").alias("value"),
        )

    def elements(self) -> DataFrame:
        return self.view("v_elements")

    def constraints(self) -> DataFrame:
        return self.view("v_constraints")


__all__ = ["BASE", "Tables", "VIEWS", "as_of", "csv", "fixed", "present_map", "sweep_as_of"]
