"""Raw policy rows to typed obligations plus a quarantine table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark import fixed_values as fixed
from govspark.functions import duration_seconds, fuzzy_enum
from govspark.schemas import RAW_POLICY

_LIST = "array<string>"

# Domains in the order in which a root key is looked for; the nested `constraint` block comes last.
DOMAINS = ["retention", "geofencing", "purpose", "privacy", "ai_model"]
NESTED_TYPES = {
    "RETENTION": "retention",
    "GEOFENCING": "geofencing",
    "PURPOSE_RESTRICTION": "purpose",
    "PRIVACY_ENHANCEMENT": "privacy",
    "AI_MODEL_CONSTRAINT": "ai_model",
}


def _strings(value: Column) -> Column:
    return F.coalesce(value, F.array().cast(_LIST))


def _flag(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def normalize_obligations(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Parse one JSON policy per row. Bad rows become (…, reason) rejects; good rows load.

    Root keys win in the order retention, geofencing, purpose, privacy, ai_model, then the
    nested ``constraint`` block. All columns of ``raw`` other than ``body`` are carried along.
    """
    carried = [c for c in raw.columns if c != body]
    parsed = raw.withColumn("_p", F.from_json(body, RAW_POLICY))
    nested = F.upper(F.col("_p.constraint.type"))
    domain = F.coalesce(
        *[F.when(F.col(f"_p.{d}").isNotNull(), F.lit(d)) for d in DOMAINS],
        *[F.when(nested == name, F.lit(d)) for name, d in NESTED_TYPES.items()],
    )
    chosen = F.coalesce(*[F.col(f"_p.{d}") for d in DOMAINS], F.col("_p.constraint"))
    parsed = parsed.withColumn("_domain", domain).withColumn("_b", chosen)

    level_text = F.coalesce(F.col("_p.enforcement_level"), F.lit("AUDIT_ONLY"))
    trigger_text = F.coalesce(F.col("_b.trigger"), F.lit("UNSPECIFIED"))
    method_text = F.coalesce(F.col("_b.method"), F.lit("UNSPECIFIED"))
    duration_text = F.coalesce(F.col("_b.duration"), F.lit("0d"))
    parsed = (
        parsed.withColumn("_level", fuzzy_enum(level_text, fixed.ENFORCEMENT_LEVEL))
        .withColumn("_trigger", fuzzy_enum(trigger_text, fixed.RETENTION_TRIGGER))
        .withColumn("_method", fuzzy_enum(method_text, fixed.PRIVACY_METHOD))
        .withColumn("_duration", duration_seconds(duration_text))
    )
    is_domain = lambda name: F.col("_domain") == name
    has_block = F.col("_b").isNotNull()
    no_body = F.coalesce(F.trim(F.col(body)), F.lit("")).isin("", "{}", "null")
    reason = (
        F.when(no_body, F.lit("empty definition"))
        .when(F.col("_p").isNull() | F.try_parse_json(F.col(body)).isNull(), F.lit("not a JSON object"))
        .when(F.col("_p.id").isNull() | F.col("_p.title").isNull(), F.lit("missing id or title"))
        .when(F.col("_p.provenance.source_id").isNull(), F.lit("missing provenance"))
        .when(~has_block, F.lit("missing constraint"))
        .when(F.col("_domain").isNull() & nested.isNull(), F.lit("constraint block has no type"))
        .when(F.col("_domain").isNull(), F.lit("unknown constraint type"))
        .when(F.col("_level").isNull(), F.lit("invalid enforcement level"))
        .when(is_domain("retention") & F.col("_duration").isNull(), F.lit("invalid duration"))
        .when(is_domain("retention") & F.col("_trigger").isNull(), F.lit("invalid trigger"))
        .when(is_domain("privacy") & F.col("_method").isNull(), F.lit("invalid method"))
    )
    parsed = parsed.withColumn("reason", reason)

    empty_map = F.map_from_arrays(F.array().cast(_LIST), F.array().cast(_LIST))
    columns = {
        "id": F.col("_p.id"),
        "title": F.col("_p.title"),
        "description": F.coalesce(F.col("_p.description"), F.lit("")),
        "provenance": F.col("_p.provenance"),
        "enforcement_level": F.col("_level"),
        "target": F.struct(
            _strings(F.col("_p.target.include_patterns")).alias("include_patterns"),
            _strings(F.col("_p.target.exclude_patterns")).alias("exclude_patterns"),
            F.coalesce(F.col("_p.target.match_tags"), empty_map).alias("match_tags"),
        ),
        "retention": F.when(
            is_domain("retention"),
            F.struct(
                F.col("_duration").alias("duration_s"),
                F.col("_trigger").alias("trigger"),
                _flag(F.col("_b.allow_legal_hold_override")).alias("allow_legal_hold_override"),
            ),
        ),
        "geofencing": F.when(
            is_domain("geofencing"),
            F.struct(
                _strings(F.col("_b.allowed_regions")).alias("allowed_regions"),
                _strings(F.col("_b.denied_regions")).alias("denied_regions"),
                _flag(F.col("_b.strict_residency")).alias("strict_residency"),
            ),
        ),
        "purpose": F.when(
            is_domain("purpose"),
            F.struct(
                _strings(F.col("_b.allowed_purposes")).alias("allowed_purposes"),
                _strings(F.col("_b.denied_purposes")).alias("denied_purposes"),
            ),
        ),
        "privacy": F.when(
            is_domain("privacy"),
            F.struct(
                F.col("_method").alias("method"),
                F.coalesce(F.col("_b.parameters"), empty_map).alias("parameters"),
            ),
        ),
        "ai_model": F.when(
            is_domain("ai_model"),
            F.struct(
                _flag(F.col("_b.training_allowed")).alias("training_allowed"),
                _flag(F.col("_b.fine_tuning_allowed")).alias("fine_tuning_allowed"),
                _flag(F.col("_b.rag_usage_allowed")).alias("rag_usage_allowed"),
                _flag(F.col("_b.requires_open_source_release")).alias("requires_open_source_release"),
                F.coalesce(F.col("_b.attribution_text_required"), F.lit("")).alias("attribution_text_required"),
            ),
        ),
    }
    good = parsed.filter(F.col("reason").isNull()).select(*carried, *[c.alias(n) for n, c in columns.items()])
    rejects = parsed.filter(F.col("reason").isNotNull()).select(*carried, body, "reason")
    return good, rejects
