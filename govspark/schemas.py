"""Logical table schemas. Open JSON stays a JSON string; nothing is inferred."""

from pyspark.sql import types as T

TEXT, LONG, INT, FLAG, TIME = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
TEXTS, TEXT_MAP = T.ArrayType(TEXT), T.MapType(TEXT, TEXT)


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


RETENTION_RULE = record(duration_s=LONG, trigger=INT, allow_legal_hold_override=FLAG)
GEOFENCING_RULE = record(allowed_regions=TEXTS, denied_regions=TEXTS, strict_residency=FLAG)
PURPOSE_RULE = record(allowed_purposes=TEXTS, denied_purposes=TEXTS)
PRIVACY_RULE = record(method=INT, parameters=TEXT_MAP)
AI_RULE = record(
    training_allowed=FLAG,
    fine_tuning_allowed=FLAG,
    rag_usage_allowed=FLAG,
    requires_open_source_release=FLAG,
    attribution_text_required=TEXT,
)
TARGET = record(include_patterns=TEXTS, exclude_patterns=TEXTS, match_tags=TEXT_MAP)
PROVENANCE = record(source_id=TEXT, document_type=TEXT, section_reference=TEXT, document_uri=TEXT)

OBLIGATIONS = record(
    project_id=TEXT,
    id=TEXT,
    ord=LONG,
    title=TEXT,
    description=TEXT,
    provenance=PROVENANCE,
    enforcement_level=INT,
    target=TARGET,
    is_active=FLAG,
    retention=RETENTION_RULE,
    geofencing=GEOFENCING_RULE,
    purpose=PURPOSE_RULE,
    privacy=PRIVACY_RULE,
    ai_model=AI_RULE,
)
RESOURCES = record(
    project_id=TEXT,
    urn=TEXT,
    platform=TEXT,
    name=TEXT,
    tags=TEXT_MAP,
    sensitivity=INT,
    risk_level=INT,
    ai_training_allowed=FLAG,
    owner=TEXT,
)
REQUESTS = record(request_id=LONG, project_id=TEXT, resource_urn=TEXT, action=TEXT, actor_id=TEXT, context=TEXT_MAP)
AUDIT_EVENT = record(
    id=TEXT,
    project_id=TEXT,
    timestamp=TIME,
    actor_id=TEXT,
    resource_urn=TEXT,
    action=TEXT,
    decision=TEXT,
    reason_trace=TEXT,
    request_context=TEXT,
)
RUN_SIGNAL = record(
    project_id=TEXT,
    external_run_id=TEXT,
    seq=LONG,
    received_at=TIME,
    run_type=TEXT,
    started_at=TIME,
    ended_at=TIME,
    success=FLAG,
    triggered_by=TEXT,
)
COLUMN_META = T.ArrayType(record(name=TEXT, type=TEXT, comment=TEXT, tags=TEXT_MAP))

# One flat shape covers every constraint block of a raw policy, root or nested.
CONSTRAINT_BLOCK = record(
    type=TEXT,
    duration=TEXT,
    trigger=TEXT,
    allow_legal_hold_override=FLAG,
    allowed_regions=TEXTS,
    denied_regions=TEXTS,
    strict_residency=FLAG,
    allowed_purposes=TEXTS,
    denied_purposes=TEXTS,
    method=TEXT,
    parameters=TEXT_MAP,
    training_allowed=FLAG,
    fine_tuning_allowed=FLAG,
    rag_usage_allowed=FLAG,
    requires_open_source_release=FLAG,
    attribution_text_required=TEXT,
)
RAW_POLICY = record(
    id=TEXT,
    title=TEXT,
    description=TEXT,
    enforcement_level=TEXT,
    provenance=PROVENANCE,
    target=TARGET,
    retention=CONSTRAINT_BLOCK,
    geofencing=CONSTRAINT_BLOCK,
    purpose=CONSTRAINT_BLOCK,
    privacy=CONSTRAINT_BLOCK,
    ai_model=CONSTRAINT_BLOCK,
    constraint=CONSTRAINT_BLOCK,
)
