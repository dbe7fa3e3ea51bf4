"""Resolved policies written out as bundles and cloud policy documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark import fixed_values as fixed
from govspark.functions import enum_name

_STRINGS = "array<string>"
# A resource is known by its urn inside its project.
_KEY = ["project_id", "resource_urn"]


def write_bundle(policies: DataFrame, path: str, project_name: str = "unknown", build: dict[str, str] | None = None) -> None:
    """One JSON document per project and resource, with nulls omitted; build metadata beside it.

    Of several policies for one resource of a project the one with the highest ``seq`` is kept; among equals, and without
    ``seq``, the one whose JSON text is greatest.
    """
    body = F.struct(*[c for c in policies.columns if c != "seq"])
    order = F.struct(F.col("seq") if "seq" in policies.columns else F.lit(0), F.to_json(body))
    chosen = policies.groupBy(*_KEY).agg(F.max_by(F.to_json(body), order).alias("value"))
    chosen.select("value").write.mode("overwrite").text(f"{path}/policies")
    meta = {"schema_version": "1.0", "project_name": project_name, **(build or {})}
    columns = [F.lit(value).alias(key) for key, value in sorted(meta.items())]
    policies.sparkSession.range(1).select(*columns).write.mode("overwrite").json(f"{path}/metadata")


def opa_documents(policies: DataFrame) -> DataFrame:
    """(project_id, resource_urn, document) with sorted lists; a domain without a rule is left out."""

    def section(name: str, *fields: Column) -> Column:
        reason = F.col(f"{name}.reason.winning_source_id").alias("reason_code")
        return F.when(F.col(name).isNotNull(), F.struct(*fields, reason)).alias(name)

    def field(path: str, alias: str | None = None) -> Column:
        return F.col(path).alias(alias or path.split(".")[-1])

    def ordered(path: str) -> Column:
        return F.array_sort(F.col(path)).alias(path.split(".")[-1])

    document = F.struct(
        F.col("resource_urn"),
        F.struct(F.col("contributing_obligation_ids").alias("contributing_obligations")).alias("meta"),
        section("retention", field("retention.duration_s", "max_seconds"), field("retention.is_indefinite")),
        section(
            "geofencing",
            ordered("geofencing.allowed_regions"),
            ordered("geofencing.blocked_regions"),
            field("geofencing.is_global_ban"),
        ),
        section(
            "ai_rules",
            *[
                field(f"ai_rules.{name}")
                for name in (
                    "training_allowed", "fine_tuning_allowed", "rag_allowed", "attribution_required", "attribution_text",
                )
            ],
        ),
        section("purpose", ordered("purpose.allowed_purposes"), ordered("purpose.denied_purposes")),
        section(
            "privacy",
            enum_name(F.col("privacy.method"), fixed.PRIVACY_METHOD).alias("method"),
            field("privacy.parameters"),
        ),
    )
    return policies.select(*_KEY, F.to_json(document).alias("document"))


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast(_STRINGS)


def _statement(
    sid: str,
    actions: Column,
    resources: Column,
    operator: str | None = None,
    key: str | None = None,
    values: Column | None = None,
    principal: Column | None = None,
) -> Column:
    return F.struct(
        F.lit(sid).alias("sid"),
        F.lit("Deny").alias("effect"),
        (principal if principal is not None else F.lit(None).cast(_STRINGS)).alias("principals"),
        actions.alias("actions"),
        resources.alias("resources"),
        F.lit(operator).cast("string").alias("operator"),
        F.lit(key).cast("string").alias("condition_key"),
        (values if values is not None else F.lit(None).cast(_STRINGS)).alias("condition_values"),
    )


def _explode_statements(policies: DataFrame, candidates: list[tuple[Column, Column]]) -> DataFrame:
    """One row per statement whose condition holds, in list order."""
    options = [F.when(F.coalesce(condition, F.lit(False)), body) for condition, body in candidates]
    kept = F.filter(F.array(*options), lambda s: s.isNotNull())
    return policies.select(*_KEY, "resource_arn", F.posexplode(kept).alias("position", "s")).select(
        *_KEY, "resource_arn", "position", "s.*"
    )


def iam_statements(policies: DataFrame, prefix: str = "Gov", purpose_tag: str = "gov:purpose") -> DataFrame:
    """Deny statements that guard each ``resource_arn``; a global ban replaces the region statements."""
    arn = F.col("resource_arn")
    here, anything = F.array(arn), _texts("*")
    geo, purpose = F.col("geofencing"), F.col("purpose")
    path = F.replace(arn, F.lit(fixed.S3_ARN_PREFIX), F.lit(""))
    inputs = F.when(
        arn.startswith(fixed.S3_ARN_PREFIX),
        F.array(F.concat(F.lit("s3://"), path, F.lit("/*")), F.concat(F.lit("s3://"), path)),
    ).otherwise(here)
    open_geo = ~geo["is_global_ban"]
    tag = f"aws:PrincipalTag/{purpose_tag}"

    def deny(sid: str, operator: str, key: str, values: Column) -> Column:
        return _statement(prefix + sid, anything, here, operator, key, values)

    candidates = [
        (geo["is_global_ban"], deny("GeoGlobalBan", "StringEquals", f"{prefix.lower()}:reason", _texts("global_ban"))),
        (
            open_geo & (F.size(geo["blocked_regions"]) > 0),
            deny("GeoBlockDeniedRegions", "StringEquals", "aws:RequestedRegion", F.array_sort(geo["blocked_regions"])),
        ),
        (
            open_geo & (F.size(geo["allowed_regions"]) > 0),
            deny("GeoEnforceAllowedRegions", "StringNotEquals", "aws:RequestedRegion", F.array_sort(geo["allowed_regions"])),
        ),
        (
            ~F.col("ai_rules.training_allowed"),
            _statement(
                f"{prefix}BlockAiTraining", _texts(*fixed.AI_ACTIONS), anything,
                "ForAnyValue:StringLike", "sagemaker:InputDataConfig", inputs,
            ),
        ),
        (
            F.col("retention.is_indefinite"),
            _statement(
                f"{prefix}LockLegalHoldTags", _texts("s3:DeleteObjectTagging", "s3:PutObjectTagging"), here,
                "StringEquals", "s3:ExistingObjectTag/LegalHold", _texts("true"),
            ),
        ),
        (
            F.size(purpose["denied_purposes"]) > 0,
            deny("BlockDeniedPurposes", "StringEquals", tag, F.array_sort(purpose["denied_purposes"])),
        ),
        (
            F.size(purpose["allowed_purposes"]) > 0,
            deny("EnforceAllowedPurposes", "StringNotEquals", tag, F.array_sort(purpose["allowed_purposes"])),
        ),
        (F.col("privacy").isNotNull(), deny("EnforcePrivacyEncryption", "Bool", "aws:SecureTransport", _texts("false"))),
    ]
    return _explode_statements(policies, candidates)


def s3_statements(policies: DataFrame, prefix: str = "Gov", role_tag: str = "GovRole") -> DataFrame:
    """Bucket policy statements; rows whose ARN is not an S3 one give nothing."""
    buckets = policies.filter(F.col("resource_arn").startswith(fixed.S3_ARN_PREFIX))
    bucket = F.regexp_replace("resource_arn", r"[/*]+$", "")
    objects = F.concat(bucket, F.lit("/*"))
    both, everyone, all_s3 = F.array(bucket, objects), _texts("*"), _texts("s3:*")
    services = _texts(*fixed.AI_SERVICES)
    read = _texts("s3:GetObject", "s3:ListBucket")
    no_training = ~F.col("ai_rules.training_allowed")
    candidates = [
        (
            no_training,
            _statement(f"{prefix}DenyAiServiceAccess", read, both, "StringEquals", "aws:ViaAWSService", services, everyone),
        ),
        (no_training, _statement(f"{prefix}DenyAiServicePrincipals", read, both, principal=services)),
        (
            F.col("privacy").isNotNull(),
            _statement(f"{prefix}EnforceTls", all_s3, both, "Bool", "aws:SecureTransport", _texts("false"), everyone),
        ),
        (
            F.col("retention.is_indefinite"),
            _statement(
                f"{prefix}DenyDeleteOnLegalHold", _texts("s3:DeleteObject", "s3:DeleteObjectVersion"), F.array(objects),
                "StringEquals", "s3:ExistingObjectTag/LegalHold", _texts("true"), everyone,
            ),
        ),
        (
            F.col("geofencing.is_global_ban"),
            _statement(
                f"{prefix}GlobalBanLockdown", all_s3, both,
                "StringNotEquals", f"aws:PrincipalTag/{role_tag}", _texts("PlatformAdmin"), everyone,
            ),
        ),
    ]
    return _explode_statements(buckets, candidates)


def statement_documents(policies: DataFrame, statements: DataFrame) -> DataFrame:
    """(project_id, resource_urn, document): the statements of each policy as one JSON document, empty list included."""

    def one_or_many(values: Column) -> Column:
        return F.when(F.size(values) == 1, F.to_json(values).substr(F.lit(2), F.length(F.to_json(values)) - 2)).otherwise(
            F.to_json(values)
        )

    principal = F.when(F.col("principals") == _texts("*"), F.lit('"*"')).otherwise(
        F.concat(F.lit('{"Service":'), F.to_json("principals"), F.lit("}"))
    )
    condition = F.concat(
        F.lit('{"'), F.col("operator"), F.lit('":{"'), F.col("condition_key"), F.lit('":'),
        one_or_many(F.col("condition_values")), F.lit("}}"),
    )
    parts = [
        F.concat(F.lit('"Sid":"'), F.col("sid"), F.lit('"')),
        F.concat(F.lit('"Effect":"'), F.col("effect"), F.lit('"')),
        F.concat(F.lit('"Principal":'), principal),
        F.concat(F.lit('"Action":'), one_or_many(F.col("actions"))),
        F.concat(F.lit('"Resource":'), one_or_many(F.col("resources"))),
        F.concat(F.lit('"Condition":'), condition),
    ]
    text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    grouped = statements.groupBy(*_KEY).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", text.alias("text")))), lambda s: s["text"]
        ).alias("texts")
    )
    body = F.concat_ws(",", F.coalesce("texts", F.array().cast(_STRINGS)))
    document = F.concat(F.lit(f'{{"Version":"{fixed.POLICY_DOCUMENT_VERSION}","Statement":['), body, F.lit("]}"))
    # Each statement is gathered once, however many rows a policy has.
    return policies.select(*_KEY).distinct().join(grouped, _KEY, "left").select(*_KEY, document.alias("document"))


_DOCUMENT = (
    "Version string, Statement array<struct<Sid:string,Effect:string,Action:string,NotAction:string,"
    "Resource:string,NotResource:string>>, resource_urn string, meta string, retention string, "
    "geofencing string, ai_rules string, purpose string, privacy string"
)


def check_documents(docs: DataFrame, kind: str = "iam") -> DataFrame:
    """Add ``errors`` and ``warnings`` arrays to (…, document) rows; ``kind`` is iam or opa."""
    doc = F.from_json("document", _DOCUMENT)
    readable = F.try_parse_json(F.col("document")).isNotNull()
    kept = lambda options: F.filter(F.array(*options), lambda m: m.isNotNull())
    broken = F.when(~readable, F.lit("invalid JSON"))
    if kind == "opa":
        domains = ["retention", "geofencing", "ai_rules", "purpose", "privacy"]
        none = F.coalesce(*[doc[d] for d in domains]).isNull()
        errors = kept([broken, F.when(readable & doc["resource_urn"].isNull(), F.lit("missing resource_urn"))])
        warnings = kept(
            [
                F.when(readable & doc["meta"].isNull(), F.lit("missing meta")),
                F.when(readable & none, F.lit("no active constraints")),
            ]
        )
        return docs.withColumn("errors", errors).withColumn("warnings", warnings)

    listed = F.get_json_object("document", "$.Statement").startswith("[")

    def some(test) -> Column:
        return F.exists(doc["Statement"], test)

    errors = kept(
        [
            broken,
            F.when(readable & doc["Version"].isNull(), F.lit("missing Version")),
            F.when(readable & F.get_json_object("document", "$.Statement").isNull(), F.lit("missing Statement")),
            F.when(readable & ~listed, F.lit("Statement must be a list")),
            F.when(some(lambda s: s["Sid"].isNotNull() & ~s["Sid"].rlike("^[a-zA-Z0-9]+$")), F.lit("Sid must be alphanumeric")),
            F.when(some(lambda s: s["Effect"].isNull()), F.lit("missing Effect")),
            F.when(some(lambda s: ~s["Effect"].isin("Allow", "Deny")), F.lit("Effect must be Allow or Deny")),
            F.when(some(lambda s: s["Action"].isNull() & s["NotAction"].isNull()), F.lit("missing Action")),
            F.when(some(lambda s: s["Resource"].isNull() & s["NotResource"].isNull()), F.lit("missing Resource")),
        ]
    )
    return docs.withColumn("errors", errors).withColumn("warnings", F.array().cast(_STRINGS))
