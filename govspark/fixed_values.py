"""Enums, lists, patterns and message formats that results must carry verbatim."""

# --- ordered enums -----------------------------------------------------------
SENSITIVITY = {"UNSPECIFIED": 0, "PUBLIC": 1, "INTERNAL": 2, "CONFIDENTIAL": 3, "RESTRICTED": 4}
RISK = {"UNSPECIFIED": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "UNACCEPTABLE": 4}
PRIVACY_METHOD = {
    "UNSPECIFIED": 0,
    "PSEUDONYMIZATION": 1,
    "ANONYMIZATION": 2,
    "DIFFERENTIAL_PRIVACY": 3,
    "ROW_LEVEL_SECURITY": 4,
}
RETENTION_TRIGGER = {
    "UNSPECIFIED": 0,
    "CREATION_DATE": 1,
    "LAST_ACCESS_DATE": 2,
    "EVENT_DATE": 3,
    "DATA_SUBJECT_REQUEST": 4,
}
ENFORCEMENT_LEVEL = {"UNSPECIFIED": 0, "BLOCKING": 1, "AUDIT_ONLY": 2, "NOTIFY_HUMAN": 3}
RUN_TYPE = {
    "UNSPECIFIED": 0,
    "ETL_TRANSFORM": 1,
    "AI_TRAINING": 2,
    "AI_FINE_TUNING": 3,
    "AI_RAG_QUERY": 4,
    "HUMAN_DOWNLOAD": 5,
}
DECISION = {"UNSPECIFIED": 0, "ALLOW": 1, "DENY": 2, "DRY_RUN_DENY": 3}
ACTOR_TYPE = {"UNSPECIFIED": 0, "HUMAN": 1, "SERVICE_ACCOUNT": 2, "SYSTEM_INTERNAL": 3}

# --- geography ---------------------------------------------------------------
EU_REGIONS = [
    "AT", "BE", "BG", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GR", "HR", "HU",
    "IE", "IT", "LT", "LU", "LV", "MT", "NL", "PL", "PT", "RO", "SE", "SI", "SK",
]
ADEQUATE_COUNTRIES = ["AD", "AR", "CA", "CH", "FO", "GB", "GG", "IL", "IM", "JE", "JP", "KR", "NZ", "UY"]
DPF_CERTIFICATE = "EU_US_DPF"

# --- request context ---------------------------------------------------------
REGION_KEYS = ["region", "geo", "location", "country"]
FORMAT_KEYS = ["output_format", "mode", "format"]
RAW_FORMATS = ["raw", "cleartext", "unmasked", "decrypt"]

# --- scope defaults ----------------------------------------------------------
EXCLUDED_CATALOGS = ["system", "hive_metastore", "samples"]
EXCLUDED_SCHEMAS = ["information_schema", "__*"]

# --- column detection --------------------------------------------------------
PII_NAME_PARTS = ["email", "phone", "ssn", "social_security", "credit_card", "passport"]
RLS_COLUMN_NAMES = ["region", "country", "geo", "tenant_id", "org_id", "department"]
ADMIN_GROUPS = ["admin", "metastore_admins"]
ADMIN_ROLES = ["ACCOUNTADMIN", "SECURITYADMIN", "SYSADMIN"]

# --- cloud policy documents --------------------------------------------------
UPLOADS = "s3://uploads/"
POLICY_DOCUMENT_VERSION = "2012-10-17"
AI_ACTIONS = [
    "sagemaker:CreateTrainingJob",
    "sagemaker:CreateHyperParameterTuningJob",
    "sagemaker:CreateAutoMLJob",
    "sagemaker:CreateProcessingJob",
    "sagemaker:CreateTransformJob",
    "sagemaker:CreateLabelingJob",
    "bedrock:CreateModelCustomizationJob",
    "bedrock:InvokeModel",
]
AI_SERVICES = ["sagemaker.amazonaws.com", "bedrock.amazonaws.com"]
S3_ARN_PREFIX = "arn:aws:s3:::"

# --- ledger ------------------------------------------------------------------
GENESIS_HASH = "0" * 64
BLOCK_CAPACITY = 5000
SEAL_MIN_ENTRIES = 100
SEAL_MAX_AGE_S = 300

# --- contract text -----------------------------------------------------------
SUBJECT_TAG_RULES = [
    (["personal data", "pii", "personally identifiable"], {"category": "pii"}),
    (["financial", "payment", "cardholder", "pci"], {"category": "financial", "sensitivity": "restricted"}),
    (["health", "medical", "phi", "patient"], {"category": "health", "sensitivity": "restricted"}),
    (["usage", "telemetry", "logs", "analytics"], {"category": "telemetry"}),
    (["confidential"], {"sensitivity": "confidential"}),
]
ZERO_RETENTION_NOTE = (
    " [SYSTEM: Duration was 0s (Immediate Deletion). "
    "Auto-corrected to 365d and downgraded to AUDIT_ONLY for safety.]"
)
UUID_NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"
