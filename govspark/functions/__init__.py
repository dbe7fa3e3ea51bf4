"""Scalar functions: Column in, Column out."""

from govspark.functions.enums import enum_name, enum_value, fuzzy_enum
from govspark.functions.net import cidr_contains, has_all, has_any, ip_in_cidrs, is_eu_region
from govspark.functions.text import (
    any_glob,
    canonical_json,
    canonical_json_text,
    content_hash,
    glob_match,
    glob_regex,
    json_text,
    normalize_type,
    segment_glob_match,
    urn_last,
    urn_segment,
    uuid5_dns,
    workspace_id,
)
from govspark.functions.time import age_days, age_seconds, duration_seconds, iso_utc, is_business_hours, is_expired, parse_instant

__all__ = [name for name in dir() if not name.startswith("_")]
