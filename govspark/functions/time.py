"""Durations, ages and ISO instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S = 86400


def duration_seconds(text: Column) -> Column:
    """Seconds of '24h', '30d', '6m' (30-day months) or '1y' (365 days); null when malformed."""
    lowered = F.lower(text.cast("string"))
    amount = F.regexp_extract(lowered, r"^(\d+)[dmyh]$", 1)
    unit = F.substring(lowered, -1, 1)
    scale = (
        F.when(unit == "h", F.lit(3600))
        .when(unit == "d", F.lit(DAY_S))
        .when(unit == "m", F.lit(30 * DAY_S))
        .when(unit == "y", F.lit(365 * DAY_S))
    )
    return F.when(amount != "", amount.cast("bigint") * scale)


def age_seconds(created_at: Column, as_of: Column) -> Column:
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(created_at.cast("timestamp"))
    return micros / F.lit(1_000_000)


def age_days(created_at: Column, as_of: Column) -> Column:
    return age_seconds(created_at, as_of) / F.lit(DAY_S)


def is_expired(created_at: Column, limit_seconds: Column, as_of: Column) -> Column:
    return age_seconds(created_at, as_of) > limit_seconds


def is_business_hours(instant: Column) -> Column:
    """Monday to Friday, 09:00 up to but not including 17:00."""
    return ~F.dayofweek(instant).isin(1, 7) & (F.hour(instant) >= 9) & (F.hour(instant) < 17)


def parse_instant(text: Column, require_zone: bool = False) -> Column:
    """ISO-8601 text to a timestamp; null for anything that is not a full date. Zone-less text is UTC."""
    trimmed = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=$|T)", "$1-$2-$3")
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?)?(Z|[+-]\d{2}:?\d{2})?$"
    if require_zone:
        shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    return F.when(trimmed.rlike(shape), F.try_to_timestamp(trimmed))


def iso_utc(instant: Column) -> Column:
    """ISO text with a +00:00 offset and microseconds only when they are not zero."""
    seconds = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(instant, "SSSSSS")
    return F.concat(seconds, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))
