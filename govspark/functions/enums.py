"""Enum names and ordinals as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def enum_value(name: Column, table: dict[str, int], default: int = 0) -> Column:
    """Ordinal of an enum given as a name or as digits, case-insensitively."""
    text = F.upper(F.trim(name.cast("string")))
    found = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    for member, value in table.items():
        found = found.when(text == member, F.lit(value))
    return F.coalesce(found, F.lit(default))


def enum_name(value: Column, table: dict[str, int], default: str = "UNSPECIFIED") -> Column:
    named = F.lit(default)
    for member, number in table.items():
        named = F.when(value == number, F.lit(member)).otherwise(named)
    return named


def fuzzy_enum(value: Column, table: dict[str, int]) -> Column:
    """Ordinal from a known number, an exact name, or a name that is a suffix either way; else null."""
    text = F.upper(F.trim(value.cast("string")))
    number = text.try_cast("int")
    branches = F.when(number.isin(*table.values()), number)
    for member, ordinal in table.items():
        branches = branches.when(text == member, F.lit(ordinal))
    for member, ordinal in table.items():
        suffix = F.lit(member).endswith(F.concat(F.lit("_"), text)) | text.endswith(f"_{member}")
        branches = branches.when(suffix, F.lit(ordinal))
    return branches
