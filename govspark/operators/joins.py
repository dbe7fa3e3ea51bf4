"""Equi-joins in which null keys meet null keys, as in a grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` with null equal to null; ``how`` is inner, left, left_semi or left_anti."""
    own = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(own)
    met = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[n]) for k, n in own.items()])
    joined = left.join(right, met, how)
    return joined.select(*left.columns) if how in ("left_semi", "left_anti") else joined.drop(*own.values())
