"""Running values over ordered groups of any length.

A window partitioned by a key sorts a whole key in one task, which fails when one project or one
document holds a large share of the rows. So rows are always range-partitioned on (key, order), each
range computes its own running values, and a small table of per-range totals carries them over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govspark.operators.joins import null_safe_join
from govspark.session import materialize


def ordered_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows split by range on (keys, order), with the range number in ``_range``.

    Written out: every later use sees the same split, also after an executor is lost.
    """
    return materialize(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    number: str | None = None,
) -> DataFrame:
    """Add running sums, last non-null values and a zero-based row number per key.

    ``order`` must be unique inside a key. A null key is a key like any other. ``lasts`` values are the latest non-null value up to and
    including the row.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    if number is not None:
        sums[number] = F.lit(1)
    ranged = ordered_ranges(df.select("*", *[c.alias(f"_v_{n}") for n, c in {**sums, **lasts}.items()]), keys, order)
    cells = [*keys, "_range"]

    # Per key and range: how much the range adds. There are at most (ranges + keys) such rows.
    totals = ranged.groupBy(*cells).agg(
        F.lit(1).alias("_one"),
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).alias(f"_t_{n}")
            for n in lasts
        ],
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *cells,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
    )
    inside = Window.partitionBy(*cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select(
        "*",
        *[F.sum(f"_v_{n}").over(inside).alias(f"_s_{n}") for n in sums],
        *[F.last(f"_v_{n}", ignorenulls=True).over(inside).alias(f"_s_{n}") for n in lasts],
    )
    out = null_safe_join(local, carries, cells)
    value = {n: F.col(f"_s_{n}") + F.col(f"_c_{n}") for n in sums}
    if number is not None:
        value[number] = value[number] - 1
    value.update({n: F.coalesce(f"_s_{n}", f"_c_{n}") for n in lasts})
    return out.select(*df.columns, *[c.alias(n) for n, c in value.items()])
