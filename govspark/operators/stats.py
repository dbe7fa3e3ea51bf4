"""List views and dashboard aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.functions import json_text, urn_last


def _since(as_of: datetime, hours: float) -> Column:
    return F.lit(as_of - timedelta(hours=hours)).cast("timestamp")


# --- list views --------------------------------------------------------------


def list_audit(
    log: DataFrame,
    project_id: str,
    limit: int = 50,
    actor: str | None = None,
    urn: str | None = None,
    decision: str = "ALL",
) -> DataFrame:
    """Newest audit rows of a project, optionally of one actor, urn or decision."""
    rows = log.filter(F.col("project_id") == project_id)
    if actor is not None:
        rows = rows.filter(F.col("actor_id") == actor)
    if urn is not None:
        rows = rows.filter(F.col("resource_urn") == urn)
    if decision != "ALL":
        rows = rows.filter(F.col("decision") == decision)
    return rows.orderBy(F.col("timestamp").desc(), F.col("id")).limit(limit)


def search_obligations(
    obligations: DataFrame, query: str | None = None, level: int | None = None, include_inactive: bool = False
) -> DataFrame:
    """Active obligations by level and by text in title or id, ordered by id."""
    rows = obligations
    if not include_inactive:
        rows = rows.filter("is_active")
    if level is not None:
        rows = rows.filter(F.col("enforcement_level") == level)
    if query:
        rows = rows.filter(F.col("title").ilike(f"%{query}%") | F.col("id").ilike(f"%{query}%"))
    return rows.orderBy("id")


# Rows that one task may sort for a page, and the number of ranges a larger view is counted in.
PAGE_ROWS = 100_000
PAGE_RANGES = 64


def page(
    df: DataFrame, number: int, size: int, order: list[str], max_sorted: int = PAGE_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(rows of one page, one row with total and pages). The first page is 1.

    ``order`` should be unique; null comes first. A page within the first ``max_sorted`` rows is taken from the top of
    every task. For a deeper one the rows are counted per range of ``order``, again and again inside the ranges that
    hold the page, until at most ``max_sorted`` rows are left beside it; only those are sorted. A page behind the last row is empty.
    """
    number = max(number, 1)
    skip = (number - 1) * size
    total = df.agg(F.count("*").alias("total"))
    rows = df
    if skip + size > max_sorted:
        rows, skip = _around(df, skip, size, order, max_sorted)
    return rows.orderBy(*order).offset(skip).limit(size), total.withColumn("pages", F.ceil(F.col("total") / size))


def page_after(df: DataFrame, after: Sequence | None, size: int, order: list[str]) -> DataFrame:
    """The ``size`` rows that follow the row with ``after`` as its values of ``order``; None gives the first page."""
    rows = df if after is None else df.filter(F.struct(*order) > _point(df, order, after))
    return rows.orderBy(*order).limit(size)


def _point(df: DataFrame, order: list[str], values: Sequence) -> Column:
    return F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, values, strict=True)])


def _between(df: DataFrame, order: list[str], low: Sequence | None, high: Sequence | None) -> DataFrame:
    """Rows from ``low`` up to, not including, ``high``; the plain test on the first column reaches the scan."""
    first, key = F.col(order[0]), F.struct(*order)
    if low is not None:
        df = df.filter(key >= _point(df, order, low))
        df = df if low[0] is None else df.filter(first >= F.lit(low[0]))
    if high is not None:
        df = df.filter(key < _point(df, order, high))
        df = df if high[0] is None else df.filter(first.isNull() | (first <= F.lit(high[0])))
    return df


def _range_number(df: DataFrame, order: list[str], bounds: list[Sequence], start: int = 0) -> Column:
    """How many of the sorted bounds are at or below the row, by halving."""
    if not bounds:
        return F.lit(start)
    middle = len(bounds) // 2
    below = _range_number(df, order, bounds[:middle], start)
    above = _range_number(df, order, bounds[middle + 1 :], start + middle + 1)
    return F.when(F.struct(*order) < _point(df, order, bounds[middle]), below).otherwise(above)


def _around(df: DataFrame, skip: int, size: int, order: list[str], max_sorted: int) -> tuple[DataFrame, int]:
    """The rows of a few ranges that hold the page, and how many of them come before it.

    Bounds come from a sample of about 20 keys a range. The sample decides how even the ranges are, not what the page holds.
    """
    low = high = None
    held = df.count()
    while held > max_sorted + size and skip < held:
        inside = _between(df, order, low, high).select(*order)
        wanted = 20 * PAGE_RANGES
        sample = inside.sample(min(1.0, wanted / held), 7).distinct().orderBy(*order).collect()
        step = max(len(sample) // PAGE_RANGES, 1)
        bounds = sample[step::step]
        counts = dict(inside.groupBy(_range_number(df, order, bounds).alias("range")).count().collect())
        before, kept = 0, []
        for place in range(len(bounds) + 1):
            here = counts.get(place, 0)
            if here and before < skip + size and before + here > skip:
                kept.append((place, before, here))
            before += here
        left = sum(here for _, _, here in kept)
        if not kept or left == held:
            break  # rows with equal keys can't be told apart
        low = bounds[kept[0][0] - 1] if kept[0][0] > 0 else low
        high = bounds[kept[-1][0]] if kept[-1][0] < len(bounds) else high
        skip, held = skip - kept[0][1], left
    return _between(df, order, low, high), skip


def high_risk(raw: DataFrame, limit: int = 50, attributes: str = "attributes") -> DataFrame:
    """Resources whose sensitivity, risk or sensitivity tag is high, in urn order."""
    doc = F.col(attributes)
    text = lambda path: F.upper(json_text(doc, path))
    hit = (
        text("$.sensitivity").isin("CONFIDENTIAL", "RESTRICTED", "3", "4")
        | text("$.risk_level").isin("HIGH", "UNACCEPTABLE", "3", "4")
        | F.lower(json_text(doc, "$.tags.sensitivity")).isin("high", "restricted")
    )
    return (
        raw.filter(F.coalesce(hit, F.lit(False)))
        .withColumn("name", F.coalesce(F.nullif("name", F.lit("")), urn_last(F.col("urn"))))
        .orderBy("urn")
        .limit(limit)
    )


# --- aggregates --------------------------------------------------------------


def kpis(
    audit: DataFrame, obligations: DataFrame, resources: DataFrame, as_of: datetime, hours: float = 24
) -> DataFrame:
    """Requests, denials, enforcement rate, active obligations and resources, per project.

    An obligation without a project applies to every project and counts for each.
    """
    recent = audit.filter(F.col("timestamp") >= _since(as_of, hours))
    traffic = recent.groupBy("project_id").agg(
        F.count("*").alias("total_requests"), F.count_if(F.col("decision") == "DENY").alias("denials")
    )
    owned = resources.groupBy("project_id").agg(F.count("*").alias("resources"))
    in_force = obligations.filter("is_active")
    active = in_force.filter("project_id IS NOT NULL").groupBy("project_id").agg(F.count("*").alias("active_obligations"))
    everywhere = in_force.agg(F.count_if(F.col("project_id").isNull()).alias("everywhere"))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = owned.join(active, "project_id", "full_outer").join(traffic, "project_id", "full_outer")
    allowed = F.col("total_requests") - F.col("denials")
    return joined.select(
        "project_id", zero("total_requests"), zero("denials"), zero("active_obligations"), zero("resources")
    ).crossJoin(F.broadcast(everywhere)).withColumn("active_obligations", F.col("active_obligations") + F.col("everywhere")).drop("everywhere").withColumn(
        "enforcement_rate",
        F.when(F.col("total_requests") == 0, F.lit(100.0)).otherwise(F.round(allowed / F.col("total_requests") * 100, 1)),
    )


def traffic_series(audit: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    """Allowed and denied requests per project and hour."""
    return (
        audit.filter(F.col("timestamp") >= _since(as_of, hours))
        .groupBy("project_id", F.date_trunc("hour", "timestamp").alias("hour"))
        .agg(
            F.count_if(F.col("decision") == "ALLOW").alias("allowed"),
            F.count_if(F.col("decision") == "DENY").alias("denied"),
        )
    )


def deny_reasons(audit: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    reason = F.coalesce(json_text(F.col("reason_trace"), "$.decision_reason"), F.lit("Unspecified Policy"))
    return (
        audit.filter((F.col("decision") == "DENY") & (F.col("timestamp") >= _since(as_of, hours)))
        .groupBy(reason.alias("reason"))
        .agg(F.count("*").alias("denials"))
    )


def top_deny_reasons(audit: DataFrame, as_of: datetime, hours: float = 24, k: int = 5) -> DataFrame:
    return deny_reasons(audit, as_of, hours).orderBy(F.col("denials").desc(), "reason").limit(k)


def recent_blocks(audit: DataFrame, k: int = 10) -> DataFrame:
    """The latest denials, however old."""
    return audit.filter(F.col("decision") == "DENY").orderBy(F.col("timestamp").desc(), "id").limit(k)


def inventory_kpis(resources: DataFrame) -> DataFrame:
    """Distinct platforms, share of tagged resources in percent, and resources at risk, per project."""
    tagged = F.when(F.size("tags") > 0, 1.0).otherwise(0.0)
    risky = (F.col("sensitivity") >= 3) | (F.col("risk_level") >= 3)
    return resources.groupBy("project_id").agg(
        F.count("*").alias("total"),
        F.countDistinct("platform").alias("platforms"),
        F.round(F.avg(tagged) * 100).cast("bigint").alias("tag_coverage"),
        F.count_if(risky).alias("risk_count"),
    )


def job_board(jobs: DataFrame, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(jobs with the active ones first, number of pending jobs)."""
    active = ~F.col("status").isin("COMPLETED", "FAILED")
    board = jobs.orderBy(F.when(active, 0).otherwise(1), "job_id").limit(limit)
    return board, jobs.agg(F.count_if(active).alias("pending"))


def reason_share(reasons: DataFrame) -> DataFrame:
    """Add the share of all denials, in percent, to a small (reason, denials) table."""
    total = reasons.agg(F.sum("denials").alias("_total"))  # one row
    shared = reasons.crossJoin(F.broadcast(total))
    return shared.withColumn("share", F.round(F.col("denials") / F.col("_total") * 100, 1)).drop("_total")
