"""The pipelines as single logical plans over whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.operators.contracts import chunk_elements, clean_elements, merge_constraints, verify_quotes
from govspark.operators.decide import decisions_to_audit, evaluate_requests
from govspark.operators.ledger import entry_hash, seal
from govspark.operators.lineage import analyze_lineage
from govspark.operators.ordered import running
from govspark.operators.resolve import resolve_policies
from govspark.sources.audit import append_audit, canonicalize_audit
from govspark.sources.inventory import normalize_resources
from govspark.sources.obligations import normalize_obligations


def rank_obligations(obligations: DataFrame) -> DataFrame:
    """Give obligations without an order one: the rank of their id within the table.

    Ranks come from a range sort, so no task sees the whole table.
    """
    ranked = running(obligations.withColumn("_all", F.lit(0)), ["_all"], ["id"], number="ord")
    return ranked.drop("_all")


def build_policies(raw_policies: DataFrame, raw_resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(effective policies, rejected policy rows) from raw JSON rows."""
    obligations, rejects = normalize_obligations(raw_policies)
    if "ord" not in obligations.columns:
        obligations = rank_obligations(obligations)
    if "project_id" not in obligations.columns:
        obligations = obligations.withColumn("project_id", F.lit(None).cast("string"))
    return resolve_policies(normalize_resources(raw_resources), obligations), rejects


def check_requests(
    requests: DataFrame,
    policies: DataFrame,
    as_of: datetime,
    edges: DataFrame | None = None,
    resources: DataFrame | None = None,
    profile: str = "server",
) -> tuple[DataFrame, DataFrame]:
    """(decisions, canonical audit entries with their hash)."""
    lineage = None
    if edges is not None and resources is not None:
        asked = requests.select("project_id", F.col("resource_urn").alias("urn"))
        lineage = analyze_lineage(edges, resources, asked)
    decisions = evaluate_requests(requests, policies, as_of, profile, lineage)
    return decisions, entry_hash(canonicalize_audit(decisions_to_audit(decisions, requests, as_of)))


def seal_log(log: DataFrame, batch: DataFrame, last_blocks: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new entries, blocks, links): append a batch once, hash it and seal what is due."""
    fresh = entry_hash(canonicalize_audit(append_audit(log, batch)))
    blocks, links = seal(fresh, last_blocks, as_of)
    return fresh, blocks, links


def contract_obligations(elements: DataFrame, constraints: DataFrame, max_tokens: int = 800) -> tuple[DataFrame, DataFrame]:
    """(chunks, obligations): elements to chunks, extracted constraints checked against them and merged per document."""
    chunks = chunk_elements(clean_elements(elements), max_tokens)
    verified = verify_quotes(constraints, chunks).filter("verified")
    return chunks, merge_constraints(verified, ["doc_id"])
