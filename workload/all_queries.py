"""Imports every query module, so that the registry is complete."""

from workload import (  # noqa: F401
    q_change,
    q_contracts,
    q_decisions,
    q_functions,
    q_ledger,
    q_lineage,
    q_policies,
    q_protect,
    q_sources,
    q_stats,
    q_streaming,
)
from workload.registry import ORACLES, QUERIES  # noqa: F401
