"""End-to-end compositions: build policies, check requests, keep the ledger, read contracts."""

from govspark.plans.pipelines import build_policies, check_requests, contract_obligations, seal_log

__all__ = ["build_policies", "check_requests", "contract_obligations", "seal_log"]
