"""Structured Streaming forms of ingest, sealing, run state, traffic and live tail."""

from govspark.streaming.audit import live_tail, stream_ingest, stream_seal, stream_traffic
from govspark.streaming.runs import latest_runs, stream_runs

__all__ = ["latest_runs", "live_tail", "stream_ingest", "stream_runs", "stream_seal", "stream_traffic"]
