"""Readers, normalisers and sinks of the logical tables."""
