"""Set-oriented operators over the logical tables."""
