"""Incremental forms of operators whose state is small: counts per window, and sums that merge."""
