"""Usage analytics over append-only logs, as DataFrame to DataFrame operators."""
