"""Column functions and small aggregates."""
