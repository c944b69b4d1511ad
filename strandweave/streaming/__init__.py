"""Structured Streaming forms of operators on arriving reads."""
