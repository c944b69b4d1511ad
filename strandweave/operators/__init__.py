"""Operators on sequences, k-mers, unitig graphs, clusters and reads."""
