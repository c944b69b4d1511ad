"""Counting arriving reads against a fixed table of assembly k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kmers import explode_kmers
from ..operators.reads import canonical_read_kmers


def kmer_counts(reads: DataFrame, assembly_kmers: DataFrame, k: int) -> DataFrame:
    """kmer, n over a stream (or table) of reads (read_id, seq): a join with the fixed table and
    a running count. State is one counter per assembly k-mer that was met, so it is bounded by
    the assembly, not by the reads. Write it in ``update`` or ``complete`` mode."""
    exploded = canonical_read_kmers(explode_kmers(reads, ["read_id"], "seq", k))
    return exploded.join(assembly_kmers.select("kmer"), "kmer").groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
