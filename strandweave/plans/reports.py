"""Small reports on a finished run: matrices, trees, tables and metric records."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import contig_text
from ..sources.yamlio import shown

#: Columns of the metrics table by default. Fixed values of the format.
FIELDS = (
    "input_read_count", "input_read_bases", "input_read_n50", "pass_cluster_count", "fail_cluster_count", "overall_clustering_score",
    "untrimmed_cluster_size", "untrimmed_cluster_distance", "trimmed_cluster_size", "trimmed_cluster_median", "trimmed_cluster_mad",
    "consensus_assembly_bases", "consensus_assembly_unitigs", "consensus_assembly_fully_resolved",
)

#: Names of all metrics. Fixed values of the format.
KNOWN = frozenset((
    "input_read_count", "input_read_bases", "input_read_n50", "output_reads",
    "input_assemblies_count", "input_assemblies_total_contigs", "input_assemblies_total_length", "compressed_unitig_count", "compressed_unitig_total_length",
    "input_assembly_details",
    "pass_cluster_count", "fail_cluster_count", "pass_contig_count", "fail_contig_count", "pass_contig_fraction", "fail_contig_fraction",
    "cluster_balance_score", "cluster_tightness_score", "overall_clustering_score",
    "untrimmed_cluster_size", "untrimmed_cluster_lengths", "untrimmed_cluster_median", "untrimmed_cluster_mad", "untrimmed_cluster_distance",
    "trimmed_cluster_size", "trimmed_cluster_lengths", "trimmed_cluster_median", "trimmed_cluster_mad",
    "consensus_assembly_bases", "consensus_assembly_unitigs", "consensus_assembly_fully_resolved", "consensus_assembly_clusters",
))


def phylip(distances: DataFrame, seqs: DataFrame) -> DataFrame:
    """sample_id, place, value: the distance matrix of every sample as lines, the number of sequences
    first, then a row per sequence in the order of their numbers, tab-separated with eight decimals;
    pairs that ``distances`` (sample_id, a, b, dist) lacks have 1, a sequence has 0 to itself. A row
    is one line of the sample's few thousand sequences at most."""
    named = seqs.select("sample_id", F.col("seq_id").cast("bigint").alias("a"), contig_text(F.col("filename"), F.col("contig_header"), F.col("length")).alias("label"))
    ids = named.groupBy("sample_id").agg(F.sort_array(F.collect_list("a")).alias("ids"))
    known = distances.groupBy("sample_id", F.col("a").cast("bigint").alias("a")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("b").cast("bigint"), "dist"))).alias("near"))
    rows = named.join(ids, "sample_id").join(known, ["sample_id", "a"], "left")
    cell = lambda b: F.format_string("%.8f", F.when(b == F.col("a"), 0.0).otherwise(F.coalesce(F.try_element_at("near", b), F.lit(1.0))))
    line = F.concat_ws("\t", F.col("label"), F.transform("ids", cell))
    head = ids.select("sample_id", F.lit(0).cast("bigint").alias("place"), F.size("ids").cast("string").alias("value"))
    return head.unionByName(rows.select("sample_id", F.col("a").alias("place"), line.alias("value")))


def clustering_summary(clusters: DataFrame) -> DataFrame:
    """One row: pass and fail counts of clusters and contigs, and their pass shares. ``clusters``
    has cluster, size, passed."""
    count = lambda ok, what: F.coalesce(F.sum(F.when(F.col("passed") == ok, what).otherwise(0)), F.lit(0)).cast("bigint")
    row = clusters.agg(
        count(True, F.lit(1)).alias("pass_cluster_count"), count(False, F.lit(1)).alias("fail_cluster_count"),
        count(True, F.col("size")).alias("pass_contig_count"), count(False, F.col("size")).alias("fail_contig_count"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return row.withColumn("pass_contig_fraction", share("pass_contig_count", "fail_contig_count")).withColumn("fail_contig_fraction", share("fail_contig_count", "pass_contig_count"))


def table_line(name: str, one_copy: list[dict[str, Any]], multi_copy: list[dict[str, Any]], fields: tuple[str, ...] = FIELDS, sigfigs: int = 3) -> str:
    """One line of the metrics table. Records of one copy are merged (the later wins), records of
    many copies give a list per field; unknown fields are an error."""
    if sigfigs < 1:
        raise ValueError("at least one significant figure is needed")
    if "\t" in name:
        raise ValueError("a name cannot hold tabs")
    check_fields(fields)
    merged: dict[str, Any] = {k: v for r in one_copy for k, v in r.items()}
    for record in multi_copy:
        for k, v in record.items():
            merged.setdefault(k, []).append(v)
    return "\t".join([name, *(shown(merged.get(f), sigfigs) for f in fields)])


def check_fields(fields: tuple[str, ...]) -> None:
    if unknown := [f for f in fields if f not in KNOWN]:
        raise ValueError(f"{unknown[0]} is not a metric")


def table_header(fields: tuple[str, ...] = FIELDS) -> str:
    check_fields(fields)
    return "\t".join(("name", *fields))
