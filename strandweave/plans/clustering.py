"""Clustering of many samples' contigs in one job: distances by joins, one tree per sample."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import contig_label, first_token
from ..functions.stats import int_mad, int_median
from ..operators import distances as D
from ..operators.clustering import Contig, check_contigs, clustered, manual_nodes

_OUT = "sample_id string, seq_id bigint, node int, cluster int, passed boolean, reasons array<string>, distance double"


def _samples(seqs: DataFrame, distances: DataFrame, run, schema: str) -> DataFrame:
    wanted = seqs.select("sample_id", F.col("seq_id").cast("bigint").alias("seq_id"), "filename", F.col("length").cast("bigint").alias("length"), F.col("cluster_weight").cast("int").alias("weight"), "trusted")
    # a name of its own, since both sides may come from one table
    pairs = distances.select(F.col("sample_id").alias("sample"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), "dist")

    def one(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        contigs = [Contig(int(r.seq_id), r.filename, int(r.length), int(r.weight), bool(r.trusted)) for r in own.sort_values("seq_id").itertuples()]
        known = {(int(a), int(b)): float(d) for a, b, d in zip(near["a"], near["b"], near["dist"], strict=True)}
        return run(own, contigs, known)

    return wanted.groupBy("sample_id").cogroup(pairs.groupBy("sample")).applyInPandas(one, schema)


def cluster(seqs: DataFrame, distances: DataFrame, cutoff: float = 0.2, min_assemblies: int | None = None, manual: str | None = None, max_contigs: float = 25.0) -> DataFrame:
    """``seqs`` with node, cluster, passed, reasons and distance, of every sample.

    ``seqs`` has sample_id, seq_id, filename, contig_header, length, cluster_weight,
    consensus_weight, trusted (see ``sources.fasta.assembly_sequences``); ``distances`` sample_id,
    a, b, dist in both directions, 1 where missing. A sample is one group: its contigs are bounded
    with an error beyond. ``manual`` names tree nodes, comma-separated, for every sample.
    """
    if not 0 < cutoff < 1:
        raise ValueError("the cutoff must lie between 0 and 1")
    if min_assemblies is not None and min_assemblies < 1:
        raise ValueError("at least one assembly is needed")
    picked = manual_nodes(manual)

    def run(own: pd.DataFrame, contigs: list[Contig], known: dict) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in _OUT.split(", ")])
        check_contigs(contigs, max_contigs)
        _, found = clustered(contigs, known, cutoff, min_assemblies, picked)
        sample = own["sample_id"].iloc[0]
        rows = [(sample, x.id, c.node, c.number, c.passed, c.reasons, c.distance) for c in found for x in c.contigs]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])

    return seqs.withColumn("seq_id", F.col("seq_id").cast("bigint")).join(_samples(seqs, distances, run, _OUT), ["sample_id", "seq_id"])


def trees(seqs: DataFrame, distances: DataFrame) -> DataFrame:
    """sample_id, newick: the tree of every sample, tips named by number, file, contig and length."""
    labels = seqs.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("seq_id").cast("bigint"), contig_label()))).alias("labels"))

    def run(own: pd.DataFrame, contigs: list[Contig], known: dict) -> pd.DataFrame:
        from ..operators.clustering import tree_of

        tree = tree_of(contigs, known)
        return pd.DataFrame([(own["sample_id"].iloc[0], tree.newick({c.id: f"{{{c.id}}}" for c in contigs}, 0.5))], columns=["sample_id", "shape"])

    shapes = _samples(seqs, distances, run, "sample_id string, shape string")
    named = shapes.join(labels, "sample_id")
    pieces = F.transform(F.split("shape", r"[{}]"), lambda x, i: F.when(i % 2 == 1, F.element_at("labels", x.try_cast("bigint"))).otherwise(x))
    return named.select("sample_id", F.array_join(pieces, "").alias("newick"))


def metrics(clusters: DataFrame) -> DataFrame:
    """One row per sample: counts and shares of clusters and contigs that pass and fail, balance,
    tightness and their mean. ``clusters`` as from :func:`cluster`."""
    keys = ["sample_id"]
    per = clusters.groupBy(*keys, "cluster").agg(F.first("passed").alias("passed"), F.first("distance").alias("dist"), F.count(F.lit(1)).alias("size"))
    many = lambda ok, what: F.sum(F.when(F.col("passed") == ok, what).otherwise(0)).cast("bigint")
    counts = per.groupBy(*keys).agg(
        many(True, F.lit(1)).alias("pass_cluster_count"), many(False, F.lit(1)).alias("fail_cluster_count"),
        many(True, F.col("size")).alias("pass_contig_count"), many(False, F.col("size")).alias("fail_contig_count"),
    )
    total = F.col("pass_contig_count") + F.col("fail_contig_count")
    rows = counts.join(D.balance(clusters, keys), keys).join(D.tightness(per, keys), keys)
    return rows.select(
        *keys, "pass_cluster_count", "fail_cluster_count", "pass_contig_count", "fail_contig_count",
        (F.col("pass_contig_count") / total).alias("pass_contig_fraction"), (F.col("fail_contig_count") / total).alias("fail_contig_fraction"),
        F.col("balance").alias("cluster_balance_score"), F.col("tightness").alias("cluster_tightness_score"),
        ((F.col("balance") + F.col("tightness")) / 2).alias("overall_clustering_score"),
    )


def cluster_metrics(clusters: DataFrame, prefix: str = "untrimmed_cluster") -> DataFrame:
    """sample_id, cluster, and the size, lengths, median, MAD and distance of every cluster."""
    lengths = F.col("lengths")
    per = clusters.groupBy("sample_id", "cluster").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq_id", "length"))), lambda x: x.length).alias("lengths"), F.first("distance").alias("d")
    )
    named = {"size": F.size(lengths), "lengths": lengths, "median": int_median(lengths), "mad": int_mad(lengths), "distance": F.col("d")}
    return per.select("sample_id", "cluster", *(c.alias(f"{prefix}_{n}") for n, c in named.items()))


#: Columns of the clustering table. Fixed values of the format.
TSV = ("node_name", "passing_clusters", "all_clusters", "sequence_id", "file_name", "contig_name", "length", "trusted", "cluster_weight", "consensus_weight")


def cluster_table(clusters: DataFrame) -> DataFrame:
    """sample_id and the ten columns of the clustering table as text, one row per contig."""
    text = lambda c: F.col(c).cast("string")
    own = (contig_label(), F.when(F.col("passed"), text("cluster")).otherwise("none"), text("cluster"), text("seq_id"), F.col("filename"), first_token(F.col("contig_header")), text("length"), text("trusted"), text("cluster_weight"), text("consensus_weight"))
    return clusters.select("sample_id", *(c.alias(n) for c, n in zip(own, TSV, strict=True)))


def write_cluster_table(clusters: DataFrame, path: str) -> None:
    """One tab-separated file with a header per sample, in the order of sequence numbers."""
    rows = cluster_table(clusters).repartition("sample_id").sortWithinPartitions("sample_id", F.col("sequence_id").cast("bigint"))
    rows.write.partitionBy("sample_id").option("sep", "\t").option("header", True).option("quote", "").csv(path)
