"""Read depths of consensus graphs: reads against the k-mers of all graphs together."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import depth as W
from ..operators import kmers as K
from ..operators import reads as R
from ..operators.seqgraph import SeqGraph


def _graph(row: dict) -> SeqGraph:
    return SeqGraph.of(
        [(int(u["number"]), u["seq"], float(u["depth"]), u["kind"]) for u in row["unitigs"]], [(int(x["src"]), int(x["dst"])) for x in row["links"]]
    )


def read_depths(rows: DataFrame, reads: DataFrame, k: int = 19) -> DataFrame:
    """sample_id, cluster, number, read_depth of the unitigs in graph rows, samples apart.

    ``reads`` has sample_id, read_id, seq; without sample_id they belong to every sample. In a sample,
    repeats are told over all clusters together; its scale is span bases over hits. Unitigs without
    a usable k-mer have a null depth. A sample without any read that matches is an error.
    """
    if k % 2 == 0 or not 11 <= k <= 31:
        raise ValueError("k must be odd and from 11 to 31")
    keys = ["sample_id", "cluster"]
    schema = "sample_id string, cluster int, number int, offset int, kmer string, source string"
    if "sample_id" not in reads.columns:
        reads = reads.join(rows.select("sample_id").distinct())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                g = _graph(row)
                out = [(n, o, x, "tig") for n, o, x in W.tig_kmer_rows(g, k)] + [(0, 0, x, "table") for x in W.assembly_kmers(g, k)]
                made = pd.DataFrame(out, columns=["number", "offset", "kmer", "source"])
                yield made.assign(sample_id=row["sample_id"], cluster=int(row["cluster"]))[["sample_id", "cluster", "number", "offset", "kmer", "source"]]

    # a k-mer of one sample is another one in the next: the sample goes into the key
    in_sample = lambda c: F.struct("sample_id", F.col(c).alias("x"))
    made = rows.select(*keys, "unitigs", "links").mapInPandas(run, schema).withColumn("kmer", in_sample("kmer"))
    table = made.where("source = 'table'").groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    exploded = R.canonical_read_kmers(K.explode_kmers(reads, ["sample_id", "read_id"], "seq", k))
    exploded = exploded.select(in_sample("read_id").alias("read_id"), "pos", in_sample("kmer").alias("kmer"))
    lengths = reads.select(in_sample("read_id").alias("read_id"), F.length("seq").alias("length"))
    hits = R.read_hits(exploded, table, k).join(lengths, "read_id").withColumn("sample_id", F.col("read_id.sample_id"))
    totals = R.read_totals(hits, ["sample_id"])
    scales = rows.select("sample_id").distinct().join(totals, "sample_id", "left")
    none = F.coalesce("hits", F.lit(0)) == 0
    failed = F.raise_error(F.concat(F.lit("no read matches the assembly of "), F.col("sample_id"))).cast("double")
    scales = scales.select("sample_id", F.when(none, failed).otherwise(F.col("span_bases") / F.col("hits")).alias("scale"))
    used = exploded.join(hits.where("used").select("read_id"), "read_id", "left_semi")
    counts = used.join(table.select("kmer"), "kmer", "left_semi").groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    tig = made.where("source = 'tig'").select(F.struct(*keys, "number").alias("tig"), "offset", "kmer")
    depths = R.tig_depths(tig, counts, K.repeat_kmers(table), 1.0).select("tig.*", F.col("read_depth").alias("mean"))
    all_ = rows.select(*keys, F.explode("unitigs.number").alias("number")).join(scales, "sample_id")
    return all_.join(depths, [*keys, "number"], "left").select(*keys, "number", (F.col("mean") * F.col("scale")).alias("read_depth"))
