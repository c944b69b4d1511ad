"""Unitig graphs from contigs: distributed compaction of the k-mer graph.

k-mers of both strands are numbered; an edge is compacted if it is the only one out of its start
and into its end and no contig starts or stops between the two. Chains are ranked by pointer
doubling, so a chain of n k-mers takes log2(n) joins; what reaches no head is a cycle and is cut
at its least k-mer. Of a chain and its reverse complement the one with the least k-mer stays.
Since k is odd and unitigs lose half a k at both ends, a unitig spells the middle letters of its
k-mers, and unitigs meet without overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.seq import reverse_complement
from ..session import written
from .kmers import kmer_positions


@dataclass
class UnitigGraph:
    """A compacted graph as tables, all keyed by sample_id.

    unitigs: sample_id, number, seq, depth; links: sample_id, src, dst (signed, both twins);
    path_steps: sample_id, seq_id, idx, unitig (signed), pos.
    """

    k: int
    unitigs: DataFrame
    links: DataFrame
    path_steps: DataFrame


def _ranked(nodes: DataFrame, prev: DataFrame) -> DataFrame:
    """id, head, rank (0 at the head) of chains; ``prev`` has (id, p), one row per inner edge."""
    left = nodes.select("id").join(prev, "id", "left")
    now = written(left.select("id", F.coalesce("p", "id").alias("ptr"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("bigint").alias("rank"), F.col("p").isNull().alias("done")))
    open_before = None
    while True:
        still = now.where("not done").count()
        if not still or still == open_before:
            return now
        jump = now.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("rank").alias("rank2"), F.col("done").alias("done2"))
        step = now.where("not done").join(jump, "ptr")
        step = step.select("id", F.col("ptr2").alias("ptr"), (F.col("rank") + F.col("rank2")).alias("rank"), F.col("done2").alias("done"))
        now = written(now.where("done").unionByName(step))
        open_before = still


def compact(seqs: DataFrame, k: int) -> UnitigGraph:
    """The unitig graph of contigs (sample_id, seq_id, seq[, padded_seq]); k is odd."""
    if k % 2 == 0:
        raise ValueError("k must be odd")
    places = written(kmer_positions(seqs, k))
    nodes = places.groupBy("sample_id", "kmer").agg(F.count(F.lit(1)).alias("depth"), F.min("pos").alias("least"))
    nodes = written(nodes.select("sample_id", "kmer", "depth", (F.col("least") == 0).alias("first"), F.monotonically_increasing_id().alias("id")))
    twin = nodes.select("sample_id", reverse_complement(F.col("kmer")).alias("kmer"), F.col("id").alias("rc"), F.col("first").alias("last"))
    nodes = written(nodes.join(twin, ["sample_id", "kmer"]))
    a = nodes.select("sample_id", F.col("id").alias("x"), F.col("rc").alias("xrc"), F.col("last").alias("x_last"), F.substring("kmer", 2, k - 1).alias("o"))
    b = nodes.select("sample_id", F.col("id").alias("y"), F.col("first").alias("y_first"), F.substring("kmer", 1, k - 1).alias("o"))
    edges = written(a.join(b, ["sample_id", "o"]).drop("o"))
    outs = edges.groupBy("x").agg(F.count(F.lit(1)).alias("outs"))
    ins = edges.groupBy("y").agg(F.count(F.lit(1)).alias("ins"))
    inner = edges.where(~F.col("x_last") & ~F.col("y_first") & (F.col("y") != F.col("xrc")))
    inner = inner.join(outs.where("outs = 1"), "x", "left_semi").join(ins.where("ins = 1"), "y", "left_semi")
    prev = written(inner.select(F.col("y").alias("id"), F.col("x").alias("p")))
    ranked = _ranked(nodes, prev)
    loops = ranked.where("not done").select("id")
    if not loops.isEmpty():
        ranked = _cut_loops(nodes, prev, ranked, written(loops))
    chain = written(nodes.join(ranked.select("id", F.col("ptr").alias("head"), "rank"), "id"))
    least = chain.groupBy("head").agg(F.min("kmer").alias("least"), F.max("rank").alias("top"))
    partner = chain.select("head", F.col("rc").alias("id")).join(chain.select("id", F.col("head").alias("other")), "id").select("head", "other").distinct()
    other = least.select(F.col("head").alias("other"), F.col("least").alias("other_least"))
    chosen = least.join(partner, "head").join(other, "other").where(F.col("least") <= F.col("other_least")).select("head", "top")
    half = k // 2
    mine = chain.join(chosen, "head")
    letters = F.sort_array(F.collect_list(F.struct("rank", F.substring("kmer", half + 1, 1).alias("c"))))
    made = mine.groupBy("sample_id", "head").agg(F.array_join(F.transform(letters, lambda x: x.c), "").alias("seq"), F.avg("depth").alias("depth"))
    order = Window.partitionBy("sample_id").orderBy(F.desc(F.length("seq")), "seq", F.desc("depth"), "head")
    unitigs = written(made.withColumn("number", F.row_number().over(order)))
    numbers = unitigs.select("head", "number")
    ends = mine.where((F.col("rank") == 0) | (F.col("rank") == F.col("top"))).join(numbers, "head")
    at_first, at_last = ends.where("rank = 0"), ends.where("rank = top")
    begins = written(
        at_first.select("sample_id", F.col("id").alias("y"), F.col("kmer"), F.col("number").alias("u"))
        .unionByName(at_last.select("sample_id", F.col("rc").alias("y"), reverse_complement(F.col("kmer")).alias("kmer"), (-F.col("number")).alias("u")))
    )
    stops = at_last.select(F.col("id").alias("x"), F.col("number").alias("src")).unionByName(at_first.select(F.col("rc").alias("x"), (-F.col("number")).alias("src")))
    links = edges.select("sample_id", "x", "y").join(stops, "x").join(begins.select("y", F.col("u").alias("dst")), "y")
    steps = places.where("strand").join(begins.select("sample_id", "kmer", "u"), ["sample_id", "kmer"])
    idx = F.row_number().over(Window.partitionBy("sample_id", "seq_id").orderBy("pos")) - 1
    steps = steps.select("sample_id", "seq_id", idx.alias("idx"), F.col("u").alias("unitig"), "pos")
    return UnitigGraph(k, unitigs.select("sample_id", "number", "seq", "depth"), written(links.select("sample_id", "src", "dst").distinct()), written(steps))


def _cut_loops(nodes: DataFrame, prev: DataFrame, ranked: DataFrame, loops: DataFrame) -> DataFrame:
    """Ranks with every cycle cut before its least k-mer."""
    from .components import components

    edges = prev.join(loops, "id", "left_semi").select(F.col("id").alias("u"), F.col("p").alias("v"))
    label = components(edges).select(F.col("a").alias("id"), "b")
    named = loops.join(label, "id", "left").select("id", F.coalesce("b", "id").alias("loop"))
    heads = named.join(nodes.select("id", "kmer"), "id").groupBy("loop").agg(F.min_by("id", "kmer").alias("id")).select("id")
    again = _ranked(loops, prev.join(loops, "id", "left_semi").join(heads, "id", "left_anti"))
    return ranked.where("done").unionByName(again)


def reconstruct(graph: UnitigGraph) -> DataFrame:
    """sample_id, seq_id, seq spelled by every path; the inverse of :func:`compact`."""
    spelled = graph.path_steps.withColumn("number", F.abs("unitig")).join(graph.unitigs.select("sample_id", "number", F.col("seq").alias("s")), ["sample_id", "number"])
    piece = F.when(F.col("unitig") > 0, F.col("s")).otherwise(reverse_complement(F.col("s")))
    ordered = F.sort_array(F.collect_list(F.struct("idx", piece.alias("p"))))
    return spelled.groupBy("sample_id", "seq_id").agg(F.array_join(F.transform(ordered, lambda x: x.p), "").alias("seq"))
