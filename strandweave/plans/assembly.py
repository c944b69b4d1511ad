"""The assembly subcommands as functions over tables, many samples and clusters in one job.

Big steps (k-mers, distances, read counting) are joins and aggregates in ``operators``. What
changes a compacted graph step by step runs on one row per graph, in Python, one graph at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import floor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..operators import distances as D
from ..operators import kmers as K
from ..operators.compaction import UnitigGraph, compact
from ..operators.clustering import whole_median
from ..operators.resolving import bridge_graph
from ..operators.resolving import resolve as resolve_graph
from ..operators.seqgraph import SeqGraph
from ..operators.trees import upgma
from ..operators.trimming import choose, trim_hairpin_end, trim_hairpin_start, trim_start_end

_GRAPH = (
    "unitigs array<struct<number: int, seq: string, depth: double, kind: string>>, links array<struct<src: int, dst: int>>, "
    "paths array<struct<seq_id: int, path: array<int>>>"
)


#: Graphs whose results leave a task together.
GRAPH_BATCH = 64


def graph_rows(unitigs: DataFrame, links: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, unitigs, links, paths: one row per graph. A graph is bounded by its sample's genome,
    not by the number of samples."""
    kind = F.col("type") if "type" in unitigs.columns else F.lit("other")
    u = unitigs.groupBy(*keys).agg(F.collect_list(F.struct("number", "seq", F.col("depth").cast("double").alias("depth"), kind.alias("kind"))).alias("unitigs"))
    li = links.groupBy(*keys).agg(F.collect_list(F.struct(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))).alias("links"))
    path = F.transform(F.sort_array(F.collect_list(F.struct("idx", F.col("unitig").cast("int").alias("x")))), lambda s: s.x)
    p = steps.groupBy(*keys, "seq_id").agg(path.alias("path")).groupBy(*keys).agg(F.collect_list(F.struct(F.col("seq_id").cast("int").alias("seq_id"), "path")).alias("paths"))
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    rows = u.join(li, keys, "left").join(p, keys, "left")
    return rows.select(*keys, "unitigs", empty("links", "array<struct<src: int, dst: int>>"), empty("paths", "array<struct<seq_id: int, path: array<int>>>"))


def map_graphs(rows: DataFrame, keys: list[str], edit: Callable[[SeqGraph, dict], SeqGraph], also: list[str] = ()) -> DataFrame:
    """Every graph row after ``edit(graph, values)``, the values of the keys and of the columns ``also``;
    results leave the task in small batches."""
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", " + _GRAPH

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[dict] = []
            for row in frame.to_dict("records"):
                graph = SeqGraph.of(
                    [(int(u["number"]), u["seq"], float(u["depth"]), u["kind"]) for u in row["unitigs"]],
                    [(int(x["src"]), int(x["dst"])) for x in row["links"]],
                    {int(p["seq_id"]): [int(x) for x in p["path"]] for p in row["paths"]},
                )
                graph = edit(graph, {k: row[k] for k in (*keys, *also)})
                out.append({
                    **{k: row[k] for k in keys},
                    "unitigs": [{"number": n, "seq": t.seq, "depth": t.depth, "kind": t.kind} for n, t in sorted(graph.tigs.items())],
                    "links": [{"src": x, "dst": y} for x, y in sorted(graph.links())],
                    "paths": [{"seq_id": s, "path": p} for s, p in sorted(graph.paths.items())],
                })
                if len(out) >= GRAPH_BATCH:
                    yield pd.DataFrame(out)
                    out = []
            if out:
                yield pd.DataFrame(out)

    return rows.mapInPandas(run, schema)


def unpacked(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unitigs, links, path steps) of graph rows."""
    u = rows.select(*keys, F.explode("unitigs").alias("u")).select(*keys, "u.number", "u.seq", "u.depth", F.col("u.kind").alias("type"))
    li = rows.select(*keys, F.explode("links").alias("l")).select(*keys, "l.src", "l.dst")
    p = rows.select(*keys, F.explode("paths").alias("p")).select(*keys, "p.seq_id", F.posexplode("p.path").alias("idx", "unitig"))
    return u, li, p


def compress(seqs: DataFrame, k: int = 51, repair: bool = True) -> DataFrame:
    """Graph rows (by sample_id) of assemblies, repeats expanded. ``seqs`` as from
    ``sources.fasta.assembly_sequences``; ignored contigs are left out."""
    if k % 2 == 0 or not 11 <= k <= 501:
        raise ValueError("k must be odd and from 11 to 501")
    used = seqs.where(~F.col("ignored")) if "ignored" in seqs.columns else seqs
    used = K.check_bases(used.select("sample_id", "seq_id", "seq"))
    graph: UnitigGraph = compact(K.repair_ends(used, k, apart=True) if repair else used, k)

    def expand(g: SeqGraph, _: dict) -> SeqGraph:
        g.expand_repeats()
        return g

    return map_graphs(graph_rows(graph.unitigs, graph.links, graph.path_steps, ["sample_id"]), ["sample_id"], expand)


def decompress(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq_id, seq: the sequences that the paths spell."""
    from ..functions.seq import reverse_complement

    unitigs, _, steps = unpacked(rows, keys)
    named = steps.withColumn("number", F.abs("unitig")).join(unitigs.select(*keys, "number", F.col("seq").alias("s")), [*keys, "number"])
    piece = F.when(F.col("unitig") > 0, F.col("s")).otherwise(reverse_complement(F.col("s")))
    ordered = F.sort_array(F.collect_list(F.struct("idx", piece.alias("p"))))
    return named.groupBy(*keys, "seq_id").agg(F.array_join(F.transform(ordered, lambda x: x.p), "").alias("seq"))


def pair_distances(rows: DataFrame) -> DataFrame:
    """sample_id, a, b, dist of sequences that share a unitig."""
    unitigs, _, steps = unpacked(rows, ["sample_id"])
    sized = steps.withColumn("number", F.abs("unitig")).join(unitigs.select("sample_id", "number", F.length("seq").alias("length")), ["sample_id", "number"])
    return D.containment(sized, ["sample_id"], "seq_id", "number", "length").drop("back")


def tree_clusters(distances: DataFrame, keys: list[str], cutoff: float = 0.2) -> DataFrame:
    """keys, seq, cluster, height: a UPGMA tree of symmetric distances per group, cut at half the
    cutoff. A group is the contigs of one sample; pairs that are not stored have distance 1."""
    if not 0 < cutoff < 1:
        raise ValueError("the cutoff must lie between 0 and 1")
    both = distances.where("b is not null").select(*keys, "a", "b", "dist")
    schema = ", ".join(f"{k} {both.schema[k].dataType.simpleString()}" for k in keys) + ", seq bigint, cluster int, height double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(frame["a"]))
        known = dict(zip(zip(frame["a"], frame["b"], strict=True), frame["dist"], strict=True))
        tree = upgma(ids, {(a, b): max(d, known.get((b, a), 1.0)) for (a, b), d in known.items() if a < b}, missing=1.0)
        tree.normalise()
        out = [{**{k: frame[k].iloc[0] for k in keys}, "seq": s, "cluster": i, "height": tree.height.get(n, 0.0)} for i, n in enumerate(tree.cut(cutoff), 1) for s in tree.tips(n)]
        return pd.DataFrame(out)

    return both.groupBy(*keys).applyInPandas(run, schema)


def cluster_graphs(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Graph rows by (sample_id, cluster): the paths of a cluster's sequences, what they do not
    visit removed, linear paths merged, renumbered. ``clusters`` has sample_id, seq, cluster."""
    members = clusters.groupBy("sample_id", "cluster").agg(F.collect_list("seq").alias("members"))
    pairs = rows.join(members, "sample_id")
    mine = F.filter("paths", lambda p: F.array_contains(F.col("members"), p.seq_id.cast("bigint")))
    keyed = pairs.select("sample_id", "cluster", "unitigs", "links", mine.alias("paths"))

    def extract(g: SeqGraph, _: dict) -> SeqGraph:
        g.keep_paths(list(g.paths))
        g.merge_linear_paths()
        g.renumber()
        return g

    return map_graphs(keyed, ["sample_id", "cluster"], extract)


def trim(rows: DataFrame, min_identity: float = 0.75, max_unitigs: int = 5000, mad: float = 5.0) -> DataFrame:
    """Cluster graphs after start-end or hairpin trimming (the kind that more sequences have) and
    without sequences of outlying length."""
    if not 0 <= min_identity <= 1 or mad < 0:
        raise ValueError("the identity must be from 0 to 1 and mad not negative")

    def edit(g: SeqGraph, _: dict) -> SeqGraph:
        weight = {n: len(t.seq) for n, t in g.tigs.items()}
        circular = {k: trim_start_end(p, weight, min_identity, max_unitigs) for k, p in g.paths.items()}
        hairpin = {}
        for k, p in g.paths.items():
            start = trim_hairpin_start(p, weight, min_identity, max_unitigs)
            end = trim_hairpin_end(start or p, weight, min_identity, max_unitigs)
            hairpin[k] = end or start
        g.paths |= choose(circular, hairpin)
        size = {k: sum(weight[abs(x)] for x in p) for k, p in g.paths.items()}
        middle = whole_median(list(size.values()))
        spread = whole_median([abs(s - middle) for s in size.values()])
        if mad:
            # halves away from zero, as in stats.length_outliers
            low, high = floor(max(0.0, middle - mad * spread) + 0.5), floor(middle + mad * spread + 0.5)
            g.paths = {k: p for k, p in g.paths.items() if low <= size[k] <= high}
        g.keep_paths(list(g.paths))
        g.merge_linear_paths()
        g.renumber()
        return g

    return map_graphs(rows, ["sample_id", "cluster"], edit)


def resolve(rows: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Cluster graphs after bridging anchors, culling conflicts and merging. ``weights`` has
    sample_id, seq_id, consensus_weight: how often a sequence's path counts in the vote."""
    return _with_weights(rows, weights, lambda g, w: resolve_graph(g, w)[1])


def bridged(rows: DataFrame, weights: DataFrame | None = None, merge: bool = False) -> DataFrame:
    """Cluster graphs with the bridges that conflict with none; with ``merge``, linear paths merged:
    the steps before conflicts are culled."""
    return _with_weights(rows, weights, lambda g, w: bridge_graph(g, w, merge))


def _with_weights(rows: DataFrame, weights: DataFrame | None, edit: Callable) -> DataFrame:
    keys = ["sample_id", "cluster"]
    if weights is None:
        return map_graphs(rows, keys, lambda g, _: edit(g, {}))
    named = weights.select("sample_id", F.col("seq_id").cast("int").alias("seq_id"), F.col("consensus_weight").cast("int").alias("weight"))
    own = rows.select(*keys, F.explode("paths.seq_id").alias("seq_id")).join(named, ["sample_id", "seq_id"])
    own = own.groupBy(*keys).agg(F.collect_list(F.struct("seq_id", "weight")).alias("weights"))
    weighted = rows.join(own, keys, "left")
    return map_graphs(weighted, keys, lambda g, row: edit(g, {int(x["seq_id"]): int(x["weight"]) for x in (row["weights"] if row["weights"] is not None else ())}), ["weights"])


def combine(rows: DataFrame) -> DataFrame:
    """sample_id, number, cluster, seq, depth: unitigs of all clusters of a sample, clusters by
    total length downwards, numbers moved on by the numbers used before."""
    unitigs, _, _ = unpacked(rows, ["sample_id", "cluster"])
    per = unitigs.groupBy("sample_id", "cluster").agg(F.max("number").alias("top"), F.sum(F.length("seq")).alias("size"))
    before = Window.partitionBy("sample_id").orderBy(F.desc("size"), "cluster").rowsBetween(Window.unboundedPreceding, -1)
    offset = per.select("sample_id", "cluster", F.coalesce(F.sum("top").over(before), F.lit(0)).alias("off"))
    return unitigs.join(offset, ["sample_id", "cluster"]).select("sample_id", (F.col("number") + F.col("off")).cast("int").alias("number"), "cluster", "seq", "depth")


def clean(rows: DataFrame, keys: list[str], remove: list[int] = (), duplicate: list[int] = (), min_depth: float | None = None) -> DataFrame:
    """Graphs after removing and duplicating unitigs, dropping those of ``min_depth`` or less (see
    ``SeqGraph.remove_low_depth``) and merging. Paths do not outlive such edits and are left out."""

    def edit(g: SeqGraph, _: dict) -> SeqGraph:
        for n in (*remove, *duplicate):
            if n not in g.tigs:
                raise ValueError(f"no unitig {n}")
        g.paths = {}
        g.remove(remove)
        for n in duplicate:
            g.duplicate(n)
        if min_depth is not None:
            g.remove_low_depth(min_depth)
        g.merge_linear_paths()
        g.renumber()
        return g

    return map_graphs(rows, keys, edit)


def subsample(reads: DataFrame, genome_size: int, count: int = 4, min_read_depth: float = 25.0, seed: int = 0) -> DataFrame:
    """(subset, read columns) of reads (read_id, seq): subsets of a depth that grows with the log
    of the total depth. Too little depth in all is an error."""
    from ..operators.reads import shuffled_subsets

    if count < 2 or min_read_depth <= 0:
        raise ValueError("count must be 2 or more and the depth positive")
    total, n = reads.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)), F.count(F.lit(1))).first()
    if total / genome_size < min_read_depth:
        raise ValueError(f"reads have a depth of {total / genome_size:.1f}; {min_read_depth} is needed")
    per = stats.subset_reads(F.lit(float(total)), F.lit(n), F.lit(float(genome_size)), min_read_depth)
    return shuffled_subsets(reads, "read_id", count, per, seed)
