"""Graphs and sequences of many samples as lines of the exchange formats, and the combined assembly.

Lines carry the keys of their graph, so ``write_lines`` puts every graph into a folder of its own
in one job, whatever their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.seq import fixed, signed_text
from ..functions.stats import weighted_mean
from ..operators.paths import topology
from ..sources.gfa import COLOURS
from .assembly import unpacked


def write_lines(lines: DataFrame, keys: list[str], path: str, compression: str | None = None) -> None:
    """``value`` lines into ``path/key=.../``, in the order of ``place``; one file per folder."""
    rows = lines.repartition(*keys).sortWithinPartitions(*keys, "place").select(*keys, "value")
    rows.write.partitionBy(*keys).option("compression", compression or "none").text(path)


def _place(kind: int, *parts: Column) -> Column:
    return F.array(F.lit(kind).cast("bigint"), *(p.cast("bigint") for p in parts)).alias("place")


def _segment(depth: Column, other: bool) -> Column:
    known = {k: v for k, v in COLOURS.items() if other or k != "other"}
    colour = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))[F.col("type")]
    return F.concat(F.lit("S\t"), "number", F.lit("\t"), "seq", F.lit("\tDP:f:"), fixed(depth, 2), F.coalesce(F.concat(F.lit("\tCL:Z:"), colour), F.lit("")))


def _link() -> Column:
    side = lambda c: F.concat(F.abs(c).cast("string"), F.lit("\t"), F.when(F.col(c) > 0, "+").otherwise("-"))
    return F.concat(F.lit("L\t"), side("src"), F.lit("\t"), side("dst"), F.lit("\t0M"))


def _link_place() -> list[Column]:
    return [F.abs("src"), F.when(F.col("src") > 0, 0).otherwise(1), F.abs("dst"), F.when(F.col("dst") > 0, 0).otherwise(1)]


def graph_lines(rows: DataFrame, keys: list[str], seqs: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """keys, place, value: every graph's header, segments, links and, with ``seqs`` (keys of a sample,
    seq_id, filename, contig_header, length), paths."""
    unitigs, links, steps = unpacked(rows, keys)
    head = rows.select(*keys, _place(0), F.lit("H\tVN:Z:1.0" + (f"\tKM:i:{k}" if k else "")).alias("value"))
    seg = unitigs.select(*keys, _place(1, F.col("number")), _segment(F.col("depth"), False).alias("value"))
    link = links.select(*keys, _place(2, *_link_place()), _link().alias("value"))
    out = head.unionByName(seg).unionByName(link)
    if seqs is None:
        return out
    paths = rows.select(*keys, F.explode("paths").alias("p")).select(*keys, "p.seq_id", "p.path")
    sample = [c for c in keys if c in seqs.columns]
    named = paths.join(seqs.select(*sample, F.col("seq_id").cast("int").alias("seq_id"), "filename", "contig_header", "length"), [*sample, "seq_id"])
    cluster = F.concat(F.lit("\tCL:i:"), "cluster") if "cluster" in keys else F.lit("")
    value = F.concat(F.lit("P\t"), "seq_id", F.lit("\t"), signed_text(F.col("path")), F.lit("\t*\tLN:i:"), "length", F.lit("\tFN:Z:"), "filename", F.lit("\tHD:Z:"), "contig_header", cluster)
    return out.unionByName(named.select(*keys, _place(3, F.col("seq_id")), value.alias("value")))


def cluster_lines(rows: DataFrame, clusters: DataFrame, k: int | None = None) -> DataFrame:
    """sample_id, qc (qc_pass or qc_fail), folder (cluster_001, ...), place, value: the graph of every
    cluster. ``rows`` as from ``assembly.cluster_graphs``, ``clusters`` from ``clustering.cluster``."""
    passed = clusters.groupBy("sample_id", "cluster").agg(F.first("passed").alias("passed"))
    lines = graph_lines(rows, ["sample_id", "cluster"], clusters.drop("cluster"), k).join(passed, ["sample_id", "cluster"])
    qc = F.when(F.col("passed"), "qc_pass").otherwise("qc_fail")
    return lines.select("sample_id", qc.alias("qc"), F.format_string("cluster_%03d", "cluster").alias("folder"), "place", "value")


# ---------------------------------------------------------------- combined assemblies


@dataclass
class Combined:
    """unitigs: sample_id, number, cluster, seq, depth, read_depth, type, shape (circular, linear or
    empty). links: sample_id, src, dst. clusters: sample_id, cluster, place (from 1), length, unitigs,
    topology, read_depth. totals: sample_id and the metrics of the whole assembly."""

    unitigs: DataFrame
    links: DataFrame
    clusters: DataFrame
    totals: DataFrame


def unitig_shapes(unitigs: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """``unitigs`` with ``shape``: circular (one link, from its end to its beginning), linear (no
    links but hairpins, one an end) or empty."""
    own = F.count_if
    flags = links.groupBy(*keys, F.abs("src").alias("number")).agg(
        own(F.col("src") > 0).alias("after"), own(F.col("src") < 0).alias("before"), own(F.col("src") == F.col("dst")).alias("loops"),
        own(F.abs("src") != F.abs("dst")).alias("others"),
    )
    rows = unitigs.join(flags, [*keys, "number"], "left").na.fill(0, ["after", "before", "loops", "others"])
    single = (F.col("after") <= 1) & (F.col("before") <= 1) & (F.col("others") == 0)
    shape = F.when(single & (F.col("loops") == 2), "circular").when(single & (F.col("loops") == 0), "linear").otherwise("")
    return rows.withColumn("shape", shape).drop("after", "before", "loops", "others")


def combined(rows: DataFrame, read_depths: DataFrame | None = None) -> Combined:
    """The clusters of every sample as one assembly: the longest cluster first (ties: the lesser
    number), unitig numbers and links moved on by the numbers used before. ``read_depths`` has
    sample_id, cluster, number, read_depth (null: no usable k-mer)."""
    keys = ["sample_id", "cluster"]
    unitigs, links, _ = unpacked(rows, keys)
    given = read_depths.select(*keys, "number", "read_depth") if read_depths is not None else None
    unitigs = unitigs.join(given, [*keys, "number"], "left") if given is not None else unitigs.withColumn("read_depth", F.lit(None).cast("double"))
    shaped = unitig_shapes(unitigs, links, keys).withColumn("length", F.length("seq").cast("bigint"))
    per = shaped.groupBy(*keys).agg(F.max("number").alias("top"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("unitigs"))
    order = Window.partitionBy("sample_id").orderBy(F.desc("length"), "cluster")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("off", F.coalesce(F.sum("top").over(before), F.lit(0)).cast("int")).withColumn("place", F.row_number().over(order))
    depth = weighted_mean(shaped, keys, "read_depth", "length", "read_depth")
    clusters = per.join(topology(unitigs, links, keys), keys).join(depth, keys)
    moved = lambda c: F.col(c) + F.signum(c).cast("int") * F.col("off")
    off = per.select(*keys, "off")
    totals = per.groupBy("sample_id").agg(
        F.sum("length").cast("bigint").alias("consensus_assembly_bases"), F.sum("unitigs").cast("bigint").alias("consensus_assembly_unitigs"),
        (F.max(F.abs(F.col("unitigs") - 1)) == 0).alias("consensus_assembly_fully_resolved"),
    )
    return Combined(
        shaped.join(off, keys).select("sample_id", (F.col("number") + F.col("off")).cast("int").alias("number"), "cluster", "seq", "depth", "read_depth", "type", "shape"),
        links.join(off, keys).select("sample_id", moved("src").cast("int").alias("src"), moved("dst").cast("int").alias("dst")),
        clusters.select(*keys, "place", "length", "unitigs", "topology", "read_depth"),
        totals,
    )


def combined_fasta(whole: Combined, with_depths: bool) -> DataFrame:
    """sample_id, place, value: FASTA records with length, depth (with ``with_depths``; unavailable
    without a usable k-mer), and the topology of isolated unitigs."""
    shown = F.when(F.col("read_depth").isNull(), " depth=unavailable").otherwise(F.concat(F.lit(" depth="), fixed(F.col("read_depth"), 1)))
    depth = shown if with_depths else F.lit("")
    shape = F.when(F.col("shape") == "circular", " circular=true topology=circular").when(F.col("shape") == "linear", " circular=false topology=linear").otherwise("")
    header = F.concat(F.lit(">"), "number", F.lit(" length="), F.length("seq"), depth, shape)
    return whole.unitigs.select("sample_id", _place(0, F.col("number")), F.concat(header, F.lit("\n"), "seq").alias("value"))


def combined_gfa(whole: Combined, with_depths: bool) -> DataFrame:
    """sample_id, place, value: GFA lines; every segment has a colour, and the read depth if asked for
    (0 where there is none, since the tag must be a number)."""
    depth = F.coalesce("read_depth", F.lit(0.0)) if with_depths else F.col("depth")
    head = whole.totals.select("sample_id", _place(0), F.lit("H\tVN:Z:1.0").alias("value"))
    seg = whole.unitigs.select("sample_id", _place(1, F.col("number")), _segment(depth, True).alias("value"))
    return head.unionByName(seg).unionByName(whole.links.select("sample_id", _place(2, *_link_place()), _link().alias("value")))


# ---------------------------------------------------------------- sequences


def original_files(sequences: DataFrame, seqs: DataFrame) -> DataFrame:
    """sample_id, filename, place, value: the records of every input file. ``sequences`` has
    sample_id, seq_id, seq (see ``assembly.decompress``), ``seqs`` the names. For ``write_lines`` by
    filename, with gzip for names that end so."""
    named = sequences.join(seqs.select("sample_id", "seq_id", "filename", "contig_header"), ["sample_id", "seq_id"])
    return named.select("sample_id", "filename", _place(0, F.col("seq_id")), F.concat(F.lit(">"), "contig_header", F.lit("\n"), "seq").alias("value"))


def original_file(sequences: DataFrame, seqs: DataFrame) -> DataFrame:
    """sample_id, place, value: all records of a sample in one file, each header after its file's name
    (blanks as underscores)."""
    named = sequences.join(seqs.select("sample_id", "seq_id", "filename", "contig_header"), ["sample_id", "seq_id"])
    header = F.concat(F.lit(">"), F.replace(F.col("filename"), F.lit(" "), F.lit("_")), F.lit("__"), "contig_header")
    return named.select("sample_id", _place(0, F.col("seq_id")), F.concat(header, F.lit("\n"), "seq").alias("value"))


def subset_files(subsets: DataFrame) -> DataFrame:
    """folder (sample_01, ...), place, value: four-line records of read subsets (subset, read_idx, name,
    seq, qual)."""
    value = F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    return subsets.select(F.format_string("sample_%02d", "subset").alias("folder"), _place(0, F.col("read_idx")), value.alias("value"))
