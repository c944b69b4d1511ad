"""GFA: lines to tables and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.seq import fixed, reverse_path, signed_path, signed_text

#: Colour tags of unitig kinds. Fixed values of the format.
COLOURS = {"anchor": "forestgreen", "bridge": "pink", "consentig": "steelblue", "other": "orangered"}


@dataclass
class Gfa:
    """header (k), unitigs (number, seq, depth, type), links (src, dst), paths (seq_id, path,
    length, filename, header, cluster)."""

    header: DataFrame
    unitigs: DataFrame
    links: DataFrame
    paths: DataFrame


def _tag(parts: Column, tag: str) -> Column:
    """Value of ``tag`` (such as ``DP:f:``) among the optional fields, null without it."""
    return F.get(F.transform(F.filter(parts, lambda p: p.startswith(tag)), lambda p: F.substr(p, F.lit(len(tag) + 1))), F.lit(0))


def parse_gfa(lines: DataFrame) -> Gfa:
    """Tables of GFA lines (column ``value``). Segments need DP; links must be ``0M``; paths need
    LN, FN and HD. Other line types are left out. The source may be read once per table."""
    parts = lines.select(F.split("value", "\t").alias("p"))
    of = lambda kind: parts.where(F.col("p")[0] == kind)
    # a filter on the result may run before the one on the line's type: only own lines are judged
    need = lambda kind, value, text: F.when(F.col("p")[0] == kind, F.coalesce(value, F.raise_error(F.lit(text)).cast("string")))
    p = F.col("p")
    at = lambda i: F.get(p, F.lit(i))
    colour = _tag(p, "CL:Z:")
    kind = F.lit("other")
    for name, value in COLOURS.items():
        kind = F.when(colour == value, name).otherwise(kind)
    unitigs = of("S").select(
        at(1).try_cast("int").alias("number"), at(2).alias("seq"), need("S", _tag(p, "DP:f:"), "a segment has no depth").try_cast("double").alias("depth"), kind.alias("type")
    )
    signed = lambda n, s: n.try_cast("int") * F.when(s == "-", -1).otherwise(1)
    zero = F.when((at(0) != "L") | (at(5) == "0M"), F.lit(1)).otherwise(F.raise_error(F.lit("links must not overlap")).cast("int"))
    links = of("L").select((signed(at(1), at(2)) * zero).alias("src"), signed(at(3), at(4)).alias("dst"))
    paths = of("P").select(
        at(1).try_cast("int").alias("seq_id"), signed_path(at(2)).alias("path"), need("P", _tag(p, "LN:i:"), "a path has no length").try_cast("bigint").alias("length"),
        need("P", _tag(p, "FN:Z:"), "a path has no file name").alias("filename"), need("P", _tag(p, "HD:Z:"), "a path has no header").alias("header"),
        F.coalesce(_tag(p, "CL:i:").try_cast("int"), F.lit(0)).alias("cluster"),
    )
    return Gfa(of("H").select(_tag(p, "KM:i:").try_cast("int").alias("k")), unitigs, links, paths)


def read_gfa(spark: SparkSession, path: str) -> Gfa:
    return parse_gfa(spark.read.text(path))


def unknown_links(gfa: Gfa) -> DataFrame:
    """Links that name a unitig which does not exist; empty for a sound file."""
    ids = gfa.unitigs.select(F.col("number").alias("n"))
    bad = gfa.links.withColumn("n", F.abs("src")).join(ids, "n", "left_anti")
    return bad.unionByName(gfa.links.withColumn("n", F.abs("dst")).join(ids, "n", "left_anti")).select("src", "dst")


def path_steps(gfa: Gfa, strand: bool = True) -> DataFrame:
    """seq_id, idx, unitig (signed), pos on the given strand; a path's end must be its length."""
    path = F.col("path") if strand else reverse_path(F.col("path"))
    steps = gfa.paths.select("seq_id", "length", F.posexplode(path).alias("idx", "unitig"))
    sized = steps.withColumn("n", F.abs("unitig")).join(gfa.unitigs.select(F.col("number").alias("n"), F.length("seq").alias("l")), "n")
    run = F.sum("l").over(Window.partitionBy("seq_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("l").over(Window.partitionBy("seq_id"))
    sound = F.when(total == F.col("length"), (run - F.col("l")).cast("bigint")).otherwise(F.raise_error(F.lit("a path's length is wrong")).cast("bigint"))
    return sized.withColumn("pos", sound).select("seq_id", "idx", "unitig", "pos")


def gfa_lines(gfa: Gfa, k: int | None) -> DataFrame:
    """``value`` lines in order: header, segments by number, links, paths."""
    spark = gfa.unitigs.sparkSession
    head = spark.range(1).select(F.lit("H\tVN:Z:1.0" + (f"\tKM:i:{k}" if k else "")).alias("value"), F.lit(0).alias("o"), F.lit(0).alias("a"), F.lit("").alias("b"))
    colour = F.create_map(*(F.lit(x) for kv in COLOURS.items() if kv[0] != "other" for x in kv))[F.col("type")]
    seg = gfa.unitigs.select(
        F.concat(F.lit("S\t"), "number", F.lit("\t"), "seq", F.lit("\tDP:f:"), fixed(F.col("depth"), 2), F.coalesce(F.concat(F.lit("\tCL:Z:"), colour), F.lit(""))).alias("value"),
        F.lit(1).alias("o"), F.col("number").alias("a"), F.lit("").alias("b"),
    )
    side = lambda c: F.concat(F.abs(c).cast("string"), F.lit("\t"), F.when(F.col(c) > 0, "+").otherwise("-"))
    link = gfa.links.select(F.concat(F.lit("L\t"), side("src"), F.lit("\t"), side("dst"), F.lit("\t0M")).alias("value"), F.lit(2).alias("o"), F.abs("src").alias("a"), F.concat((F.col("src") < 0).cast("string"), F.lit(" "), F.lpad(F.abs("dst").cast("string"), 10, "0"), (F.col("dst") < 0).cast("string")).alias("b"))
    path = gfa.paths.select(
        F.concat(F.lit("P\t"), "seq_id", F.lit("\t"), signed_text(F.col("path")), F.lit("\t*\tLN:i:"), "length", F.lit("\tFN:Z:"), "filename", F.lit("\tHD:Z:"), "header", F.when(F.col("cluster") > 0, F.concat(F.lit("\tCL:i:"), "cluster")).otherwise("")).alias("value"),
        F.lit(3).alias("o"), F.col("seq_id").alias("a"), F.lit("").alias("b"),
    )
    return head.unionByName(seg).unionByName(link).unionByName(path).orderBy("o", "a", "b").select("value")


def segment_fasta(gfa: Gfa) -> DataFrame:
    """number, header, seq, topology of segments as FASTA records; empty sequences are left out."""
    loops = gfa.links.where("src = dst and src > 0").select(F.col("src").alias("number")).distinct().withColumn("loop", F.lit(True))
    other = gfa.links.where("abs(src) <> abs(dst)").select(F.abs("src").alias("number")).distinct().withColumn("more", F.lit(True))
    any_ = gfa.links.select(F.abs("src").alias("number")).unionByName(gfa.links.select(F.abs("dst").alias("number"))).distinct().withColumn("any", F.lit(True))
    rows = gfa.unitigs.where("seq <> ''")
    for extra in (loops, other, any_):
        rows = rows.join(extra, "number", "left")
    shape = F.when(F.col("loop") & F.col("more").isNull(), "circular").when(F.col("any").isNull(), "linear").otherwise("other")
    header = F.concat_ws(" ", F.col("number").cast("string"), F.concat(F.lit("length="), F.length("seq")), F.concat(F.lit("depth="), fixed(F.col("depth"), 1)), F.when(shape != "other", F.concat(F.lit("topology="), shape)))
    return rows.select("number", header.alias("header"), "seq", shape.alias("topology"))
