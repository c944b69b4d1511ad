"""Depth and topology tables that external assemblers write next to their contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flye_info(spark: SparkSession, path: str) -> DataFrame:
    """name, depth, circular of a tab-separated table (depth in column 3, Y/N in column 4)."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#"))
    return rows.select(p[0].alias("name"), p[2].cast("double").alias("depth"), (p[3] == "Y").alias("circular"))


def canu_info(spark: SparkSession, path: str) -> DataFrame:
    """name (tig and eight digits), depth (column 3) of a tab-separated table."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#"))
    return rows.select(F.format_string("tig%08d", p[0].cast("int")).alias("name"), p[2].cast("double").alias("depth"))


def graph_depths(lines: DataFrame) -> DataFrame:
    """name, seq, depth of segment lines with a ``dp:f:`` or ``rd:i:`` tag (null without one)."""
    depth = F.regexp_extract("value", r"\t(?:dp:f:|rd:i:)([0-9.]+)", 1)
    p = F.split("value", "\t")
    return lines.where(F.col("value").startswith("S\t")).select(p[1].alias("name"), p[2].alias("seq"), F.nullif(depth, F.lit("")).cast("double").alias("depth"))


def with_depths(contigs: DataFrame, info: DataFrame) -> DataFrame:
    """Contigs (name, ...) with the depth that their assembler states, null without one."""
    return contigs.join(info, "name", "left")


def canu_contigs(contigs: DataFrame) -> DataFrame:
    """Canu contigs (header, seq) without suggested repeats and bubbles; circular ones are cut to
    the range that ``trim=a-b`` gives."""
    kept = contigs.where(~F.col("header").rlike("suggestRepeat=yes|suggestBubble=yes"))
    low, high = (F.regexp_extract("header", r"trim=(\d+)-(\d+)", i) for i in (1, 2))
    cut = F.substr("seq", low.cast("int") + 1, high.cast("int") - low.cast("int"))
    return kept.withColumn("seq", F.when(F.col("header").contains("suggestCircular=yes") & (low != ""), cut).otherwise(F.col("seq")))
