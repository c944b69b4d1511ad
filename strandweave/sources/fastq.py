"""FASTQ with four-line records, read as text splits of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """filename, read_idx (from 0 in each file), name, seq, qual.

    Lines are numbered in two steps: within each split by their order, and by the line counts of
    the splits before it, so a large plain file is read by many tasks. Gzip files are told by
    their extension, as Hadoop does, and read by one task each. Blank lines at the end are left
    out; any other record without "@", "+" or a quality per letter is an error.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        F.col("value"), meta.file_name.alias("filename"), meta.file_block_start.alias("block"), F.monotonically_increasing_id().alias("mid")
    )
    lines = written(lines)
    blocks = lines.groupBy("filename", "block").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("filename").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("filename", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    numbered = lines.join(blocks, ["filename", "block"]).withColumn("line", F.col("mid") - F.col("first") + F.col("off"))
    part = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
    parts = [F.coalesce(part(i), F.lit("")).alias(name) for i, name in enumerate(["h", "seq", "sep", "qual"])]
    reads = numbered.groupBy("filename", F.floor(F.col("line") / 4).alias("read_idx")).agg(*parts)
    reads = reads.where(F.concat("h", "seq", "sep", "qual") != "")
    good = F.col("h").startswith("@") & F.col("sep").startswith("+") & (F.length("seq") == F.length("qual"))
    error = F.raise_error(F.concat("filename", F.lit(": record "), "read_idx", F.lit(" is not FASTQ of four lines"))).cast("boolean")
    reads = reads.where(F.when(good, True).otherwise(error))
    return reads.select("filename", "read_idx", F.regexp_extract("h", r"^@(\S*)", 1).alias("name"), F.upper("seq").alias("seq"), "qual")


def fastq_lines(reads: DataFrame, order: list[str]) -> DataFrame:
    """One ``value`` column with four-line records."""
    return reads.orderBy(*order).select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))
