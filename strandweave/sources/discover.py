"""What an input is, and which metric records a run left behind."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fasta import read_fasta, unzipped
from .gfa import path_steps, read_gfa
from .yamlio import load


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def input_kind(spark: SparkSession, path: str) -> str:
    """``directory``, ``fasta`` or ``gfa``, a file by its first character that is no blank."""
    where, fs = _hadoop(spark, path)
    if not fs.exists(where):
        raise ValueError(f"{path} is neither a file nor a directory")
    if fs.getFileStatus(where).isDirectory():
        return "directory"
    if fs.getFileStatus(where).getLen() == 0:
        raise ValueError(f"{path} is empty")
    data = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 2).alias("head")).first()["head"]
    if bytes(data) == b"\x1f\x8b":
        whole = spark.read.format("binaryFile").load(path).first()["content"]
        start = unzipped(bytes(whole))[:4096].decode("utf-8", "replace").lstrip()
    else:
        line = spark.read.text(path).where(F.trim("value") != "").first()
        start = line["value"].lstrip() if line else ""
    kinds = {">": "fasta", "H": "gfa", "S": "gfa"}
    if start[:1] not in kinds:
        raise ValueError(f"{path} is neither GFA nor FASTA")
    return kinds[start[:1]]


def plot_sequences(spark: SparkSession, path: str) -> DataFrame:
    """filename, name, seq of a graph's paths, a FASTA file or a directory of assemblies."""
    if input_kind(spark, path) != "gfa":
        return read_fasta(spark, path).select("filename", "name", "seq")
    from ..functions.seq import first_token, reverse_complement

    gfa = read_gfa(spark, path)
    units = gfa.unitigs.select(F.col("number").alias("n"), "seq")
    piece = F.when(F.col("unitig") > 0, F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    steps = path_steps(gfa).withColumn("n", F.abs("unitig")).join(units, "n")
    spelled = steps.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("idx", piece.alias("s")))).alias("p"))
    spelled = spelled.select("seq_id", F.array_join(F.transform("p", lambda x: x.s), "").alias("seq"))
    return gfa.paths.join(spelled, "seq_id").select("filename", first_token(F.col("header")).alias("name"), "seq")


def yaml_records(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, content of all ``.yaml`` files below a folder."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.yaml").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return found.select(path.alias("path"), F.regexp_extract(path, r"([^/]*)$", 1).alias("filename"), F.col("value").alias("content"))


def one_copy(records: DataFrame, filename: str) -> dict[str, Any] | None:
    """The record of that name, None without one; two or more are an error."""
    rows = records.where(F.col("filename") == filename).limit(2).collect()
    if len(rows) > 1:
        raise ValueError(f"several {filename} files were found")
    return load(rows[0]["content"]) if rows else None


def multi_copy(records: DataFrame, filename: str) -> list[dict[str, Any]]:
    """All records of that name in the order of their paths, those of failed clusters left out.
    A run has one for each cluster at most."""
    rows = records.where((F.col("filename") == filename) & ~F.col("path").contains("/qc_fail/"))
    return [load(r["content"]) for r in rows.orderBy("path").collect()]
