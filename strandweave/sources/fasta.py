"""FASTA: directories or files, plain or gzip, to one row per sequence."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.seq import clean_header, directive, is_ignored, is_trusted
from ..session import small_or_not, written

SCHEMA = "filename string, record int, name string, header string, seq string"
#: File names that count as assemblies; a trailing .gz is allowed.
_ASSEMBLY = r"\.(?:fasta|fna|fa)(?:\.gz)?$"


def unzipped(data: bytes) -> bytes:
    """Content of a file, gzip told by its first two bytes, not by the file's name."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def records(data: bytes) -> Iterator[tuple[str, str, str]]:
    """(name, header, sequence): lines joined, blank lines skipped, letters made upper case."""
    header, parts = None, []
    for raw in io.BytesIO(unzipped(data)):
        line = raw.decode("utf-8", "replace").strip()
        if line.startswith(">"):
            if header is not None:
                yield header.split()[0] if header.split() else "", header, "".join(parts).upper()
            header, parts = line[1:], []
        elif line:
            if header is None:
                raise ValueError("a FASTA file must begin with '>'")
            parts.append(line)
    if header is not None:
        yield header.split()[0] if header.split() else "", header, "".join(parts).upper()


def read_fasta(spark: SparkSession, path: str, allow_empty: bool = False) -> DataFrame:
    """Sequences of a FASTA file or of all assemblies in a directory (not below it).

    Any store Spark reads will do. A file is parsed by one task. Empty files, files without
    sequences, sequences without name or letters, and names repeated within a file are errors
    unless ``allow_empty``.
    """
    if not allow_empty and (empty := _empty_files(spark, path)):
        raise ValueError(f"{empty[0]} is empty")
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), "content")
    files = files.where(F.col("filename").rlike(_ASSEMBLY) | (F.lit(path).endswith(F.col("filename"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for filename, content in zip(batch.column("filename").to_pylist(), batch.column("content"), strict=True):
                rows = [(filename, i, *r) for i, r in enumerate(records(content.as_py()))]
                if not allow_empty:
                    _validate(filename, rows)
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["filename", "record", "name", "header", "seq"])

    return files.mapInArrow(run, SCHEMA)


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Names of assemblies of no bytes, which a scan leaves out without a word."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return [s.getPath().getName() for s in found if s.isFile() and s.getLen() == 0 and re.search(_ASSEMBLY, s.getPath().getName())]


def _validate(filename: str, rows: list[tuple]) -> None:
    names = [r[2] for r in rows]
    if not rows:
        raise ValueError(f"{filename} has no sequences")
    if "" in names:
        raise ValueError(f"{filename} has a sequence without a name")
    if any(not r[4] for r in rows):
        raise ValueError(f"{filename} has a sequence without letters")
    if len(set(names)) < len(names):
        raise ValueError(f"{filename} has a repeated sequence name")


def assembly_sequences(fasta: DataFrame, k: int, sample_id: str = "sample", max_contigs: float = 25.0) -> DataFrame:
    """sample_id, seq_id, filename, contig_header, length, seq, weights and flags.

    Contigs shorter than k take no number; ignored ones take a number and are flagged. Too many
    contigs per file on average is an error. Numbers follow file names and record order.
    """
    mean = fasta.groupBy("filename").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n")).first()[0]
    if mean is None:
        raise ValueError("no assemblies were found")
    if mean > max_contigs:
        raise ValueError(f"{mean:.1f} contigs per assembly on average; at most {max_contigs} are allowed")
    kept = fasta.where(F.length("seq") >= k)
    per_file = kept.groupBy("filename").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("filename").rowsBetween(Window.unboundedPreceding, -1)  # one row per file of a sample
    offset = per_file.select("filename", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    rank = F.row_number().over(Window.partitionBy("filename").orderBy("record"))
    header = clean_header(F.col("header"))
    return kept.withColumn("r", rank).join(small_or_not(written(offset)), "filename").select(
        F.lit(sample_id).alias("sample_id"), (F.col("r") + F.col("off")).cast("int").alias("seq_id"), "filename",
        header.alias("contig_header"), F.length("seq").cast("bigint").alias("length"), "seq",
        directive(header, "cluster_weight").alias("cluster_weight"),
        directive(header, "consensus_weight").alias("consensus_weight"),
        is_trusted(header).alias("trusted"), is_ignored(header).alias("ignored"),
    )


def total_lengths(fasta: DataFrame) -> DataFrame:
    """filename, contigs, bases: letters of all sequences of a file."""
    return fasta.groupBy("filename").agg(F.count(F.lit(1)).alias("contigs"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"))


def fasta_lines(seqs: DataFrame, order: list[str], header: str = "header", seq: str = "seq") -> DataFrame:
    """One ``value`` column with single-line records, in order, ready for ``write.text``."""
    return seqs.orderBy(*order).select(F.concat(F.lit(">"), header, F.lit("\n"), seq).alias("value"))
