"""Import, export and round trips."""

import gzip

import pytest

from strandweave.sources import fasta, fastq, gfa, yamlio


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one x\ty\nacg\n\nT\n>two\nGG\n")
    (tmp_path / "b.fna.gz").write_bytes(gzip.compress(b">one Tool_ignore\nACGTACGT\n"))
    (tmp_path / "c.xyz").write_text(">decoy\nA\n")
    rows = fasta.read_fasta(spark, str(tmp_path)).orderBy("filename", "record").collect()
    assert [(r.filename, r.name, r.seq) for r in rows] == [("a.fasta", "one", "ACGT"), ("a.fasta", "two", "GG"), ("b.fna.gz", "one", "ACGTACGT")]
    seqs = fasta.assembly_sequences(fasta.read_fasta(spark, str(tmp_path)), 3).orderBy("seq_id").collect()
    assert [(r.seq_id, r.contig_header, r.ignored) for r in seqs] == [(1, "one x y", False), (2, "one Tool_ignore", True)]
    with pytest.raises(ValueError, match="contigs per assembly"):
        fasta.assembly_sequences(fasta.read_fasta(spark, str(tmp_path)), 3, max_contigs=1.0)
    for bad in ("", ">a\nA\n>a\nC\n", ">a\n\n", "> \nA\n"):
        (tmp_path / "a.fasta").write_text(bad)
        with pytest.raises(Exception, match="a.fasta"):
            fasta.read_fasta(spark, str(tmp_path)).collect()


def test_fastq(spark, tmp_path):
    text = "".join(f"@r{i} x\n{'ACGT' * (i + 1)}\n+\n{'I' * 4 * (i + 1)}\n" for i in range(50))
    (tmp_path / "r.fastq").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        reads = fastq.read_fastq(spark, str(tmp_path / "r.fastq")).orderBy("read_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.read_idx, r.name, r.seq) for r in reads] == [(i, f"r{i}", "ACGT" * (i + 1)) for i in range(50)]
    (tmp_path / "e.fastq").write_text("@a\nAC\n+\nII\n@b\n\n+\n\n\n\n\n")
    assert [(r.name, r.seq) for r in fastq.read_fastq(spark, str(tmp_path / "e.fastq")).orderBy("read_idx").collect()] == [("a", "AC"), ("b", "")]
    for bad in (b"a\nAC\n+\nII\n", b"@a\nAC\nII\n+\n", b"@a\nAC\n+\nI\n", b"@a\nAC\n", gzip.compress(text.encode())):
        (tmp_path / "bad.fastq").write_bytes(bad)
        with pytest.raises(Exception, match="bad.fastq: record"):
            fastq.read_fastq(spark, str(tmp_path / "bad.fastq")).collect()


LINES = ["H\tVN:Z:1.0\tKM:i:3", "S\t1\tACGTT\tDP:f:2.00", "S\t2\tGGC\tDP:f:1.00\tCL:Z:forestgreen", "L\t1\t+\t2\t-\t0M", "L\t2\t+\t1\t-\t0M", "P\t1\t1+,2-\t*\tLN:i:8\tFN:Z:a.fa\tHD:Z:c 1\tCL:i:1"]


def test_gfa(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = gfa.parse_gfa(lines)
    assert [r.value for r in gfa.gfa_lines(got, 3).collect()] == LINES
    assert gfa.unknown_links(got).count() == 0
    steps = [(r.idx, r.unitig, r.pos) for r in gfa.path_steps(got).orderBy("idx").collect()]
    assert steps == [(0, 1, 0), (1, -2, 5)]
    bad = spark.createDataFrame([(LINES[3].replace("0M", "5M"),)], "value string")
    with pytest.raises(Exception, match="must not overlap"):
        gfa.parse_gfa(bad).links.collect()


def test_yaml():
    value = {"a": 1, "b": [1.5, "x"], "c": {"d": None, "e": True}, "f": [{"g": 1, "h": "y z"}, {"g": 2, "h": "w"}], "i": []}
    assert yamlio.load(yamlio.dump(value)) == value
    assert yamlio.shown([1, 2.34567]) == "[1,2.35]" and yamlio.shown({"k": None}) == "{k:}"
