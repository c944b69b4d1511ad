"""Context k-mers, read depths and reports."""

import pytest

from strandweave.operators import depth as W
from strandweave.operators.seqgraph import SeqGraph
from strandweave.plans import reports
from strandweave.plans.depths import read_depths

SEQ = "AGCATCGACATCGACTACG"


def tig(*links):
    return SeqGraph.of([(1, SEQ, 1.0)], links)


def test_contexts():
    assert W.context_kmers(tig(), 1, 5) == []
    assert [o for o, _ in W.context_kmers(tig((1, 1)), 1, 5)] == [-4, -3, -2, -1, 15, 16, 17, 18]
    assert [o for o, _ in W.context_kmers(tig((1, -1), (-1, 1)), 1, 5)] == [-4, -3, -2, -1, 15, 16, 17, 18]
    assert len(W.junction_kmers(tig((1, 1)), 1, 5)) == 4 and W.junction_kmers(tig(), 1, 5) == []
    kmers = list(W.assembly_kmers(tig((1, 1)), 5))
    assert len(kmers) == 19 and len(set(kmers)) == 16 and kmers.count(W.canonical("ATCGA")) == 2
    assert list(W.inner_kmers("ACGTNACGT", 3)) == ["ACG"] * 4
    ends = SeqGraph.of([(1, "CCC", 1.0), (2, "GTA", 1.0), (3, "A", 1.0), (4, "C", 1.0)], [(3, 2), (4, 2), (2, 1)])
    assert {o: len(v) for o, v in W.context_kmers(ends, 2, 5)} == {-1: 2, 0: 1, 1: 1}


def test_read_depths(spark):
    seq = "ACGATTGCCAGTTTCAGGCATTGACCAGTAC"
    row = [("s", 1, [(1, seq, 1.0, "other")], [])]
    rows = spark.createDataFrame(row, "sample_id string, cluster int, unitigs array<struct<number: int, seq: string, depth: double, kind: string>>, links array<struct<src: int, dst: int>>")
    reads = spark.createDataFrame([(1, seq), (2, seq), (3, "T" * 30)], "read_id bigint, seq string")
    got = read_depths(rows, reads, 11).collect()
    assert [(r.number, round(r.read_depth, 6)) for r in got] == [(1, round(2 * 31 / 21, 6))]
    with pytest.raises(Exception, match="no read"):
        read_depths(rows, reads.where("read_id = 3"), 11).collect()


def test_read_depths_of_two_samples(spark):
    """Equal k-mers of two samples are no repeats, and each sample has a scale of its own."""
    seq, other = "ACGATTGCCAGTTTCAGGCATTGACCAGTAC", "TTGACGGATCCATTAGCGGATACCAGGTACC"
    kind = "array<struct<number: int, seq: string, depth: double, kind: string>>, links array<struct<src: int, dst: int>>"
    rows = spark.createDataFrame([("s", 1, [(1, seq, 1.0, "other")], []), ("t", 1, [(1, seq, 1.0, "other")], []), ("t", 2, [(1, other, 1.0, "other")], [])], f"sample_id string, cluster int, unitigs {kind}")
    reads = spark.createDataFrame([("s", 1, seq), ("s", 2, seq), ("t", 1, seq), ("t", 2, other), ("t", 3, other)], "sample_id string, read_id bigint, seq string")
    got = {(r.sample_id, r.cluster): round(r.read_depth, 6) for r in read_depths(rows, reads, 11).collect()}
    assert got == {("s", 1): round(2 * 31 / 21, 6), ("t", 1): round(31 / 21, 6), ("t", 2): round(2 * 31 / 21, 6)}


def test_reports(spark):
    seqs = spark.createDataFrame([("s", 1, "f", "a x", 9), ("s", 2, "f", "b", 8), ("t", 1, "f", "c", 7)], "sample_id string, seq_id int, filename string, contig_header string, length bigint")
    near = spark.createDataFrame([("s", 1, 2, 0.25)], "sample_id string, a bigint, b bigint, dist double")
    lines = [(r.sample_id, r.value) for r in reports.phylip(near, seqs).orderBy("sample_id", "place").collect()]
    assert lines == [("s", "2"), ("s", "f a (9 bp)\t0.00000000\t0.25000000"), ("s", "f b (8 bp)\t1.00000000\t0.00000000"), ("t", "1"), ("t", "f c (7 bp)\t0.00000000")]
    a, b, c = "pass_cluster_count", "trimmed_cluster_mad", "input_read_n50"
    assert reports.table_line("x", [{a: 1}, {a: 2}], [{b: 1.23456}, {b: 2}], (a, b, c)) == "x\t2\t[1.23,2]\t"
    for bad in (lambda: reports.table_line("x", [], [], ("a",)), lambda: reports.table_header(("a",)), lambda: reports.table_line("x\ty", [], [])):
        with pytest.raises(ValueError):
            bad()
    assert reports.table_header() == "name\t" + "\t".join(reports.FIELDS)
    clusters = spark.createDataFrame([(1, 3, True), (2, 1, False)], "cluster int, size int, passed boolean")
    assert tuple(reports.clustering_summary(clusters).first()) == (1, 1, 3, 1, 0.75, 0.25)
