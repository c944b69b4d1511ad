"""Subcommands end to end on small assemblies."""

import random

import pytest
from pyspark.sql import functions as F

from strandweave.plans import assembly as A


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_pipeline(spark):
    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    plasmid = "".join(rng.choice("ACGT") for _ in range(120))
    other = genome[:200] + ("A" if genome[200] != "A" else "C") + genome[201:]
    rows = [(1, genome[50:] + genome[:50] + genome[50:90]), (2, rc(genome)), (3, other[300:] + other[:300]), (4, plasmid), (5, plasmid[30:] + plasmid[:30]), (6, rc(plasmid))]
    seqs = spark.createDataFrame([("s", *r) for r in rows], "sample_id string, seq_id int, seq string")
    graphs = A.compress(seqs, 21).cache()
    assert {r.seq_id: r.seq for r in A.decompress(graphs, ["sample_id"]).collect()} == dict(rows)
    clusters = A.tree_clusters(A.pair_distances(graphs), ["sample_id"])
    found = {}
    for r in clusters.collect():
        found.setdefault(r.cluster, set()).add(r.seq)
    assert sorted(map(sorted, found.values())) == [[1, 2, 3], [4, 5, 6]]
    own = A.cluster_graphs(graphs, clusters)
    final = A.combine(A.resolve(A.trim(own))).collect()
    sizes = sorted(len(r.seq) for r in final)
    assert sizes == [120, 400] and sorted(r.number for r in final) == [1, 2]
    whole = next(r.seq for r in final if len(r.seq) == 400)
    assert whole in genome * 2 or rc(whole) in genome * 2
    with pytest.raises(ValueError):
        A.compress(seqs, 20)


def test_subsample(spark):
    reads = spark.range(1000).select(F.col("id").alias("read_id"), F.lit("ACGT" * 25).alias("seq"))
    got = A.subsample(reads, 1000, count=3, min_read_depth=25).groupBy("subset").count().collect()
    assert [r["count"] for r in got] == [500] * 3  # depth 25 * log2(4 * 100 / 25) / 2 = 50 of 100
    with pytest.raises(ValueError, match="depth"):
        A.subsample(reads, 10**6)


def assemblies(spark):
    rng = random.Random(5)
    genome, plasmid = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (400, 120))
    rows = []
    for s in ("s", "t"):
        own = [genome, plasmid] if s == "s" else [genome[::-1], plasmid]
        for f in range(3):
            for c, seq in enumerate(own):
                at = rng.randrange(20, 100)
                rows.append((s, len(rows) % 6 + 1, f"{'abc'[f]} x.fasta", f"c{c} Tool_consensus_weight={f + 1}", seq[at:] + seq[:at], f + 1))
    seqs = spark.createDataFrame(rows, "sample_id string, seq_id int, filename string, contig_header string, seq string, consensus_weight int")
    return seqs.withColumn("length", F.length("seq").cast("bigint")).withColumn("cluster_weight", F.lit(1)).withColumn("trusted", F.lit(False))


def test_whole_run_to_files(spark, tmp_path):
    from strandweave.plans import clustering as L
    from strandweave.plans import outputs as O
    from strandweave.sources import gfa

    seqs = assemblies(spark)
    graphs = A.compress(seqs, 21).cache()
    distances = A.pair_distances(graphs)
    clusters = L.cluster(seqs, distances).cache()
    found = {(r.sample_id, r.seq_id): (r.cluster, r.passed) for r in clusters.collect()}
    assert found == {(s, i): (2 - i % 2, True) for s in "st" for i in range(1, 7)}
    assert {r.sample_id: r.newick.count("__") for r in L.trees(seqs, distances).collect()} == {"s": 18, "t": 18}
    for r in L.metrics(clusters).collect():
        assert (r.pass_cluster_count, r.fail_cluster_count, r.pass_contig_count, r.pass_contig_fraction, r.cluster_balance_score) == (2, 0, 6, 1.0, 1.0)
    per = {(r.sample_id, r.cluster): (r.untrimmed_cluster_size, r.untrimmed_cluster_lengths, r.untrimmed_cluster_median, r.untrimmed_cluster_mad) for r in L.cluster_metrics(clusters).collect()}
    assert per["s", 1] == (3, [400] * 3, 400, 0) and per["t", 2] == (3, [120] * 3, 120, 0)
    L.write_cluster_table(clusters, str(tmp_path / "table"))
    (made,) = (tmp_path / "table" / "sample_id=s").glob("*.csv")
    lines = made.read_text().splitlines()
    assert lines[0].split("\t") == list(L.TSV) and lines[1].split("\t") == ["1__a x.fasta__c0__400_bp", "1", "1", "1", "a x.fasta", "c0", "400", "false", "1", "1"] and len(lines) == 7
    own = A.cluster_graphs(graphs, clusters.select("sample_id", "seq_id", F.col("seq_id").alias("seq"), "cluster"))
    O.write_lines(O.cluster_lines(own, clusters, 21), ["sample_id", "qc", "folder"], str(tmp_path / "clusters"))
    (made,) = (tmp_path / "clusters" / "sample_id=s" / "qc=qc_pass" / "folder=cluster_001").glob("*.txt")
    back = gfa.read_gfa(spark, str(made))
    assert gfa.path_steps(back).select("seq_id").distinct().count() == 3 and back.header.first().k == 21 and gfa.unknown_links(back).count() == 0
    assert [x[0] for x in made.read_text().splitlines()] == sorted((x[0] for x in made.read_text().splitlines()), key="HSLP".index)
    weights = seqs.select("sample_id", "seq_id", "consensus_weight")
    trimmed = A.trim(own)
    assert A.bridged(trimmed, weights).count() == A.bridged(trimmed, merge=True).count() == 4
    whole = O.combined(A.resolve(trimmed, weights))
    assert {r.sample_id: (r.consensus_assembly_bases, r.consensus_assembly_unitigs, r.consensus_assembly_fully_resolved) for r in whole.totals.collect()} == {"s": (520, 2, True), "t": (520, 2, True)}
    assert {(r.sample_id, r.place, r.length, r.topology) for r in whole.clusters.collect()} == {(s, p, n, "circular") for s in "st" for p, n in ((1, 400), (2, 120))}
    fasta = {(r.sample_id, r.value.split("\n")[0]) for r in O.combined_fasta(whole, False).collect()}
    assert fasta == {(s, f">{i} length={n} circular=true topology=circular") for s in "st" for i, n in ((1, 400), (2, 120))}
    lines = [r.value for r in O.combined_gfa(whole, False).where("sample_id = 's'").orderBy("place").collect()]
    assert lines[0] == "H\tVN:Z:1.0" and [x.split("\t")[:2] for x in lines[1:3]] == [["S", "1"], ["S", "2"]] and all("CL:Z:" in x for x in lines[1:3])
    assert lines[3:] == ["L\t1\t+\t1\t+\t0M", "L\t1\t-\t1\t-\t0M", "L\t2\t+\t2\t+\t0M", "L\t2\t-\t2\t-\t0M"]
    sequences = A.decompress(graphs, ["sample_id"])
    O.write_lines(O.original_files(sequences, seqs), ["sample_id", "filename"], str(tmp_path / "original"), "gzip")
    rows = spark.read.text(str(tmp_path / "original" / "sample_id=s" / "filename=b x.fasta"))
    assert [r.value.split()[0] for r in rows.collect()][::2] == [">c0", ">c1"]
    assert [r.value.split(" ")[0] for r in O.original_file(sequences, seqs).where("sample_id = 's'").orderBy("place").limit(2).collect()] == [">a_x.fasta__c0", ">a_x.fasta__c1"]


def test_combined_with_read_depths(spark):
    from strandweave.plans import outputs as O

    rows = spark.createDataFrame(
        [("s", 1, [(1, "ACGT", 3.0, "other")], [(1, -1)], []), ("s", 2, [(1, "ACGTACG", 2.0, "anchor"), (2, "AC", 2.0, "bridge")], [(1, 2), (-2, -1)], [])],
        f"sample_id string, cluster int, {A._GRAPH}",
    )
    depths = spark.createDataFrame([("s", 1, 1, 4.25), ("s", 2, 1, None), ("s", 2, 2, 1.0)], "sample_id string, cluster int, number int, read_depth double")
    whole = O.combined(rows, depths)
    heads = [r.value.split("\n")[0] for r in O.combined_fasta(whole, True).orderBy("place").collect()]
    assert heads == [">1 length=7 depth=unavailable", ">2 length=2 depth=1.0", ">3 length=4 depth=4.2 circular=false topology=linear"]
    lines = [r.value for r in O.combined_gfa(whole, True).orderBy("place").collect()]
    assert lines[1:] == [
        "S\t1\tACGTACG\tDP:f:0.00\tCL:Z:forestgreen", "S\t2\tAC\tDP:f:1.00\tCL:Z:pink", "S\t3\tACGT\tDP:f:4.25\tCL:Z:orangered",
        "L\t1\t+\t2\t+\t0M", "L\t2\t-\t1\t-\t0M", "L\t3\t+\t3\t-\t0M",
    ]
    got = {r.cluster: (r.place, r.unitigs, r.topology, r.read_depth) for r in whole.clusters.collect()}
    assert got == {2: (1, 2, "fragmented", 1.0), 1: (2, 1, "linear-open-hairpin", 4.25)}


def test_subset_files(spark, tmp_path):
    from strandweave.plans import outputs as O

    reads = spark.createDataFrame([(1, 5, "b", "AC", "II"), (1, 2, "a", "G", "I"), (2, 5, "b", "AC", "II")], "subset int, read_idx bigint, name string, seq string, qual string")
    O.write_lines(O.subset_files(reads), ["folder"], str(tmp_path / "reads"))
    (made,) = (tmp_path / "reads" / "folder=sample_01").glob("*.txt")
    assert made.read_text() == "@a\nG\n+\nI\n@b\nAC\n+\nII\n"
