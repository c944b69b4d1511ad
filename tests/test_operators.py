"""Golden values of single operators."""

import pytest
from pyspark.sql import functions as F

from strandweave.functions import seq as S
from strandweave.functions import stats as T
from strandweave.operators import kmers as K
from strandweave.operators import paths as P
from strandweave.operators.compaction import compact, reconstruct
from strandweave.operators.resolving import Bridge, alignment_distance, anchor_paths, mark_conflicts
from strandweave.operators.seqgraph import SeqGraph
from strandweave.operators.trees import Tree, upgma
from strandweave.operators.trimming import overlap_alignment, trim_hairpin_end, trim_hairpin_start


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, S.reverse_complement(F.lit("AC.GTX"))) == "NAC.GT"
    assert one(spark, S.canonical(F.lit("TTT"))) == "AAA"
    assert one(spark, S.kmers(F.lit("ACGT"), 5)) == []
    assert one(spark, S.kmers(F.lit("ACGTA"), 4)) == ["ACGT", "CGTA"]
    assert one(spark, S.encode_2bit(F.lit("ACGT"))) == 27
    assert one(spark, S.signed_text(F.array(F.lit(12), F.lit(-7)))) == "12+,7-"
    assert one(spark, S.signed_path(F.lit("12+,7-"))) == [12, -7]
    assert one(spark, S.reverse_path(F.array(F.lit(1), F.lit(-2)))) == [2, -1]
    assert one(spark, S.clean_header(F.lit(" a \t b  c"))) == "a b c"
    assert one(spark, S.directive(F.lit("a Tool_consensus_weight=0 b"), "consensus_weight")) == 0
    assert one(spark, S.directive(F.lit("a"), "consensus_weight")) == 1
    assert one(spark, S.depth_from_header(F.lit("c1 depth=3.5x"))) is None
    assert one(spark, S.depth_from_header(F.lit("c1_depth-3.5-circular"))) == 3.5
    assert [one(spark, S.parse_genome_size(F.lit(x))) for x in ("47K", "13.1M", "3g", "12", "x")] == [47000, 13100000, 3000000000, 12, None]
    assert one(spark, S.newick_label(F.lit(1), F.lit("a"), F.lit("b"), F.lit(2))) == "1__a__b__2_bp"


def test_formats():
    assert [S.format_float(x) for x in (8.5, 11.0, 0.1234567)] == ["8.5", "11", "0.123457"]
    assert [S.format_sigfigs(x, 3) for x in (0.0, 12345.6, 1.23456, 0.00123456)] == ["0", "12346", "1.23", "0.00123"]


def test_statistics(spark):
    lengths = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 7)], "g string, x bigint")
    got = {r.g: (r.median, r.mad) for r in T.median_mad(lengths, ["g"], "x").collect()}
    assert got == {"a": (2, 1), "b": (7, 0)}
    got = {r.g: (r.bases, r.n, r.n50, r.n50_desc) for r in T.n50(lengths, ["g"], "x").collect()}
    assert got == {"a": (10, 4, 3, 3), "b": (7, 1, 7, 7)}
    counts = spark.createDataFrame([("c", 10)] * 100 + [("c", 10000), ("d", 7)], "g string, x int")
    got = {r.g: r.clipped_mean for r in T.clipped_mean(counts, ["g"], "x").collect()}
    assert got["d"] == 7.0 and got["c"] == pytest.approx((1000 + 2 * 11000 / 101) / 101)
    assert [one(spark, T.automatic_min_assemblies(F.lit(n))) for n in (1, 2, 9, 11, 12)] == [1, 2, 2, 3, 3]
    assert T.clipped_mean(counts.limit(0), ["g"], "x").count() == 0


def test_kmers(spark):
    seqs = spark.createDataFrame([(1, "AAACCCAAA")], "id int, seq string")
    got = {r.kmer: r.n for r in K.count_canonical(seqs, "seq", 3).collect()}
    assert len(got) == 6 and got["AAA"] == 2 and sum(got.values()) == 7
    contig = spark.createDataFrame([("s", 1, "ACGACTGACATCAGCACTGC")], "sample_id string, seq_id int, seq string")
    assert K.kmer_positions(contig, 5).select("kmer").distinct().count() == 40
    with pytest.raises(Exception, match="only A, C, G and T"):
        K.check_bases(contig.withColumn("seq", F.lit("ACN"))).collect()


@pytest.mark.parametrize("k", [5, 9])
def test_round_trip(spark, k):
    import random

    rng = random.Random(k)
    base = "".join(rng.choice("ACGT") for _ in range(90))
    rows = [("s", i, base[i * 5 :] + base[: i * 5]) for i in range(3)] + [("s", 9, S_rc(base[:60])), ("t", 1, "ACGTTGCATT" * 3)]
    graph = compact(spark.createDataFrame(rows, "sample_id string, seq_id int, seq string"), k)
    assert {(r.sample_id, r.seq_id): r.seq for r in reconstruct(graph).collect()} == {(a, b): c for a, b, c in rows}
    assert P.missing_twins(graph.links, ["sample_id"]).count() == 0


def S_rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_circular_contig_is_one_loop(spark):
    # the second rotation removes the break at the first contig's ends
    seq = "ACGATTGCCAGTTTCAGGCA"
    rows = [("s", 1, seq + seq), ("s", 2, seq[7:] + seq + seq[:7])]
    graph = compact(spark.createDataFrame(rows, "sample_id string, seq_id int, seq string"), 7)
    assert {r.seq_id: r.seq for r in reconstruct(graph).collect()} == {1: seq + seq, 2: seq[7:] + seq + seq[:7]}


LOOPS = ([(1, "ACGACTACGAGCACG", 1.0), (2, "TACGACGACGACT", 1.0), (3, "ACTGACT", 1.0), (4, "GCTCG", 1.0), (5, "CAC", 1.0)], [(1, -2), (-2, 3), (3, 1), (4, -5), (-5, 4)])
ENDS = ([(1, "ACCGCTGCGCTCGCTTCGCTCT", 1.0), (2, "ATGAT", 1.0), (3, "GCGC", 1.0)], [(1, 2), (1, -2), (-1, 3), (-1, -3)])


def test_graph_edits():
    graph = SeqGraph.of(*LOOPS)
    assert graph.totals() == (43, 10, 5) and graph.components() == [[1, 2, 3], [4, 5]]
    assert all(graph.is_simple_loop(c) for c in graph.components())
    graph.merge_linear_paths()
    assert {n: t.seq for n, t in graph.tigs.items()} == {6: "ACGACTACGAGCACGAGTCGTCGTCGTAACTGACT", 7: "GCTCGGTG"}
    assert sorted(graph.links()) == [(-7, -7), (-6, -6), (6, 6), (7, 7)]
    graph = SeqGraph.of(*LOOPS)
    graph.duplicate(5)
    assert len(graph.tigs) == 6 and graph.totals() == (46, 10, 5)
    graph = SeqGraph.of(*ENDS)
    graph.expand_repeats()
    assert [graph.tigs[n].seq for n in (1, 2, 3)] == ["CACCGCTGCGCTCGCTTCGCTCTAT", "CG", "G"]
    graph.check()
    one_tig = lambda *links: SeqGraph.of([(1, "ACG", 1.0)], links).topology()
    assert [one_tig(), one_tig((1, 1)), one_tig((1, -1)), one_tig((1, -1), (-1, 1)), one_tig((1, 1), (1, -1))] == [
        "linear-open-open", "circular", "linear-open-hairpin", "linear-hairpin-hairpin", "other",
    ]
    with pytest.raises(ValueError):
        SeqGraph.of([(1, "A", 1.0)], [(1, 2)])


def test_upgma():
    d = {(1, 2): 17, (1, 3): 21, (1, 4): 31, (1, 5): 23, (2, 3): 30, (2, 4): 34, (2, 5): 21, (3, 4): 28, (3, 5): 39, (4, 5): 43}
    tree = upgma([1, 2, 3, 4, 5], d)
    labels = {i: f"{i}__{c}__{c}__1_bp" for i, c in zip(range(1, 6), "abcde", strict=True)}
    assert tree.newick(labels) == "(((1__a__a__1_bp:8.5,2__b__b__1_bp:8.5)6:2.5,5__e__e__1_bp:11)7:5.5,(3__c__c__1_bp:14,4__d__d__1_bp:14)8:2.5)9"
    tree.normalise()
    assert tree.height[tree.root] == 0.5
    tree = Tree(9, {9: (1, 8), 8: (2, 7), 7: (3, 6), 6: (4, 5)}, {9: 0.5, 8: 0.3, 7: 0.2, 6: 0.1})
    assert [tree.cut(c) for c in (0.8, 0.5, 0.3, 0.1)] == [[1, 8], [1, 2, 7], [1, 2, 3, 6], [1, 2, 3, 4, 5]]
    assert tree.cut(0.5, [3]) == [1, 2, 3, 6] and tree.cut(0.8, [8]) == [1, 8]
    assert tree.splits([1, 2, 7]) == [[1, 2, 3, 6]] and tree.max_distance(8) == 0.6 and tree.max_distance(10) == -1
    with pytest.raises(ValueError):
        tree.check_consistent([5, 6])
    with pytest.raises(ValueError):
        tree.check_complete([1, 2, 3, 4])
    assert tree.refine([1, 8], lambda c: len(c) if len(c) < 4 else 0) == [1, 2, 7]


def test_trimming():
    w = dict.fromkeys(range(1, 11), 10)
    path = [1, -2, 3, -4, 5, 1, -2]
    got = [(p.a, p.ai, p.b, p.bi) for p in overlap_alignment(path, path, w, 0.9, 100, True)]
    assert got == [(1, 0, 1, 5), (-2, 1, -2, 6)]
    assert not overlap_alignment(path, path, w, 0.9, 1, True) and not overlap_alignment(path, path, w, 0.9, 0, True)
    # a beginning without a match counts in the identity: 4 of 5 pieces by weight
    assert not overlap_alignment([9, 1, 2], [5, 1, 2], w, 0.9, 100, False)
    assert len(overlap_alignment([9, 1, 2], [5, 1, 2], w, 0.75, 100, False)) == 3
    assert not overlap_alignment(path[:5], path[:5], w, 0.9, 100, True)
    w2 = {1: 30, 2: 1, 3: 10, 4: 10, 5: 10, 6: 1}
    path = [1, -2, 3, -4, 5, 1, 6, 3]
    got = [(p.a, p.b) for p in overlap_alignment(path, path, w2, 0.9, 100, True)]
    assert got == [(1, 1), (None, 6), (-2, None), (3, 3)]
    assert not overlap_alignment(path, path, w2, 0.99, 100, True)
    assert trim_hairpin_end([1, 2, 3, 4, 5, -5, -4], w, 0.95, 1000) == [1, 2, 3, 4, 5]
    assert trim_hairpin_end([1, 2, 3, 4, 5], w, 0.95, 1000) is None
    assert trim_hairpin_start([-2, -1, 1, 2, 3, 4, 5], w, 0.95, 1000) == [1, 2, 3, 4, 5]
    w3 = {1: 100, 2: 100, 3: 10, 4: 100, 5: 100, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1}
    assert trim_hairpin_end([1, 2, 3, 4, 6, -4, -3], w3, 0.95, 1000) == [1, 2, 3, 4, 6]


def test_resolving():
    paths = [[1, -10, 4, 6, -5, -2, -9, 3, 8, -7], [7, -8, -3, 9, 2, 11, -6, -4, 10, -1]]
    assert anchor_paths(paths, {1, 2, 6, 8}) == [[1, -10, 4, 6], [6, -5, -2], [-2, -9, 3, 8], [-2, -9, 3, 8], [6, -11, -2], [1, -10, 4, 6]]
    length = {1: 10, 2: 1, 3: 2, 4: 3, 5: 4, 6: 10}
    assert alignment_distance([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 6], length) == 4
    assert alignment_distance([1, 2, 3, 5, 6], [1, 2, 4, 5, 6], length) == 3
    assert alignment_distance([1, 2, 3, 4, 5, 6], [], length) == 30
    ten = dict.fromkeys(range(1, 200), 10)
    tie = [[1, 12, 17, 123, 41, 2], [1, 12, -23, -8, 41, 2]] * 2
    assert Bridge(1, 2, tie, ten).best == [12, -23, -8, 41]
    bridge = lambda a, b, p: Bridge(a, b, [p], ten)
    sound = [bridge(1, -2, [1, 12, 2]), bridge(-2, 5, [-2, 6, 5]), bridge(4, -5, [4, -5]), bridge(-4, 6, [-4, 12, 6]), bridge(-1, -6, [-1, 11, -6])]
    mark_conflicts(sound)
    assert not any(b.conflicting for b in sound)
    more = [*sound, bridge(-4, 7, [-4, 13, 7]), bridge(1, 8, [1, 14, 8]), bridge(4, -8, [4, 9, -8])]
    mark_conflicts(more)
    assert [b.conflicting for b in more] == [True, False, True, True, False, True, True, True]


def test_repair_ends_of_contigs_under_2k(spark):
    import random

    from strandweave.operators.kmers import repair_ends

    rng = random.Random(3)
    whole = "".join(rng.choice("ACGT") for _ in range(150))
    rows = [("s", 1, whole), ("s", 2, whole[30:51]), ("s", 3, whole[60:101]), ("s", 4, whole[20:40])]
    got = {r.seq_id: r.padded_seq for r in repair_ends(spark.createDataFrame(rows, "sample_id string, seq_id int, seq string"), 21).collect()}
    assert got[2] == whole[20:61] and got[3] == whole[50:111]  # of k and of 2k - 1 letters
    assert got[4] == "." * 10 + whole[20:40] + "." * 10  # under k


def test_repair_ends_apart(spark):
    """Against a pattern search: low-complexity contigs, in which places overlap."""
    import random
    import re

    from strandweave.operators.kmers import repair_ends

    k, rng = 9, random.Random(5)
    half, width = k // 2, k - 1
    rows = [("s", i, "".join(rng.choice("AC") for _ in range(rng.randint(k, 40)))) for i in range(1, 25)]
    rows += [("s", 25, "A" * 30), ("s", 26, "AC" * 20), ("t", 1, "ACGTACGTACGT"), ("t", 2, "GGGGGGGGGGGG")]
    dotted = {r[:2]: "." * half + r[2] + "." * half for r in rows}
    twin = str.maketrans("ACGT", "TGCA")

    def best(sample, pattern):
        strands = [x for (s, _), p in dotted.items() if s == sample for x in (p, p.translate(twin)[::-1])]
        hits = [m for x in strands for m in re.findall(pattern, x)]
        return min(hits, key=lambda m: (m.count("."), -hits.count(m), m))

    frame = spark.createDataFrame(rows, "sample_id string, seq_id int, seq string")
    want = {key: best(key[0], p[:width]) + p[width:-width] + best(key[0], p[-width:]) for key, p in dotted.items()}
    got = {(r.sample_id, r.seq_id): r.padded_seq for r in repair_ends(frame, k, apart=True).collect()}
    assert got == want
    assert {(r.sample_id, r.seq_id): r.padded_seq for r in repair_ends(frame, k).collect()} != want


def test_low_depth_removal():
    two = lambda a, b: SeqGraph.of([(1, "ACGT", 5.0), (2, "CC", a), (3, "GG", b)], [(1, 2), (2, 1), (1, 3), (3, 1)])
    graph = two(2.0, 1.0)
    assert graph.remove_low_depth(1.0) == [3] and sorted(graph.tigs) == [1, 2]
    assert two(1.0, 1.0).remove_low_depth(1.0) == [3]  # 2 is the only way on then
    assert two(2.0, 1.5).remove_low_depth(1.0) == []


def test_votes_by_weight():
    from strandweave.operators.resolving import bridge_graph, resolve

    def graph():
        tigs = [(1, "A" * 9, 3.0), (2, "C" * 9, 3.0), (3, "GG", 1.0), (4, "TT", 2.0)]
        return SeqGraph.of(tigs, [(1, 3), (3, 2), (1, 4), (4, 2)], {1: [1, 3, 2], 2: [1, 4, 2], 3: [1, 4, 2]})

    assert resolve(graph())[0][0].best == [4] and resolve(graph(), {1: 3})[0][0].best == [3] and resolve(graph(), {2: 0, 3: 0})[0][0].best == [3]
    assert len(bridge_graph(graph()).tigs) == 3 and len(bridge_graph(graph(), merge=True).tigs) == 1


def test_clustering_of_one_sample():
    from strandweave.operators import clustering as C

    own = lambda i, f, n, **more: C.Contig(i, f, n, **more)
    contigs = [own(1, "a", 100), own(2, "b", 110), own(3, "c", 90), own(4, "a", 50), own(5, "b", 52), own(6, "c", 8), own(7, "a", 30), own(8, "b", 31)]
    near = {(a, b): 0.02 for group in ([1, 2, 3], [4, 5], [7, 8]) for a in group for b in group}
    near |= {(a, b): 0.1 for a in (7, 8) for b in (1, 2, 3)} | {(b, a): 0.7 for a in (7, 8) for b in (1, 2, 3)}
    tree, found = C.clustered(contigs, near, 0.2)
    assert [[x.id for x in c.contigs] for c in found] == [[1, 2, 3], [4, 5], [7, 8], [6]]
    assert [c.reasons for c in found] == [[], [], ["contained within cluster 1"], ["present in too few assemblies"]]
    trusted = [C.Contig(c.id, c.filename, c.length, trusted=c.id in (6, 7)) for c in contigs]
    assert all(c.passed for c in C.clustered(trusted, near, 0.2)[1])
    weighted = [C.Contig(c.id, c.filename, c.length, weight=2 if c.id == 6 else 1) for c in contigs]
    assert C.clustered(weighted, near, 0.2)[1][3].passed
    picked = C.clustered(contigs, near, 0.2, manual=[found[1].node])[1]
    assert [c.passed for c in picked] == [False, True, False, False] and picked[0].reasons == ["not included in manual clusters"]
    with pytest.raises(ValueError):
        C.clustered(contigs, near, 0.2, manual=[tree.root, 1])
    balance, tight, both = C.scores(found)
    assert abs(balance - (1 * 3 + 2 / 3 * 2 + 2 / 3 * 2 + 1 / 3) / 8) < 1e-12 and abs(tight - (1 - 0.02**0.5)) < 1e-12 and both == (balance + tight) / 2
    # a cut that joins two contigs of one file is refined
    twice = [own(1, "a", 10), own(2, "a", 10), own(3, "b", 10), own(4, "b", 10)]
    close = {(1, 3): 0.01, (3, 1): 0.01, (2, 4): 0.01, (4, 2): 0.01}
    close |= {(a, b): 0.15 for a in (1, 3) for b in (2, 4)} | {(b, a): 0.15 for a in (1, 3) for b in (2, 4)}
    assert [[x.id for x in c.contigs] for c in C.clustered(twice, close, 0.2)[1]] == [[1, 3], [2, 4]]
    assert C.manual_nodes(" 7, 3") == [3, 7] and C.manual_nodes(None) == [] and C.least_assemblies(contigs) == 2
    for bad in (lambda: C.manual_nodes("a"), lambda: C.check_contigs([], 25), lambda: C.check_contigs(contigs, 2.5)):
        with pytest.raises(ValueError):
            bad()
