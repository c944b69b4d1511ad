"""Dot plot layout, pixels and picture; input kinds and metric records."""

import struct
import zlib

import pytest

from strandweave.plans.dotplot import layout, pixels, png
from strandweave.sources import discover


def test_layout():
    plan = layout({1: 1000, 2: 500, 3: 0}, 1000, 10)
    (a, b), (c, d), (e, f) = plan.spans.values()
    assert a == 100 and b < c < d < e <= f <= 1000
    assert abs((b - a) - 991 / plan.bp_per_pixel) <= 0.5
    many = layout({i: 100 for i in range(300)}, 500, 10)
    assert many.spans[299][1] <= 500 + 300 and many.bp_per_pixel > 0
    for bad in ((100, 32), (2000, 5)):
        with pytest.raises(ValueError):
            layout({1: 10}, *bad)
    with pytest.raises(ValueError):
        layout({})


def test_pixels_against_brute_force(spark):
    import random

    rng = random.Random(3)
    a = "".join(rng.choice("ACGT") for _ in range(300))
    rc = a[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seqs = {1: a, 2: rc[:200] + "N" * 5 + a[:60], 3: "AC"}
    plan = layout({s: len(x) for s, x in seqs.items()}, 500, 10)
    got = {(r.x, r.y): r.colour for r in pixels(spark.createDataFrame(list(seqs.items()), ["seq_id", "seq"]), plan, 10).collect()}
    want = {}
    words = [(s, i, x[i : i + 10]) for s, x in seqs.items() for i in range(len(x) - 9) if "N" not in x[i : i + 10]]
    at = lambda s, i: plan.spans[s][0] + int(i / plan.bp_per_pixel + 0.5)
    for s, i, u in words:
        for t, j, v in words:
            if u == v:
                want[at(s, i), at(t, j)] = "forward"
            elif u == v[::-1].translate(str.maketrans("ACGT", "TGCA")):
                want.setdefault((at(s, i), at(t, j)), "reverse")
    assert got == want


def test_picture():
    plan = layout({1: 600}, 500, 10)
    x = plan.spans[1][0] + 5
    data = png(plan, [(x, x, "forward"), (x, x, "reverse"), (9999, 0, "forward")])
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (500, 500)
    size = struct.unpack(">I", data[33:37])[0]
    raw = zlib.decompress(data[41 : 41 + size])
    assert tuple(raw[x * 1501 + 1 + 3 * x :][:3]) == (0, 0, 205)


def test_discovery(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("\n>x one\nACGT\n")
    (tmp_path / "g.gfa").write_text(
        "H\tVN:Z:1.0\tKM:i:3\nS\t1\tACG\tDP:f:1\nS\t2\tTT\tDP:f:1\nP\t1\t1+,2-\t*\tLN:i:5\tFN:Z:a.fasta\tHD:Z:x one\n"
    )
    (tmp_path / "other.txt").write_text("what")
    kinds = {n: discover.input_kind(spark, str(tmp_path / n)) for n in ("a.fasta", "g.gfa", "")}
    assert list(kinds.values()) == ["fasta", "gfa", "directory"]
    for bad in ("other.txt", "none.gfa"):
        with pytest.raises(ValueError):
            discover.input_kind(spark, str(tmp_path / bad))
    assert [tuple(r) for r in discover.plot_sequences(spark, str(tmp_path / "g.gfa")).collect()] == [("a.fasta", "x", "ACGAA")]
    for place, n in (("qc_pass/c1", 1), ("qc_pass/c2", 2), ("qc_fail/c3", 3)):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "part.yaml").write_text(f"size: {n}\n")
    (tmp_path / "whole.yaml").write_text("bases: 5\n")
    records = discover.yaml_records(spark, str(tmp_path))
    assert discover.one_copy(records, "whole.yaml") == {"bases": 5} and discover.one_copy(records, "no.yaml") is None
    assert [r["size"] for r in discover.multi_copy(records, "part.yaml")] == [1, 2]
    with pytest.raises(ValueError):
        discover.one_copy(records, "part.yaml")
