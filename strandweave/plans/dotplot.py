"""Dot plots: layout of the sequences, a table of pixels, and a PNG of that table.

The plot is symmetrical: a sequence has one interval that serves both axes. Matching and the
reduction to pixels are joins and aggregates; the picture is drawn from the reduced pixels, whose
number is bounded by the resolution.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import canonical
from ..operators.kmers import explode_kmers
from ..session import written

#: Shares of the resolution. Fixed values of the picture.
TOP_LEFT_GAP, BORDER_GAP, SEQ_GAP, ALL_SEQ_GAPS = 0.1, 0.015, 0.01, 0.1
#: Colours of the picture.
WHITE, SELF, OTHER, BLACK, COLOURS = (255, 255, 255), (211, 211, 211), (245, 245, 245), (0, 0, 0), {"reverse": (178, 34, 34), "forward": (0, 0, 205)}


@dataclass(frozen=True)
class Layout:
    """``spans`` maps a sequence to its first pixel and the one after its last."""

    resolution: int
    bp_per_pixel: float
    spans: dict


def _whole(x: float) -> int:
    return int(x + 0.5)


def layout(lengths: dict, resolution: int = 2000, k: int = 32) -> Layout:
    """Places sequences, in the order given, on ``resolution`` pixels. The gaps between them are
    narrowed when there are many sequences, so that at least half of the picture shows dots."""
    if not 500 <= resolution <= 10000:
        raise ValueError("the resolution must be from 500 to 10000")
    if not 10 <= k <= 100:
        raise ValueError("k must be from 10 to 100")
    if not lengths:
        raise ValueError("there is nothing to plot")
    inner = max(len(lengths) - 1, 0)
    share = min(SEQ_GAP, ALL_SEQ_GAPS / inner) if inner else SEQ_GAP
    edges = _whole(TOP_LEFT_GAP * resolution) + max(2, _whole(BORDER_GAP * resolution))
    gap = max(2, _whole(share * resolution))
    if inner and 2 * (edges + gap * inner) > resolution:
        gap = (resolution // 2 - edges) // inner
    room = max(1, resolution - edges - gap * inner)
    kmers = {s: max(n - k + 1, 1 if n < k else 0) for s, n in lengths.items()}
    scale = sum(kmers.values()) / room
    spans, at = {}, _whole(TOP_LEFT_GAP * resolution)
    for s, n in kmers.items():
        spans[s] = (at, at + _whole(n / scale))
        at = spans[s][1] + gap
    return Layout(resolution, scale, spans)


def pixels(seqs: DataFrame, plan: Layout, k: int = 32) -> DataFrame:
    """x, y, colour of every pixel with a match, all pairs of sequences, themselves included.

    ``seqs`` has seq_id and seq. A k-mer counts once for each pixel and strand of its own, before
    any two places meet, so a repeat that fills a sequence costs pixels and not places. Where
    both strands meet on a pixel the forward colour wins. Null and short sequences have no dots.
    """
    starts = seqs.sparkSession.createDataFrame([(s, a) for s, (a, _) in plan.spans.items()], ["seq_id", "__start"])
    # the layout holds one entry per sequence in the driver already
    k_of = explode_kmers(seqs.join(F.broadcast(starts), "seq_id"), ["seq_id", "__start"], "seq", k)
    place = F.floor(F.col("pos") / F.lit(plan.bp_per_pixel) + 0.5).cast("bigint") + F.col("__start")
    return matches(k_of.select("kmer", place.alias("x")), [])


def matches(places: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, colour of pixels that share a k-mer, on either strand, within ``keys``. ``places`` has
    keys, kmer and x, the k-mer's pixel. What is joined is written first, once per pixel and k-mer, so
    that adaptive execution can split a k-mer that fills many pixels."""
    both = places.where(F.col("kmer").rlike("^[ACGT]+$")).withColumn("c", canonical(F.col("kmer")))
    own = written(both.select(*keys, "c", (F.col("kmer") == F.col("c")).alias("plus"), "x").distinct())
    other = own.select(*keys, "c", F.col("plus").alias("plus_y"), F.col("x").alias("y"))
    # a k-mer that is its own reverse complement lies on both strands and so is forward anyway
    met = own.join(other, [*keys, "c"]).groupBy(*keys, "x", "y").agg(F.max(F.col("plus") == F.col("plus_y")).alias("same"))
    return met.select(*keys, "x", "y", F.when(F.col("same"), "forward").otherwise("reverse").alias("colour"))


def png(plan: Layout, dots: Iterable[tuple[int, int, str]]) -> bytes:
    """The picture: boxes of all pairs, reverse dots, forward dots over them."""
    size = plan.resolution
    rows = [bytearray(bytes(WHITE) * size) for _ in range(size)]

    def dot(x: int, y: int, colour: tuple[int, int, int]) -> None:
        if 0 <= x < size and 0 <= y < size:
            rows[y][3 * x : 3 * x + 3] = bytes(colour)

    for i, (top, bottom) in enumerate(plan.spans.values()):
        for j, (left, right) in enumerate(plan.spans.values()):
            left, right = max(left, 0), min(right + 1, size)
            for y in range(top, min(bottom + 1, size)):
                rows[y][3 * left : 3 * right] = bytes(SELF if i == j else OTHER) * (right - left)
            for x in range(left - 1, right + 1):
                dot(x, top - 1, BLACK)
                dot(x, bottom + 1, BLACK)
            for y in range(top - 1, bottom + 2):
                dot(left - 1, y, BLACK)
                dot(right, y, BLACK)
    for x, y, colour in sorted(dots, key=lambda d: d[2] == "forward"):
        dot(x, y, COLOURS[colour])

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", size, size, 8, 2, 0, 0, 0)
    data = zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", data) + chunk(b"IEND", b"")
