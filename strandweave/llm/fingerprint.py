"""Operator 7: document fingerprints by winnowing, in DataFrame functions only.

A text's words are hashed, every run of K words gets a k-gram hash, and of every window of W
k-grams the smallest hash is kept, the rightmost one on a tie, with its position. Any passage of
W + K - 1 words that two texts share therefore leaves a common hash in both. The window minima
are taken by doubling: minima over 1, 2, 4, ... neighbours, three passes for W = 8.

A text whose first half has no such passage (few words, or none because there is no white space)
gets a second fingerprint over characters: runs of CHARS in windows of W, or, below SHORT
characters, every character. Its first half alone then leaves a common hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import small_or_not
from .common import table, written

#: Words of a k-gram.
K = 5
#: k-grams of a window; a power of two.
W = 8
#: Characters of a k-gram of characters, and the length from which half a text fills a window of them.
CHARS = 4
SHORT = 2 * (W + CHARS - 1)
#: White space that divides words.
_BLANK = "[ \\t-\\r]+"
#: Multiplier of the k-gram hash, modulus 2**31 - 1: every product stays below 2**62.
_BASE, _MOD = 1_000_003, 2_147_483_647
#: Documents side by side in one group of the neighbour search.
GROUP_ROWS = 1500
#: Parts of the id range, of equally many documents each, that are divided into groups.
SEGMENTS = 512


def _kgrams(words: Column, k: int = K) -> Column:
    """Of an array of words (or characters) one number per k-gram: hash * 2**31 + (2**31 - 1 - position), so that the least number is
    the least hash and of equal hashes the rightmost. A text of under k words, but not none, is
    one k-gram."""
    codes = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(_MOD)))
    powers = [pow(_BASE, k - 1 - j, _MOD) for j in range(k)]

    def full(c: Column) -> Column:
        def at(i: Column) -> Column:
            h = F.lit(0).cast("bigint")
            for j, p in enumerate(powers):
                h = h + (F.get(c, i + j) * F.lit(p)) % F.lit(_MOD)
            return (h % F.lit(_MOD)) * F.lit(_MOD + 1) + (F.lit(_MOD) - i).cast("bigint")

        return F.transform(F.sequence(F.lit(0), F.size(c) - k), at)

    def short(c: Column) -> Column:
        h = F.aggregate(c, F.lit(17).cast("bigint"), lambda a, x: (a * F.lit(_BASE) + x) % F.lit(_MOD))
        return F.array(h * F.lit(_MOD + 1) + F.lit(_MOD).cast("bigint"))

    none = F.array().cast("array<bigint>")
    of = lambda c: F.when(F.size(c) >= k, full(c)).when(F.size(c) > 0, short(c)).otherwise(none)
    return _let(codes, of)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, whatever the optimiser merges."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _minima(grams: Column, width: int) -> Column:
    """Minima of ``width`` neighbours, one per window; of fewer than ``width``, the one minimum."""
    out, step = grams, 1
    while step < width:
        out = _let(out, _halved(step))
        step *= 2
    return out


def _halved(step: int):
    """Minima over twice as many neighbours, from minima over ``step`` neighbours."""

    def of(a: Column) -> Column:
        paired = F.transform(
            F.slice(a, F.lit(1), F.size(a) - step), lambda x, i: F.least(x, F.get(a, i + step))
        )
        return F.when(F.size(a) > step, paired).when(F.size(a) > 0, F.array(F.array_min(a))).otherwise(a)

    return of


def winnow(text: Column, window: int = W) -> Column:
    """array<bigint> of kept k-grams in the order of their first window (see :func:`_kgrams` for
    the packing of hash and position). Null and empty texts have none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BLANK), lambda w: w != "")
    return F.array_distinct(_minima(_kgrams(words), window))


def coarse(text: Column) -> Column:
    """True if the first half of a text does not hold W + K - 1 whole words with one more behind,
    so that a text that shares this half may share no k-gram of words. Reads no further than that."""
    n = F.char_length(text)
    need = W + K
    # of need + 2 parts the first and the last may be empty
    parts = F.split(F.left(text, n - F.floor(n / 2).cast("int")), _BLANK, need + 2)
    return F.size(F.filter(parts, lambda w: w != "")) < need


def winnow_chars(text: Column, short: Column) -> Column:
    """array<bigint> of kept k-grams of characters; if ``short``, of every single character.
    Null and empty texts have none."""

    def chars(x: Column) -> Column:
        return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), ""), lambda c: c != "")

    each = F.array_distinct(_kgrams(chars(F.when(short, text)), 1))
    runs = F.array_distinct(_minima(_kgrams(chars(F.when(~short, text)), CHARS), W))
    return F.when(short, each).otherwise(runs)


def hashes(kept: Column) -> Column:
    """Distinct k-gram hashes of a fingerprint, positions left out."""
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, 31)))


def as_text(kept: Column) -> Column:
    """``hash@position`` of each kept k-gram, hash in hex, in the order of position."""
    shown = F.transform(
        kept, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit("@"), (F.lit(_MOD) - x.bitwiseAND(F.lit(_MOD))).cast("string"))
    )
    return F.array_join(shown, " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def fingerprint(docs: DataFrame, window: int = W) -> DataFrame:
    """Adds ``fingerprint`` (text) and ``kept`` (packed) to every row. Null texts count as empty,
    repeated rows are treated alike, columns of these names are replaced."""
    return docs.withColumn("kept", winnow(F.col("text"), window)).withColumn("fingerprint", as_text(F.col("kept")))


def _edges(docs: DataFrame) -> tuple[list[int], int]:
    """The ids at which segments begin, and one beyond the highest; steps that each is cut into.
    Segments have about equally many documents; an id that fills several is one of its own."""
    n, low, high, knots = docs.agg(
        F.count("doc_id"), F.min("doc_id"), F.max("doc_id"),
        F.percentile_approx("doc_id", [i / SEGMENTS for i in range(1, SEGMENTS)], 20 * SEGMENTS),
    ).first()
    if not n:
        return [0, 1], 1
    many = [a + 1 for a, b in zip(knots, knots[1:], strict=False) if a == b]
    return sorted({low, high + 1, *knots, *many}), max(1, n // (GROUP_ROWS * SEGMENTS))


def _groups(doc_id: Column, digest: Column, edges: list[int], steps: int) -> Column:
    """A group number, greater for rows that come earlier (descending doc_id, ascending digest of
    the text): segments are cut into equal steps of ids, a segment of one id, and the rows without
    one, by the digest."""
    wide = 64
    held, coarse = F.lit(edges[:-1]), F.lit(edges[:-1:wide])
    count = lambda ids: F.size(F.filter(ids, lambda x: x <= doc_id))
    first = (count(coarse) - 1) * wide
    segment = first + count(F.slice(held, first + 1, F.lit(wide)))  # from 1
    low, high = F.element_at(held, segment), F.element_at(F.lit(edges[1:]), segment)
    inside = F.floor((doc_id - low).cast("double") / (high - low) * steps)
    step = segment.cast("bigint") * steps + F.least(inside, F.lit(steps - 1))
    later = F.lit(4095) - F.conv(F.substring(digest, 1, 3), 16, 10).cast("bigint")
    return F.when(doc_id.isNull(), later).otherwise((step + 1) * 4096 + F.when(high - low == 1, later).otherwise(0))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``group``, with a copy of each group's neighbour: in every group,
    rows in descending doc_id are followed by the first row of the next lower group (``ghost``
    true). Only one shuffle of texts is needed then, by group; the copies are one row per group.
    """
    edges, steps = _edges(docs)
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.col("text").cast("binary"))
    rows = docs.select("doc_id", text.alias("text")).withColumn("group", _groups(F.col("doc_id"), digest, edges, steps))
    # a group's first row has the greatest id (if any), and of rows of this id the least digest
    first = F.max("doc_id").alias("head")
    heads = written(rows.groupBy("group").agg(first).select("group", F.floor(F.col("group") / 2**24).alias("range"), "head"))
    # the group that a head is copied to is the next higher one: in its range of groups, else the
    # lowest of the next range; the very first head goes to the very last group
    ranges = heads.groupBy("range").agg(F.min("group").alias("lowest"))
    down, whole = Window.orderBy(F.desc("range")), Window.partitionBy()
    above = F.coalesce(F.lag("lowest").over(down), F.min("lowest").over(whole))
    above = small_or_not(written(ranges.select("range", above.alias("above"))))
    inside = F.lag("group").over(Window.partitionBy("range").orderBy(F.desc("group")))
    to = heads.withColumn("inside", inside).join(above, "range").select("group", "head", F.coalesce("inside", "above").alias("to"))
    to = small_or_not(written(to)).alias("h")
    here = rows.alias("r").join(to, (F.col("r.group") == F.col("h.group")) & F.col("r.doc_id").eqNullSafe(F.col("h.head")))
    least = F.min(F.struct(F.md5(F.col("r.text").cast("binary")).alias("digest"), F.col("r.text").alias("text"))).alias("x")
    ghosts = here.groupBy("h.to", "h.head").agg(least).select(F.col("head").alias("doc_id"), "x.text", F.col("to").alias("group"), F.lit(True).alias("ghost"))
    return rows.withColumn("ghost", F.lit(False)).unionByName(ghosts)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and what they have in common.

    Nulls: a null text is empty; rows with a null doc_id come after all others. Repeated ids go
    in the order of their texts' md5 (equal rows lie in one group). Very long texts are read whole.
    An empty table gives no rows. With one document the next one is itself. Two empty
    fingerprints have likeness 1, an empty and a filled one 0.

    ``char_fingerprint`` and ``edited_char_fingerprint`` are filled where words are too coarse
    (see :func:`coarse`); ``near_edited_whole`` is the likeness by these there, and otherwise
    ``near_edited``. It is above 0 for every text.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = Window.partitionBy("group").orderBy("ghost", F.desc("doc_id"), F.md5(F.col("text").cast("binary")))
    near = with_next(docs).withColumn("next_text", F.lead("text").over(order)).withColumn("kept", winnow(F.col("text")))
    near = near.withColumn("next_kept", F.lead("kept").over(order)).where(~F.col("ghost"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    full = near.withColumn("n_chars", n.cast("bigint")).withColumn("edited", edited)
    full = full.withColumn("edited_kept", winnow(F.col("edited")))
    full = full.withColumn("h", hashes(F.col("kept"))).withColumn("eh", hashes(F.col("edited_kept")))
    full = full.withColumn("coarse", coarse(F.col("text")))
    for name in ("text", "edited"):
        kept = winnow_chars(F.when(F.col("coarse"), F.col(name)), F.col("n_chars") < SHORT)
        full = full.withColumn(f"{name}_chars", F.when(F.col("coarse"), kept))
    by_words = likeness(F.col("h"), F.col("eh"))
    by_chars = likeness(hashes(F.col("text_chars")), hashes(F.col("edited_chars")))
    return full.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("kept")).alias("fingerprint"), as_text(F.col("edited_kept")).alias("edited_fingerprint"),
        by_words.alias("near_edited"),
        likeness(F.col("h"), hashes(F.col("next_kept"))).alias("near_next"),
        as_text(F.col("text_chars")).alias("char_fingerprint"), as_text(F.col("edited_chars")).alias("edited_char_fingerprint"),
        F.when(F.col("coarse"), by_chars).otherwise(by_words).alias("near_edited_whole"),
    )
