"""k-mers: counting, canonical counting, overlap links, end repair, and the k-mer graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.seq import canonical, kmers, reverse_complement
from ..session import small_or_not, written


#: Places of a sequence that are cut together; longer ones become several rows first.
CHUNK = 4096


def explode_kmers(seqs: DataFrame, keys: list[str], seq: str, k: int) -> DataFrame:
    """keys, pos (from 0), kmer. A long sequence is first cut into overlapping pieces, one row
    each, so a chromosome needs no array of millions of k-mers."""
    n = F.octet_length(seq)
    starts = F.when(n >= k, F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    cut = seqs.select(*keys, F.col(seq).cast("binary").alias("__b"), F.explode(starts).alias("__at"))
    cut = cut.select(*keys, "__at", F.substr("__b", F.col("__at") + 1, F.lit(CHUNK + k - 1)).cast("string").alias("__s"))
    made = cut.select(*keys, "__at", F.posexplode(kmers(F.col("__s"), k)).alias("__p", "kmer"))
    return made.select(*keys, (F.col("__p") + F.col("__at")).alias("pos"), "kmer")


def count_kmers(seqs: DataFrame, seq_id: str, seq: str, k: int, least: int = 1) -> DataFrame:
    """kmer, n, n_seqs of k-mers with ``n >= least``. Counting is two-stage: per (kmer, sequence)
    first, so neither a hot k-mer nor a hot sequence reaches a task unreduced."""
    each = explode_kmers(seqs, [seq_id], seq, k).groupBy("kmer", seq_id).agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy("kmer").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_seqs")).where(F.col("n") >= least)


def count_canonical(seqs: DataFrame, seq: str, k: int) -> DataFrame:
    """kmer, n with both strands counted together."""
    made = explode_kmers(seqs, [], seq, k).select(F.col("kmer").alias("x"))
    counted = made.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy(canonical(F.col("x")).alias("kmer")).agg(F.sum("c").alias("n"))


def repeat_kmers(table: DataFrame) -> DataFrame:
    """k-mers of an assembly table (kmer, n) that occur more than once."""
    return table.where("n > 1").select("kmer")


def overlap_links(kmer_table: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """src, dst: every pair with suffix(src, k-1) = prefix(dst, k-1), one hash join."""
    keys = keys or []
    a = kmer_table.select(*keys, F.col("kmer").alias("src"), F.substring("kmer", 2, k - 1).alias("__o"))
    b = kmer_table.select(*keys, F.col("kmer").alias("dst"), F.substring("kmer", 1, k - 1).alias("__o"))
    return a.join(b, [*keys, "__o"]).drop("__o")


def padded(seq: Column, k: int) -> Column:
    """Half a k of dots on both ends, so a contig has as many k-mers as bases."""
    dots = F.lit("." * (k // 2))
    return F.concat(dots, seq, dots)


def check_bases(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """The same rows; a sequence with letters other than ACGT is an error."""
    bad = F.col(seq).rlike("[^ACGT]")
    return seqs.where(F.when(bad, F.raise_error(F.lit("sequences may hold only A, C, G and T")).cast("boolean")).otherwise(True))


def kmer_positions(seqs: DataFrame, k: int) -> DataFrame:
    """sample_id, kmer, seq_id, strand, pos of all k-mers on both strands of padded contigs.
    Contigs shorter than k have none. ``seqs`` has sample_id, seq_id, seq and may have ``ends``
    repaired (see :func:`repair_ends`), in which case ``padded_seq`` is used as it is."""
    fwd = F.col("padded_seq") if "padded_seq" in seqs.columns else padded(F.col("seq"), k)
    long = seqs.where(F.length("seq") >= k)
    strands = F.array(F.struct(F.lit(True).alias("strand"), fwd.alias("s")), F.struct(F.lit(False).alias("strand"), reverse_complement(fwd).alias("s")))
    each = long.select("sample_id", "seq_id", F.explode(strands).alias("x")).select("sample_id", "seq_id", "x.*")
    return explode_kmers(each, ["sample_id", "seq_id", "strand"], "s", k)


def _first_apart(width: int):
    """Keeps, of places sorted by sequence, end and position, those that begin at or after the end
    of the last one kept. Holds one place, however many a sequence has."""

    def run(frames):
        group, free = None, 0
        for f in frames:
            keep = []
            for *place, pos in zip(f.sample_id, f.seq_id, f.strand, f.side, f.key, f.pos):
                keep.append(place != group or pos >= free)
                if keep[-1]:
                    group, free = place, pos + width
            yield f.loc[keep, ["sample_id", "side", "key", "w"]]

    return run


def repair_ends(seqs: DataFrame, k: int, apart: bool = False) -> DataFrame:
    """Adds ``padded_seq`` with dots replaced where another place of the sample continues an end.

    An end is the first or last k-1 characters of a padded contig, half dots and half bases. The
    other places are all windows of k-1 characters, on both strands, whose bases agree; the best
    one has fewest dots, then most occurrences, then comes first in the alphabet. The bases of
    the end are the join key, so no pattern is run against every sequence. Overlapping places of
    one strand all count; with ``apart`` only those that a search from its start finds one after
    another, and few ends are then broadcast, so the windows that continue none are not shuffled.
    ``seq_id`` tells the contigs of a sample apart.
    """
    half, width = k // 2, k - 1
    pad = seqs.withColumn("padded_seq", padded(F.col("seq"), k))
    fwd = pad.select("sample_id", "seq_id", F.lit(True).alias("strand"), F.col("padded_seq").alias("s"))
    both = fwd.unionByName(fwd.select("sample_id", "seq_id", F.lit(False).alias("strand"), reverse_complement(F.col("s")).alias("s")))
    ends = pad.where(F.length("seq") >= k).select("sample_id", F.explode(F.array(
        F.struct(F.lit("s").alias("side"), F.substr("padded_seq", F.lit(half + 1), F.lit(width - half)).alias("key")),
        F.struct(F.lit("e").alias("side"), F.substr("padded_seq", F.length("padded_seq") - width + 1, F.lit(width - half)).alias("key")),
    )).alias("x")).select("sample_id", "x.*").distinct()
    tail, head = F.substr("w", F.lit(half + 1), F.lit(width - half)), F.substr("w", F.lit(1), F.lit(width - half))
    sides = F.explode(F.array(F.struct(F.lit("s").alias("side"), tail.alias("key")), F.struct(F.lit("e").alias("side"), head.alias("key"))))
    count, where = F.count(F.lit(1)).alias("c"), ["sample_id", "side", "key"]
    if apart:
        places = explode_kmers(both, ["sample_id", "seq_id", "strand"], "s", width).withColumnRenamed("kmer", "w").select("*", sides.alias("x"))
        places = places.select("sample_id", "seq_id", "strand", "x.*", "pos", "w").join(small_or_not(written(ends)), where)
        group = ["sample_id", "seq_id", "strand", "side", "key"]
        places = places.select(*group, "pos", "w").repartition(*group).sortWithinPartitions(*group, "pos")
        shape = StructType([places.schema[c] for c in [*where, "w"]])
        counted = places.mapInPandas(_first_apart(width), shape).groupBy(*where, "w").agg(count)
    else:
        windows = explode_kmers(both, ["sample_id"], "s", width).withColumnRenamed("kmer", "w").groupBy("sample_id", "w").agg(count)
        counted = windows.select("*", sides.alias("x")).select("sample_id", "w", "c", "x.*").join(ends, where)
    dots = width - F.length(F.translate("w", ".", ""))
    found = counted.groupBy(*where).agg(F.min(F.struct(dots.alias("dots"), (-F.col("c")).alias("c"), "w")).alias("b"))

    def side(name: str) -> DataFrame:
        return found.where(F.col("side") == name).select("sample_id", "key", F.col("b.w").alias(name))

    starts = side("s").withColumnRenamed("key", "sk")
    stops = side("e").withColumnRenamed("key", "ek")
    keyed = pad.withColumn("sk", F.substr("padded_seq", F.lit(half + 1), F.lit(width - half)))
    keyed = keyed.withColumn("ek", F.substr("padded_seq", F.length("padded_seq") - width + 1, F.lit(width - half)))
    out = keyed.join(starts, ["sample_id", "sk"], "left").join(stops, ["sample_id", "ek"], "left")
    middle = F.substr("padded_seq", F.lit(width + 1), F.length("padded_seq") - 2 * width)
    new = F.concat("s", middle, "e")
    return out.withColumn("padded_seq", F.when(F.length("seq") >= k, F.coalesce(new, F.col("padded_seq"))).otherwise(F.col("padded_seq"))).drop("sk", "ek", "s", "e")
