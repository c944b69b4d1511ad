"""Reads: subsets, depth counting against assembly k-mers, depth filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.seq import canonical
from ..functions.stats import clipped_mean

#: Least share of a read's k-mers that the assembly must have for the read to count.
LEAST_HITS = 0.005


def shuffled_subsets(reads: DataFrame, read_id: str, count: int, per_subset: Column, seed: int = 0) -> DataFrame:
    """(subset from 1, read columns): windows of ``per_subset`` reads over one shuffled order, at
    evenly spaced starts, wrapping around, so subsets overlap as little as they can.

    The order is the md5 of seed and id. Ranks are found in two steps, within groups of equal
    leading digits and from the groups' sizes, so no task orders all reads.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(read_id).cast("string")).cast("binary"))
    keyed = reads.withColumn("__h", digest).withColumn("__g", F.substring("__h", 1, 3))
    sizes = keyed.groupBy("__g").agg(F.count(F.lit(1)).alias("__c"))
    run = Window.orderBy("__g")  # at most 16**3 rows
    starts = sizes.select("__g", (F.sum("__c").over(run) - F.col("__c")).alias("__s"), F.sum("__c").over(Window.partitionBy()).alias("__n"))
    rank = F.row_number().over(Window.partitionBy("__g").orderBy("__h", read_id)) - 1
    ranked = keyed.withColumn("__r", rank).join(F.broadcast(starts), "__g").withColumn("__r", F.col("__r") + F.col("__s"))
    n = F.col("__n")
    start = lambda i: F.round(i * n / F.lit(float(count))).cast("bigint")
    chosen = F.filter(F.array(*(F.lit(i) for i in range(count))), lambda i: F.pmod(F.col("__r") - start(i) + n, n) < per_subset)
    return ranked.select(F.explode(chosen).alias("subset"), *reads.columns).withColumn("subset", F.col("subset") + 1)


def read_hits(read_kmers: DataFrame, assembly_kmers: DataFrame, k: int) -> DataFrame:
    """read_id, n_kmers, hits, span_kmers, span_bases, used, rejected.

    ``read_kmers`` has read_id, pos, kmer; ``assembly_kmers`` distinct kmers. The span runs from
    the first hit to the last. A read counts if hits are at least 0.5 % of its k-mers.
    """
    total = read_kmers.groupBy("read_id").agg(F.count(F.lit(1)).alias("n_kmers"))
    hit = read_kmers.join(assembly_kmers.select("kmer"), "kmer", "left_semi")
    hit = hit.groupBy("read_id").agg(F.count(F.lit(1)).alias("hits"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    rows = total.join(hit, "read_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    used = F.col("hits") >= F.greatest(F.col("n_kmers") * LEAST_HITS, F.lit(1e-9))
    span = F.when(used, F.col("hi") - F.col("lo") + 1).otherwise(0).cast("bigint")
    rows = rows.select("read_id", "n_kmers", F.col("hits").cast("bigint").alias("hits"), span.alias("span_kmers"), used.alias("used"))
    return rows.withColumn("span_bases", F.when(F.col("used"), F.col("span_kmers") + (k - 1)).otherwise(0).cast("bigint")).withColumn("rejected", ~F.col("used"))


def read_totals(hits: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, reads, rejected_reads, hits, span_kmers, span_bases, and bases of the reads that count if
    ``hits`` has their length; an error without any hit read is up to the caller."""
    own = lambda c, name: F.coalesce(F.sum(F.when(F.col("used"), F.col(c)).otherwise(0)), F.lit(0)).cast("bigint").alias(name)
    return hits.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("used").cast("bigint")), F.lit(0)).alias("reads"),
        F.coalesce(F.sum(F.col("rejected").cast("bigint")), F.lit(0)).alias("rejected_reads"),
        *(own(c, n) for c, n in (("hits", "hits"), ("span_kmers", "span_kmers"), ("span_bases", "span_bases"), ("length", "bases")) if c in hits.columns),
    )


def tig_depths(tig_kmers: DataFrame, read_counts: DataFrame, repeats: DataFrame, scale: float) -> DataFrame:
    """tig, read_depth: mean of clipped counts times ``scale``. ``tig_kmers`` has tig, offset,
    kmer; k-mers at one offset are alternatives and their counts are summed; an offset with a
    repeated k-mer is left out. Tigs without any offset left have no row (no depth)."""
    bad = tig_kmers.join(repeats, "kmer", "left_semi").select("tig", "offset").distinct()
    good = tig_kmers.distinct().join(bad, ["tig", "offset"], "left_anti")
    counted = good.join(read_counts, "kmer", "left").groupBy("tig", "offset").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("c"))
    mean = clipped_mean(counted, ["tig"], "c", "read_depth")
    return mean.withColumn("read_depth", F.col("read_depth") * scale)


def depth_filter(contigs: DataFrame, keys: list[str], least: float | None, relative: float | None) -> DataFrame:
    """Adds ``kept``: depth at least max(least, relative * depth of the longest contig, the first
    on ties). Groups with a contig without depth keep everything. Columns: length, idx, depth."""
    longest = contigs.groupBy(*keys).agg(
        F.max_by("depth", F.struct("length", (-F.col("idx")).alias("i"))).alias("__d"), F.count(F.lit(1)).alias("__n"), F.count("depth").alias("__k")
    )
    limit = F.greatest(F.lit(float(least or 0)), F.col("__d") * float(relative or 0))
    return contigs.join(longest, keys).withColumn("kept", (F.col("__k") < F.col("__n")) | (F.col("depth") >= limit)).drop("__d", "__n", "__k")


def copy_numbers(contigs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``copies``: depth over the depth of the longest contig."""
    longest = contigs.groupBy(*keys).agg(F.max_by("depth", F.struct("length", (-F.col("idx")).alias("i"))).alias("__d"))
    return contigs.join(longest, keys).withColumn("copies", F.try_divide(F.col("depth"), F.col("__d"))).drop("__d")


def chosen_assembly(runs: DataFrame, keys: list[str], size: str, genome_size: str, low: float, high: float) -> DataFrame:
    """keys, assembler: of runs (assembler, place, resolved) the first in the order of ``place`` that is
    resolved and whose size is ``low`` to ``high`` times the genome's; null without one."""
    ratio = F.try_divide(F.col(size), F.col(genome_size))
    good = F.col("resolved") & ratio.between(low, high)
    return runs.groupBy(*keys).agg(F.min_by("assembler", F.when(good, F.col("place"))).alias("assembler"))


def canonical_read_kmers(exploded: DataFrame) -> DataFrame:
    """Rows with unambiguous k-mers, each in its canonical form."""
    return exploded.where(F.col("kmer").rlike("^[ACGT]+$")).withColumn("kmer", canonical(F.col("kmer")))
