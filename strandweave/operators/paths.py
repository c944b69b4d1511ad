"""Paths of sequences through unitigs: positions, anchors, bridges; links and topology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def positions(steps: DataFrame, keys: list[str], idx: str, length: str) -> DataFrame:
    """Adds ``pos``, where each step begins: lengths of all earlier steps."""
    before = Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("pos", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("bigint"))


def spell(steps: DataFrame, keys: list[str], idx: list[str], piece: Column, sep: str = "") -> DataFrame:
    """keys, seq: pieces joined in the order of ``idx``."""
    ordered = F.sort_array(F.collect_list(F.struct(*idx, piece.alias("__p"))))
    return steps.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["__p"]), sep).alias("seq"))


def anchors(steps: DataFrame, cluster: list[str], seq: str, unitig: str) -> DataFrame:
    """cluster, unitig: visited exactly once by every sequence of the cluster."""
    n = steps.groupBy(*cluster).agg(F.count_distinct(seq).alias("n"))
    per = steps.groupBy(*cluster, unitig, seq).agg(F.count(F.lit(1)).alias("c"))
    seen = per.groupBy(*cluster, unitig).agg(F.count(F.lit(1)).alias("s"), F.max("c").alias("m"))
    return seen.join(n, cluster).where((F.col("s") == F.col("n")) & (F.col("m") == 1)).select(*cluster, unitig)


def segments(steps: DataFrame, keys: list[str], order: list[str], is_anchor: Column) -> DataFrame:
    """Adds ``segment``: how many anchors came so far, this step included (0 before the first)."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("segment", F.sum(F.when(is_anchor, 1).otherwise(0)).over(run).cast("bigint"))


def previous_anchor(steps: DataFrame, keys: list[str], order: list[str], is_anchor: Column, value: str) -> DataFrame:
    """Adds ``previous``: ``value`` of the last anchor before this step."""
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("previous", F.last(F.when(is_anchor, F.col(value)), ignorenulls=True).over(earlier))


def bridge_groups(pairs: DataFrame) -> DataFrame:
    """start, end, depth: how often each (start, end) is spanned."""
    return pairs.groupBy("start", "end").agg(F.count(F.lit(1)).alias("depth"))


def bridge_conflicts(bridges: DataFrame) -> DataFrame:
    """Adds ``conflicting``: another bridge leaves one of the two ends that this one leaves
    (start and -end) or enters one that it enters (end and -start)."""
    ends = bridges.select("start", "end", F.explode(F.array_distinct(F.array(F.col("start"), -F.col("end")))).alias("x"))
    much = ends.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("x")
    bad = ends.join(much, "x", "left_semi").select("start", "end").distinct().withColumn("conflicting", F.lit(True))
    # y is entered exactly when -y is left on the other strand, so leaving says it all
    return bridges.join(bad, ["start", "end"], "left").withColumn("conflicting", F.coalesce("conflicting", F.lit(False)))


def missing_twins(links: DataFrame, keys: list[str]) -> DataFrame:
    """Links (src, dst) without their twin (-dst, -src); empty for a sound graph."""
    twin = links.select(*keys, (-F.col("dst")).alias("src"), (-F.col("src")).alias("dst"))
    return links.join(twin, [*keys, "src", "dst"], "left_anti")


def link_totals(links: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_links in all directions, n_one_way with twins counted once."""
    own, twin = F.struct("src", "dst"), F.struct((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst"))
    return links.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct(F.least(own, twin)).alias("n_one_way"))


def without_unitigs(unitigs: DataFrame, links: DataFrame, keys: list[str], keep: Column) -> tuple[DataFrame, DataFrame]:
    """Unitigs that ``keep`` says, and links between such unitigs."""
    left = unitigs.where(keep)
    ids = left.select(*keys, F.col("number").alias("__n"))
    for side in ("src", "dst"):
        links = links.withColumn("__n", F.abs(side)).join(ids, [*keys, "__n"], "left_semi").drop("__n")
    return left, links


def topology(unitigs: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """keys, topology: fragmented, linear-open-open, circular, linear-hairpin-hairpin,
    linear-open-hairpin or other, one row per graph with unitigs."""
    n = unitigs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    kind = lambda a, b: F.max(F.when((F.signum("src") == a) & (F.signum("dst") == b), 1).otherwise(0))
    flags = links.groupBy(*keys).agg(
        kind(1, 1).alias("loop"), kind(1, -1).alias("end_pin"), kind(-1, 1).alias("start_pin"), F.count(F.lit(1)).alias("l")
    )
    f = n.join(flags, keys, "left").na.fill(0, ["loop", "end_pin", "start_pin", "l"])
    label = (
        F.when(F.col("n") > 1, "fragmented")
        .when(F.col("l") == 0, "linear-open-open")
        .when((F.col("loop") == 1) & (F.col("end_pin") + F.col("start_pin") == 0), "circular")
        .when((F.col("loop") == 0) & (F.col("end_pin") + F.col("start_pin") == 2), "linear-hairpin-hairpin")
        .when((F.col("loop") == 0) & (F.col("end_pin") + F.col("start_pin") == 1), "linear-open-hairpin")
        .otherwise("other")
    )
    return f.select(*keys, label.alias("topology"))
